"""Schemas that drift between files: a catalogue of column lifespans, its changes and casts.

Column definitions come from the files' stored metadata; only for files that have none are they
inferred from the records. Everything after that works on the catalogue (a row per file and
column), not on records: first and last file of each column, the type before each file (lag), and
islands of files with one type. Columns that end where another starts are compared by the values
they carry, by an equi-join on the values, which gives the alias table; from it and the types
follow the casts that put all files into one table.

Defined results: text that is no JSON object, null documents and rows without stream or file are
no file's columns; JSON null is no value; a column that is absent from some files and back later
has not changed; repeated definitions count once, contradicting ones are widened; no rows, no changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonvals import SPARK_TYPES, exploded, json_type, text_of, type_name, widened
from ..session import written

FILE = ["stream_id", "file_no"]
#: Columns of their own that the consistent table has at most; the fields beyond stay in a map.
MAX_COLUMNS = 2000


def catalogue(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """(stream_id, file_no, col_key, col_type): each column of each file, written once."""
    stored = definitions.where("stream_id is not null and file_no is not null and col_key is not null")
    told = stored.select(*FILE, "col_key", type_name(F.col("col_type")).alias("kind"))
    untold = records.where("stream_id is not null and file_no is not null").join(told.select(*FILE).distinct(), FILE, "left_anti")
    seen = exploded(untold, "d", FILE).select(*FILE, "col_key", json_type(F.col("value")).alias("kind"))
    kinds = told.unionAll(seen).where("kind is not null").groupBy(*FILE, "col_key").agg(F.collect_set("kind").alias("kinds"))
    return written(kinds.select(*FILE, "col_key", widened(F.col("kinds")).alias("col_type")), "catalogue")


def lifespans(columns: DataFrame) -> DataFrame:
    """Islands of one type, numbered from 1: (stream_id, col_key, col_type, island, first_file, last_file, n_files)."""
    by = Window.partitionBy("stream_id", "col_key").orderBy("file_no")
    start = F.coalesce((F.lag("col_type").over(by) != F.col("col_type")).cast("int"), F.lit(1))
    island = F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        columns.withColumn("start", start)
        .withColumn("island", island)
        .groupBy("stream_id", "col_key", "col_type", "island")
        .agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count(F.lit(1)).alias("n_files"))
    )


def edges(columns: DataFrame, spans: DataFrame) -> DataFrame:
    """Starts and ends of columns inside their stream, from their islands: (stream_id, file_no, col_key, col_type, side).

    ``file_no`` of an end is the first file after the column's last.
    """
    files = columns.select(*FILE).distinct()
    after = files.withColumn("next_file", F.lead("file_no").over(Window.partitionBy("stream_id").orderBy("file_no")))
    whole = spans.groupBy("stream_id").agg(F.min("first_file").alias("stream_first"), F.max("last_file").alias("stream_last"))
    lives = spans.groupBy("stream_id", "col_key").agg(
        F.min("first_file").alias("first_file"),
        F.max("last_file").alias("last_file"),
        F.min_by("col_type", "first_file").alias("first_type"),
        F.max_by("col_type", "last_file").alias("last_type"),
    ).join(whole, "stream_id")
    starts = lives.where("first_file > stream_first").select("stream_id", F.col("first_file").alias("file_no"), "col_key", F.col("first_type").alias("col_type"), F.lit("start").alias("side"))
    ends = lives.where("last_file < stream_last").select("stream_id", F.col("last_file").alias("file_no"), "col_key", F.col("last_type").alias("col_type"))
    ends = ends.join(after, FILE).select("stream_id", F.col("next_file").alias("file_no"), "col_key", "col_type", F.lit("end").alias("side"))
    return written(starts.unionAll(ends), "edges")


def retypes(spans: DataFrame) -> DataFrame:
    """Islands behind the first one of their column: (stream_id, file_no, col_key, col_type)."""
    return spans.where("island > 1").select("stream_id", F.col("first_file").alias("file_no"), "col_key", "col_type")


def _related(a: Column, b: Column) -> Column:
    plain = [F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (a, b)]
    return plain[0].contains(plain[1]) | plain[1].contains(plain[0])


def renames(records: DataFrame, changed: DataFrame) -> DataFrame:
    """Alias table (stream_id, file_no, old_key, new_key): a column whose values another carries on.

    Both ways the share of rows whose value the other column has is taken; a pair must be each
    other's best by their mean, and share no fewer distinct values than two sets of their sizes would by
    chance, if drawn from all values of their kind (numbers or other texts) that ended or started
    columns hold anywhere. True and false are evidence of nothing, so columns of bool need related
    names as well. Pairs arise only from shared values.
    """
    both = changed.groupBy(*FILE).agg(F.countDistinct("side").alias("n")).where("n = 2").select(*FILE)
    wanted = changed.join(both, FILE).select(*FILE, "col_key", "side")
    streams = wanted.select("stream_id").distinct()
    fields = exploded(records.select("stream_id", "d").join(streams, "stream_id", "left_semi"), "d", ["stream_id"])
    told = fields.join(wanted, ["stream_id", "col_key"]).where(json_type(F.col("value")).isNotNull())
    text = text_of(F.col("value"))
    number = text.try_cast("double")
    values = written(
        told.withColumns({"text": F.coalesce(number.cast("string"), text), "is_number": number.isNotNull()}).groupBy(*FILE, "side", "col_key", "text", "is_number").agg(F.count(F.lit(1)).alias("n")),
        "carried",
    )
    kinds = {r["is_number"]: r["n"] for r in values.select("is_number", "text").distinct().groupBy("is_number").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = values.groupBy(*FILE, "side", "col_key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.bool_and("is_number").alias("is_number"), F.bool_and(F.col("text").isin("true", "false")).alias("is_bool"))
    old, new = (
        values.where(F.col("side") == side).select(*FILE, "text", F.col("col_key").alias(f"{name}_key"), F.col("n").alias(f"{name}_n"))
        for side, name in (("end", "old"), ("start", "new"))
    )
    shared = old.join(new, [*FILE, "text"]).groupBy(*FILE, "old_key", "new_key").agg(F.sum("old_n").alias("old_n"), F.sum("new_n").alias("new_n"), F.count(F.lit(1)).alias("n_shared"))
    for side, name in (("end", "old"), ("start", "new")):
        shared = shared.join(totals.where(F.col("side") == side).select(*FILE, F.col("col_key").alias(f"{name}_key"), F.col("total").alias(f"{name}_total"), F.col("distinct").alias(f"{name}_distinct"), F.col("is_number").alias(f"{name}_number"), F.col("is_bool").alias(f"{name}_bool")), [*FILE, f"{name}_key"])
    score = (F.col("old_n") / F.col("old_total") + F.col("new_n") / F.col("new_total")) / 2
    every = F.when(F.col("old_number") & F.col("new_number"), F.lit(kinds.get(True, 0))).otherwise(F.lit(sum(kinds.values())))
    chance = F.col("old_distinct") * F.col("new_distinct") / F.greatest(every, F.col("old_distinct") + F.col("new_distinct"))
    likely = shared.withColumn("score", score).where((F.col("n_shared") >= chance) & (~(F.col("old_bool") & F.col("new_bool")) | _related(F.col("old_key"), F.col("new_key"))))
    best = lambda key, other: F.row_number().over(Window.partitionBy(*FILE, key).orderBy(F.desc("score"), other))
    return likely.withColumns({"a": best("old_key", "new_key"), "b": best("new_key", "old_key")}).where("a = 1 and b = 1").select(*FILE, "old_key", "new_key")


def changes(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every change: (stream_id, file_no, change_kind, col_key, col_to)."""
    columns = catalogue(records, definitions)
    spans = written(lifespans(columns), "lifespans")
    changed = edges(columns, spans)
    alias = written(renames(records, changed), "aliases")
    gone = alias.select(*FILE, F.col("old_key").alias("col_key"), F.lit("end").alias("side"))
    come = alias.select(*FILE, F.col("new_key").alias("col_key"), F.lit("start").alias("side"))
    plain = changed.join(gone.unionAll(come), [*FILE, "col_key", "side"], "left_anti")
    return (
        plain.select(*FILE, F.when(F.col("side") == "start", "added").otherwise("removed").alias("change_kind"), "col_key", F.when(F.col("side") == "start", F.col("col_type")).otherwise("").alias("col_to"))
        .unionAll(alias.select(*FILE, F.lit("renamed"), "old_key", "new_key"))
        .unionAll(retypes(spans).select(*FILE, F.lit("retyped"), "col_key", "col_type"))
    )


def casts(columns: DataFrame, alias: DataFrame) -> DataFrame:
    """What each column of a stream becomes: (stream_id, col_key, to_key, to_type).

    Renames are followed in the order of files, so a chain ends at its last name; the type is the
    least one that holds every type the column had under any of its names. A stream's renames
    are metadata: few, whatever its number of records.
    """
    steps = alias.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("file_no", "old_key", "new_key"))).alias("steps"))
    kinds = columns.groupBy("stream_id", "col_key").agg(F.collect_set("col_type").alias("kinds"))
    followed = F.aggregate("steps", F.col("col_key"), lambda now, s: F.when(s["old_key"] == now, s["new_key"]).otherwise(now))
    named = kinds.join(steps, "stream_id", "left").withColumn("to_key", F.coalesce(followed, F.col("col_key"))).drop("steps")
    to = named.groupBy("stream_id", "to_key").agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("all_kinds"))
    return named.join(to, ["stream_id", "to_key"]).select("stream_id", "col_key", "to_key", widened(F.col("all_kinds")).alias("to_type"))


def one_table(records: DataFrame, definitions: DataFrame, keep: list[str], most: int = MAX_COLUMNS) -> DataFrame:
    """All records under their columns' last names, each name a column of the least type that holds it in every stream.

    The kept columns and stream_id, then the names in order; ``msg`` and ``ts`` are among them. A
    name that a record holds under two of its spellings keeps the first in order of name. A field
    that is in no catalogue, or beyond the ``most`` names that most streams have, stays in ``rest``
    as text. A name that clashes with a kept column gets a trailing underscore. Only names and types
    come to the driver.
    """
    columns = catalogue(records, definitions)
    alias = written(renames(records, edges(columns, lifespans(columns))), "aliases")
    cast = written(casts(columns, alias), "casts")
    names = cast.groupBy("to_key").agg(F.array_distinct(F.collect_list("to_type")).alias("kinds"), F.count(F.lit(1)).alias("n"))
    chosen = sorted((r["to_key"], r["kind"]) for r in names.select("to_key", "n", widened(F.col("kinds")).alias("kind")).orderBy(F.desc("n"), "to_key").limit(most).collect())
    by_stream = cast.where("col_key <> to_key").groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("col_key", "to_key"))).alias("to"))
    read = records.select(*keep, "stream_id", F.try_parse_json("d").alias("v")).where("v is not null").join(by_stream, "stream_id", "left")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    given = read.withColumn("_f", fields)
    pairs = F.transform(F.array_sort(F.map_keys("_f")), lambda k: F.struct(F.coalesce(F.col("to")[k], k).alias("key"), F.col("_f")[k].alias("value")))
    held = F.filter(pairs, lambda e: ~F.is_variant_null(e["value"]))
    unique = F.aggregate(
        held, F.array().cast("array<struct<key:string,value:variant>>"), lambda out, e: F.when(F.exists(out, lambda o: o["key"] == e["key"]), out).otherwise(F.array_append(out, e))
    )
    named = given.withColumn("_m", F.map_from_entries(unique))
    value = lambda k, kind: text_of(F.col("_m")[k]) if kind == "string" else F.try_variant_get(F.col("_m")[k], "$", SPARK_TYPES[kind])
    taken = {*keep, "stream_id", "rest"}
    typed = [value(k, kind).alias(k if k not in taken else f"{k}_") for k, kind in chosen]
    known = F.array(*[F.lit(k) for k, _ in chosen]).cast("array<string>")
    rest = F.transform_values(F.map_filter("_m", lambda k, _: ~F.array_contains(known, k)), lambda _, v: text_of(v))
    return named.select(*keep, "stream_id", *typed, rest.alias("rest"))
