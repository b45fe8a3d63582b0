"""Archives: documents of a stream as typed columns in Parquet, inferred from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import ARCHIVE_BLOCK
from ..functions.jsonvals import SPARK_TYPES, exploded, json_type, text_of, widened
from ..functions.labels import label_text, stream_id
from . import skew


def infer_columns(documents: DataFrame, by: list[str], document: str = "d") -> DataFrame:
    """(by..., col_key, col_type): the least type that holds all of a field's values.

    Types are collected per field before the shuffle: a field has four at most. Null is no
    value; objects and arrays are text.
    """
    kinds = exploded(documents, document, by).select(*by, "col_key", json_type(F.col("value")).alias("kind")).where("kind is not null")
    found = kinds.groupBy(*by, "col_key").agg(F.collect_set("kind").alias("kinds"))
    return found.select(*by, "col_key", widened(F.col("kinds")).alias("col_type"))


def typed(document: Column, key: str, kind: str) -> Column:
    """A field of a VARIANT document in its column's type; null where it is missing."""
    if not key:
        raise ValueError("a column needs a name")
    value = F.try_variant_get(document, '$["' + key.replace('"', '\\"') + '"]', "variant")
    if kind == "string":
        return text_of(value)
    return F.try_variant_get(value, "$", SPARK_TYPES[kind])


def projected(documents: DataFrame, columns: list[tuple[str, str]], keep: list[str], document: str = "doc") -> DataFrame:
    """Documents as rows of the given (key, type) columns, in order of name. No column is an error."""
    if not columns:
        raise ValueError("an archive needs a column")
    return documents.select(*keep, *[typed(F.col(document), k, t).alias(k) for k, t in sorted(columns)])


def row_to_document(df: DataFrame, columns: list[str], name: str = "document") -> DataFrame:
    """The row's columns as one JSON document; nulls are left out."""
    return df.withColumn(name, F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def write_archive(rows: DataFrame, path: str, bloom: list[str] = (), mode: str = "append") -> None:
    """Appends rows to the streams' folders: rows of one stream go to few files, sorted by id.

    Large streams are split by ranges of id, so no task writes a whole hot stream.
    """
    _written_by_stream(rows.repartitionByRange("stream_id", "_id"), path, bloom, mode)


def write_documents(documents: DataFrame, columns: list[tuple[str, str]], path: str, document: str = "d", bloom: list[str] = (), mode: str = "append") -> None:
    """As ``write_archive``, of documents (_id, stream_id, JSON text), which are made columns behind the shuffle.

    So the sample that the ranges are drawn from reads ids only. Text that is no JSON is left out.
    """
    placed = documents.select("_id", "stream_id", document).repartitionByRange("stream_id", "_id")
    # exploded, so that the condition on what is parsed doesn't parse it again for itself
    read = placed.select("_id", "stream_id", F.explode(F.array(F.try_parse_json(document))).alias("_doc")).where("_doc is not null")
    _written_by_stream(projected(read, columns, ["_id", "stream_id"], "_doc"), path, bloom, mode)


def _written_by_stream(placed: DataFrame, path: str, bloom: list[str], mode: str) -> None:
    out = placed.sortWithinPartitions("stream_id", "_id").write.mode(mode).option("compression", "zstd")
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.partitionBy("stream_id").parquet(path)


def read_archive(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of all streams; a condition on stream_id reads that stream's folder only."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    return reader.parquet(path)


def block_summary(rows: DataFrame, stream: str, order: list[str], value: str, size: int = ARCHIVE_BLOCK) -> DataFrame:
    """(stream, block_no, n_rows, first_value, last_value) of each block of a stream's rows in order."""
    placed = skew.pieces(rows.select(stream, *dict.fromkeys([*order, value])), stream, order, "blocks")
    blocks = skew.numbered(placed, stream, order, size)
    return blocks.groupBy(stream, F.col(skew.CHUNK).alias("block_no")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("first_value"), F.max(value).alias("last_value"))


def registry(records: DataFrame, labels: str = "l") -> DataFrame:
    """(label_set, stream_id, n_records): streams by their label sets, which hash collisions don't join."""
    found = records.groupBy(label_text(F.col(labels)).alias("label_set")).agg(F.first(labels).alias("l"), F.count(F.lit(1)).alias("n_records"))
    return found.select("label_set", stream_id(F.col("l")).alias("stream_id"), "n_records")


def out_of_order(rows: DataFrame, stream: str, order: list[str], ms: str) -> DataFrame:
    """Adds ``id_ms`` and ``_ooo_ts``: a late row takes the latest time before it, and keeps its own aside.

    The running maximum is taken inside ranges of a stream and merged over them in order.
    """
    placed = skew.pieces(rows, stream, order, "order")
    w = Window.partitionBy(skew.PIECE, stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumn("_run", F.max(ms).over(w))
    ends = placed.groupBy(skew.PIECE, stream).agg(F.max(ms).alias("_max"))
    earlier = Window.partitionBy(stream).orderBy(skew.PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(skew.PIECE, stream, F.max("_max").over(earlier).alias("_before"))
    late = inside.join(before, [skew.PIECE, stream]).withColumn("id_ms", F.greatest("_run", "_before"))
    return late.withColumn("_ooo_ts", F.when(F.col(ms) < F.col("id_ms"), F.col(ms))).drop("_run", "_before", skew.PIECE)


def rollup_time(rows: DataFrame, at: Column, unit: str, keys: list[str], value: str) -> DataFrame:
    """Count, mean and largest value per time unit and keys."""
    return rows.groupBy(F.date_trunc(unit, at).alias("bucket"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def logfmt(line: Column) -> Column:
    """Fields of a logfmt line; quoted values may hold spaces, a key's last value counts."""
    pairs = F.regexp_extract_all(line, F.lit(r'([\w.]+=(?:"[^"]*"|\S*))'), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, r"^[\w.]+=", ""), '^"|"$', "").alias("value")))
    unique = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return F.when(line.isNotNull(), unique)
