"""The log query: records whose labels hold a label set and whose message holds a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import labels_match

# What is said of a document that can't be stored, checked in this order.
INGEST_ERRORS = [
    "missing 'msg' field in document",
    "'msg' field must be a string",
    "missing 'ts' field in document",
    "'ts' field must be an int64",
    "document cannot contain '_id' field",
]


def _kind(document: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(document, f"$.{key}", "variant"))


def message(document: Column) -> Column:
    """The message of a VARIANT document; null if missing or no text."""
    return F.when(_kind(document, "msg") == "STRING", F.try_variant_get(document, "$.msg", "string"))


def timestamp_ms(document: Column) -> Column:
    return F.when(_kind(document, "ts") == "BIGINT", F.try_variant_get(document, "$.ts", "bigint"))


def logs(records: DataFrame, labels: str = "l", document: str = "d") -> DataFrame:
    """Adds the parsed document ``doc``, ``msg`` and ``ts`` to records whose document is text."""
    return records.withColumn("doc", F.try_parse_json(document)).withColumns({"msg": message(F.col("doc")), "ts": timestamp_ms(F.col("doc"))})


def holds(text: str, column: Column | None = None) -> Column:
    """Whether the message holds ``text``, byte for byte; '' is in every message."""
    return F.coalesce(F.contains(F.col("msg") if column is None else column, F.lit(text)), F.lit(False))


def query(records: DataFrame, labels: dict[str, str], text: str, label_column: str = "l") -> DataFrame:
    """Records of the label set with the text; labels are tested before documents are parsed."""
    return logs(records.where(labels_match(F.col(label_column), labels))).where(holds(text))


def query_regex(records: DataFrame, labels: dict[str, str], pattern: str) -> DataFrame:
    return logs(records.where(labels_match(F.col("l"), labels))).where(F.coalesce(F.col("msg").rlike(pattern), F.lit(False)))


def query_terms(records: DataFrame, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Boolean full-text query without regard to case."""
    low = F.lower("msg")
    has = lambda t: F.coalesce(F.contains(low, F.lit(t.lower())), F.lit(False))
    keep = F.lit(True)
    for t in all_of:
        keep = keep & has(t)
    if any_of:
        some = F.lit(False)
        for t in any_of:
            some = some | has(t)
        keep = keep & some
    for t in none_of:
        keep = keep & ~has(t)
    return logs(records).where(keep & F.col("msg").isNotNull())


def time_range(records: DataFrame, low_ms: int, high_ms: int, lateness_ms: int, arrival_ms: Column) -> DataFrame:
    """Records whose own time is in [low, high), arrived within the range widened by the lateness.

    The widened range is a predicate on a stored column, so it prunes files; the exact one follows.
    """
    near = arrival_ms.between(low_ms - lateness_ms, high_ms + lateness_ms)
    return logs(records.where(near)).where((F.col("ts") >= low_ms) & (F.col("ts") < high_ms))


def by_ids(rows: DataFrame, ident: str | list[str], ids: DataFrame | list) -> DataFrame:
    """Rows whose id is wanted. A list becomes a predicate of the scan, a DataFrame a semi-join.

    ident: the column of the id, or for a DataFrame the columns that make it up, named the same
    there: a document's id is unique inside its stream only.
    """
    if isinstance(ids, DataFrame):
        if isinstance(ident, str):
            return rows.join(ids.select(F.col(ids.columns[0]).alias(ident)), ident, "left_semi")
        return rows.join(ids.select(*ident), ident, "left_semi")
    return rows.where(F.col(ident).isin(*ids))


def truncated(rows: DataFrame, stream: str, stream_id: int, before_ms: int, at: Column) -> DataFrame:
    """All rows but those of a stream from before a time; rows without stream or time stay."""
    return rows.where(~F.coalesce((F.col(stream) == stream_id) & (at < before_ms), F.lit(False)))


def validated(documents: DataFrame, document: str = "doc") -> DataFrame:
    """Adds ``error``: the first reason not to store a VARIANT document, or null."""
    kind = {k: _kind(F.col(document), k) for k in ("msg", "ts", "_id")}
    absent = lambda k: kind[k].isNull()
    tests = [absent("msg"), kind["msg"] != "STRING", absent("ts"), kind["ts"] != "BIGINT", ~absent("_id")]
    out = F.when(F.col(document).isNull(), F.lit(INGEST_ERRORS[0]))
    for test, text in zip(tests, INGEST_ERRORS):
        out = out.when(test, F.lit(text))
    return documents.withColumn("error", out)
