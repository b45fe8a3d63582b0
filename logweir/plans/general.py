"""Queries of the general data-processing problems: small files, logs, deliveries, skew, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_text
from ..operators import compaction, dedup, drift, logparse, skew
from ..session import table
from .core import TYPED, WIDER

#: Share of a table's rows from which a key counts as heavy, and rows of a key's chunk.
HEAVY_SHARE, CHUNK_ROWS = 0.05, 250_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the consolidated files: each readable WAL record and each job, once."""
    out = compaction.consolidated_files(spark, f"{sf_dir}/blob_objects.parquet")
    return out.where("rec_key is not null").select("obj_kind", "stream_name", "rec_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log entry with its time, level and component."""
    return logparse.entries(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "query_results"))


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p2_found``, with the entry's message over all its lines."""
    return logparse.entries(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "query_results"), texts=True)


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of log lines, with the number of lines of each."""
    lines = logparse.parsed_records(table(spark, sf_dir, "wal_records")).select("shape")
    more = logparse.parsed_results(table(spark, sf_dir, "query_results")).select("shape")
    found = logparse.templates(logparse.shape_counts(lines.unionAll(more)))
    return found.groupBy("template").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_shapes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surplus delivery of a job."""
    return dedup.surplus_rows(spark, f"{sf_dir}/queue_jobs.parquet", dedup.id128(F.col("id")), ["delivered_at", "delivery_no"], ["delivery_no"])


def p4_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job once, with all its columns; deliveries without id are kept."""
    path = f"{sf_dir}/queue_jobs.parquet"
    return dedup.survivors(spark, path, dedup.id128(F.col("id")), ["delivered_at", "delivery_no"], spark.read.parquet(path).columns)


def _label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = table(spark, sf_dir, "wal_records")
    return skew.keyed_runs(wal, label_text(F.col("l")), F.unix_micros(F.col("received_at").cast("timestamp")), F.col("rec_no"), CHUNK_ROWS, "labels")


def _stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "postings")
    return skew.keyed_runs(posts, F.col("stream_id"), F.col("document_id"), F.xxhash64("trigram", "position"), CHUNK_ROWS, "postings")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label set: records, first and last arrival and longest silence, in microseconds."""
    return _label_runs(spark, sf_dir).select(F.col("key").alias("label_set"), "n_rows", "first_value", "last_value", "max_step")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 5 % of their table's rows."""
    heavy = [
        skew.heavy_keys(runs(spark, sf_dir), HEAVY_SHARE).where("key is not null").select(F.lit(tab).alias("tab"), F.col("key").alias("skew_key"))
        for tab, runs in (("wal_records", _label_runs), ("postings", _stream_runs))
    ]
    return heavy[0].unionAll(heavy[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change in the columns of a stream's archive files."""
    out = drift.changes(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "archive_columns"))
    return out.select("stream_id", "file_no", "change_kind", "col_key", "col_to")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.catalogue(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "archive_columns"))


def p6_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's islands of one type; those behind the first are its retypes."""
    return drift.lifespans(_columns(spark, sf_dir))


def p6_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where columns start and end inside their stream, before renames are told."""
    columns = _columns(spark, sf_dir)
    return drift.edges(columns, drift.lifespans(columns))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one table under their columns' last names."""
    return drift.one_table(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "archive_columns"), ["rec_no", "file_no"])


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_messages, p2_templates, p4_found, p4_jobs, p5_found, p5_runs, p6_found, p6_lifespans, p6_edges, p6_table)}

_ID = r"lpad(ltrim(regexp_replace(lower(id), '^\s*(urn:uuid:|0x)|[\s{}-]', '', 'g'), '0'), 32, '0')"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY delivered_at, delivery_no) AS rn FROM queue_jobs"
_LABELS = "array_to_string(list_transform(list_sort(map_entries(l)), lambda e: e.key || '=' || e.value), ',')"

_CATALOGUE = f"""
    told AS (SELECT stream_id, file_no, col_key, CASE col_type WHEN 0 THEN 'int64' WHEN 1 THEN 'float64' WHEN 2 THEN 'string' WHEN 3 THEN 'bool' END AS kind
             FROM archive_columns WHERE stream_id IS NOT NULL AND file_no IS NOT NULL AND col_key IS NOT NULL),
    seen AS (SELECT stream_id, file_no, col_key, kind FROM {TYPED} AS t WHERE stream_id IS NOT NULL AND file_no IS NOT NULL AND (stream_id, file_no) NOT IN (SELECT (stream_id, file_no) FROM told)),
    cat AS (SELECT stream_id, file_no, col_key, {WIDER} AS col_type FROM (SELECT * FROM told UNION ALL SELECT * FROM seen) AS u WHERE kind IS NOT NULL GROUP BY 1, 2, 3)"""
_SPANS = f"""
    WITH {_CATALOGUE},
    begun AS (SELECT *, CASE WHEN lag(col_type) OVER w = col_type THEN 0 ELSE 1 END AS s FROM cat WINDOW w AS (PARTITION BY stream_id, col_key ORDER BY file_no))
    SELECT stream_id, col_key, col_type, CAST(island AS BIGINT) AS island, min(file_no) AS first_file, max(file_no) AS last_file, count(*) AS n_files
    FROM (SELECT *, sum(s) OVER (PARTITION BY stream_id, col_key ORDER BY file_no ROWS UNBOUNDED PRECEDING) AS island FROM begun) AS i GROUP BY stream_id, col_key, col_type, island"""
_EDGES = f"""
    WITH {_CATALOGUE},
    life AS (SELECT stream_id, col_key, min(file_no) AS a, max(file_no) AS b, arg_min(col_type, file_no) AS t0, arg_max(col_type, file_no) AS t1 FROM cat GROUP BY 1, 2),
    ends AS (SELECT stream_id, min(file_no) AS lo, max(file_no) AS hi FROM cat GROUP BY 1)
    SELECT stream_id, a AS file_no, col_key, t0 AS col_type, 'start' AS side FROM life JOIN ends USING (stream_id) WHERE a > lo
    UNION ALL
    SELECT l.stream_id, (SELECT min(file_no) FROM cat AS c WHERE c.stream_id = l.stream_id AND c.file_no > l.b), l.col_key, l.t1, 'end' FROM life AS l JOIN ends AS e ON l.stream_id = e.stream_id WHERE b < hi"""

SQL = {
    "p6_lifespans": _SPANS,
    "p6_edges": _EDGES,
    "p1_found": """
        SELECT DISTINCT 'wal' AS obj_kind, json_extract_string(line, '$.l.stream') AS stream_name, json_extract_string(line, '$.d._id') AS rec_key
        FROM (SELECT unnest(string_split(raw, chr(10))) AS line FROM blob_objects WHERE obj_key LIKE 'wal/%') AS t
        WHERE json_valid(line) AND json_extract_string(line, '$.l.stream') IS NOT NULL AND json_extract_string(line, '$.d._id') IS NOT NULL
        UNION ALL
        SELECT DISTINCT 'queue', '', json_extract_string(job, '$.id')
        FROM (SELECT unnest(CAST(json_extract(raw, '$.jobs') AS JSON[])) AS job FROM blob_objects WHERE obj_key LIKE 'queue/%' AND json_valid(raw)) AS q
        WHERE json_extract_string(job, '$.id') IS NOT NULL""",
    "p4_found": f"SELECT delivery_no FROM ({_RANKED}) AS r WHERE id IS NOT NULL AND rn > 1",
    "p4_jobs": f"SELECT * EXCLUDE (rn) FROM ({_RANKED}) AS r WHERE id IS NULL OR rn = 1",
    "p5_found": f"""
        SELECT 'wal_records' AS tab, {_LABELS} AS skew_key FROM wal_records GROUP BY 2
        HAVING count(*) >= 0.05 * (SELECT count(*) FROM wal_records) AND skew_key IS NOT NULL
        UNION ALL
        SELECT 'postings', CAST(stream_id AS VARCHAR) FROM postings GROUP BY stream_id
        HAVING count(*) >= 0.05 * (SELECT count(*) FROM postings) AND stream_id IS NOT NULL""",
    "p5_runs": f"""
        SELECT label_set, count(*) AS n_rows, min(t) AS first_value, max(t) AS last_value, max(t - p) AS max_step
        FROM (SELECT *, lag(t) OVER (PARTITION BY label_set ORDER BY t NULLS FIRST, rec_no) AS p
              FROM (SELECT {_LABELS} AS label_set, epoch_us(received_at) AS t, rec_no FROM wal_records) AS a) AS b
        GROUP BY label_set""",
}
