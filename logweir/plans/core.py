"""Queries of the engine's own operators, each with its SQL counterpart where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, ids, results
from ..functions.labels import label_text, stream_id
from ..functions.jsonvals import exploded, json_type, text_type
from ..operators import archive, query, queue, skew, trigram
from ..session import kept, scratch, table, written
from ..sources import blobs, wal
from ..streaming import ingest
from ..streaming.ids import with_stream_ids

QUERIES: dict = {}
SQL: dict[str, str] = {}


def queries_of(queries: dict, sqls: dict):
    """A decorator's maker that enters a query, with its SQL if it has one."""

    def make(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return make


_query = queries_of(QUERIES, SQL)


# What the example queries ask for.
LABELS, TEXT, PATTERN = {"app": "blobproxy", "env": "prod"}, "retry", r"retry [0-9]+ after"
LOW_MS, HIGH_MS, LATE_MS = 1734000000000, 1734400000000, 3_600_000
NOW = "2024-12-12 00:00:00"

_MSG = "CASE WHEN json_valid(d) THEN json_extract_string(d, '$.msg') END"
_TS = "CASE WHEN json_valid(d) THEN try_cast(json_extract_string(d, '$.ts') AS BIGINT) END"
_LOGS = f"(SELECT rec_no, stream_id, file_no, received_at, l, d, {_MSG} AS msg, {_TS} AS ts FROM wal_records)"
_LABELLED = "l['app'] = 'blobproxy' AND l['env'] = 'prod'"
_LABEL_TEXT = "array_to_string(list_transform(list_sort(map_entries(l)), lambda e: e.key || '=' || e.value), ',')"


def _wal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wal_records")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.coalesce("stream_id", F.lit(0)).alias("stream_id"), F.col("doc_id").alias("document_id"), "text")


# --- queries


@_query(f"SELECT rec_no, stream_id, msg, ts FROM {_LOGS} AS t WHERE {_LABELLED} AND contains(msg, 'retry')")
def query_label_substring(spark, sf):
    return query.query(_wal(spark, sf), LABELS, TEXT).select("rec_no", "stream_id", "msg", "ts")


@_query(f"SELECT rec_no, msg FROM {_LOGS} AS t WHERE {_LABELLED} AND msg IS NOT NULL")
def query_labels_only(spark, sf):
    return query.query(_wal(spark, sf), LABELS, "").select("rec_no", "msg")


@_query(f"SELECT rec_no, ts FROM {_LOGS} AS t WHERE contains(msg, 'retry')")
def query_empty_labels(spark, sf):
    return query.query(_wal(spark, sf), {}, TEXT).select("rec_no", "ts")


@_query(f"SELECT count(*) AS n FROM {_LOGS} AS t WHERE l['no such label'] = 'x'")
def query_absent_label(spark, sf):
    return query.query(_wal(spark, sf), {"no such label": "x"}, "").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT count(*) FILTER (WHERE contains(msg, 'ERROR')) AS upper_case, count(*) FILTER (WHERE contains(msg, 'error')) AS lower_case FROM {_LOGS} AS t")
def query_case_sensitive(spark, sf):
    rows = query.logs(_wal(spark, sf))
    return rows.agg(F.count(F.when(query.holds("ERROR"), 1)).alias("upper_case"), F.count(F.when(query.holds("error"), 1)).alias("lower_case"))


@_query(f"SELECT rec_no, msg FROM {_LOGS} AS t WHERE {_LABELLED} AND regexp_matches(msg, 'retry [0-9]+ after')")
def query_regex(spark, sf):
    return query.query_regex(_wal(spark, sf), LABELS, PATTERN).select("rec_no", "msg")


@_query(f"SELECT rec_no FROM {_LOGS} AS t WHERE contains(lower(msg), 'bucket') AND (contains(lower(msg), 'retry') OR contains(lower(msg), 'lease')) AND NOT contains(lower(msg), 'goroutine')")
def query_full_text(spark, sf):
    return query.query_terms(_wal(spark, sf), ["bucket"], ["retry", "lease"], ["goroutine"]).select("rec_no")


@_query(f"SELECT rec_no, ts FROM {_LOGS} AS t WHERE ts >= {LOW_MS} AND ts < {HIGH_MS} AND epoch_us(received_at) // 1000 BETWEEN {LOW_MS - LATE_MS} AND {HIGH_MS + LATE_MS}")
def query_time_range(spark, sf):
    return query.time_range(_wal(spark, sf), LOW_MS, HIGH_MS, LATE_MS, F.unix_millis(F.col("received_at").cast("timestamp"))).select("rec_no", "ts")


@_query("SELECT rec_no, obj_key, line_no FROM wal_records ORDER BY obj_key, line_no, rec_no LIMIT 100")
def query_first_in_order(spark, sf):
    """The first 100 results in the order of objects and lines: a limit as a feature."""
    return _wal(spark, sf).select("rec_no", "obj_key", "line_no").orderBy("obj_key", "line_no", "rec_no").limit(100)


@_query("SELECT rec_no, stream_id, d FROM wal_records WHERE rec_no IN (1, 17, 400, 999999999)")
def get_by_ids(spark, sf):
    return query.by_ids(_wal(spark, sf), "rec_no", [1, 17, 400, 999999999]).select("rec_no", "stream_id", "d")


@_query("SELECT stream_id, document_id, document FROM query_results WHERE (stream_id, document_id) IN (SELECT (stream_id, document_id) FROM postings)")
def get_by_ids_semi(spark, sf):
    keys = ["stream_id", "document_id"]
    return query.by_ids(table(spark, sf, "query_results"), keys, table(spark, sf, "postings")).select(*keys, "document")


@_query("SELECT rec_no, stream_id, d FROM wal_records WHERE NOT (stream_id = -1969036589157345924 AND epoch_us(received_at) // 1000 < 1734400000000)")
def stream_truncate(spark, sf):
    rows = query.truncated(_wal(spark, sf), "stream_id", -1969036589157345924, HIGH_MS, F.unix_millis(F.col("received_at").cast("timestamp")))
    return rows.select("rec_no", "stream_id", "d")


# --- ingest and log

_CASES = """(SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '{"msg":"m","ts":1}' WHEN 1 THEN '{"ts":1}' WHEN 2 THEN '{"msg":7,"ts":1}'
    WHEN 3 THEN '{"msg":"m"}' WHEN 4 THEN '{"msg":"m","ts":1.5}' ELSE '{"msg":"m","ts":1,"_id":3}' END AS text FROM events)"""


@_query(
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'missing ''msg'' field in document' WHEN 2 THEN '''msg'' field must be a string'
    WHEN 3 THEN 'missing ''ts'' field in document' WHEN 4 THEN '''ts'' field must be an int64' WHEN 5 THEN 'document cannot contain ''_id'' field' END AS error FROM events"""
)
def ingest_validation(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    rows = spark.sql(f"SELECT event_id, text FROM {_CASES} AS c").withColumn("doc", F.try_parse_json("text"))
    return query.validated(rows).select("event_id", "error")


@_query(f"SELECT {_LABEL_TEXT} AS label_set, json_extract_string(d, '$.msg') AS msg, {_TS} AS ts FROM wal_records WHERE json_valid(d)")
def wal_roundtrip(spark, sf):
    """Valid documents written to a new log and scanned again."""
    path = scratch(spark, "wal")
    rows = _wal(spark, sf).withColumn("d", F.try_parse_json("d")).where("d is not null")
    wal.append(rows, path)
    back = wal.scan(spark, path)
    return back.select(label_text(F.col("l")).alias("label_set"), query.message(F.col("d")).alias("msg"), query.timestamp_ms(F.col("d")).alias("ts"))


@_query("""
    SELECT obj_key, count(*) FILTER (WHERE json_valid(line)) AS n_good, count(*) FILTER (WHERE NOT json_valid(line)) AS n_bad
    FROM (SELECT obj_key, unnest(string_split(raw, chr(10))) AS line FROM blob_objects WHERE obj_key LIKE 'wal/%') AS t GROUP BY obj_key""")
def wal_errors(spark, sf):
    """Good and bad lines per log object; the scan goes on after a bad one."""
    lines = table(spark, sf, "blob_objects").where(F.col("obj_key").startswith("wal/")).select("obj_key", F.explode(F.split("raw", "\n")).alias("value"))
    return wal.decode(lines).groupBy("obj_key").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n_good"), F.count("error").alias("n_bad"))


_FIELDS = """(SELECT stream_id, file_no, key, json_type(d, '$."' || key || '"') AS t
    FROM (SELECT stream_id, file_no, d, unnest(json_keys(d)) AS key FROM wal_records WHERE json_valid(d)) AS k)"""
TYPED = f"(SELECT stream_id, file_no, key AS col_key, CASE t WHEN 'BIGINT' THEN 'int64' WHEN 'UBIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' WHEN 'BOOLEAN' THEN 'bool' ELSE 'string' END AS kind FROM {_FIELDS} AS f WHERE t <> 'NULL')"
WIDER = "CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN bool_and(kind IN ('int64', 'float64')) THEN 'float64' ELSE 'string' END"


@_query(f"SELECT col_key, kind, count(*) AS n FROM {TYPED} AS t GROUP BY ALL")
def json_number_types(spark, sf):
    fields = exploded(_wal(spark, sf), "d", ["rec_no"]).withColumn("kind", json_type(F.col("value"))).where("kind is not null")
    return fields.groupBy("col_key", "kind").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN t IS NULL THEN NULL WHEN regexp_full_match(t, '[+-]?\\d{1,19}') THEN 'int64'
    WHEN regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN 'float64' WHEN lower(t) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind
    FROM (SELECT trim(unnest(string_split(text, ' '))) AS t FROM documents) AS w) AS k GROUP BY kind""")
def typed_texts(spark, sf):
    """Typed values inside texts: what the words of all documents spell."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("t"))
    return words.groupBy(text_type(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- streams and ids


@_query(f"SELECT {_LABEL_TEXT} AS label_set, min(stream_id) AS stream_id, count(*) AS n_records FROM wal_records GROUP BY 1")
def stream_registry(spark, sf):
    return archive.registry(_wal(spark, sf))


@_query("SELECT DISTINCT stream_id, 'stream/' || printf('%016x', CASE WHEN stream_id < 0 THEN stream_id::HUGEINT + 18446744073709551616 ELSE stream_id::HUGEINT END) || '/0.data' AS file_name FROM wal_records")
def stream_file_names(spark, sf):
    found = _wal(spark, sf).select(label_text(F.col("l")).alias("k"), "l").groupBy("k").agg(F.first("l").alias("l")).select(stream_id(F.col("l")).alias("stream_id"))
    return found.select("stream_id", F.concat(F.lit("stream/"), F.lower(F.lpad(F.hex("stream_id"), 16, "0")), F.lit("/0.data")).alias("file_name"))


@_query(f"SELECT rec_no, (ts << 20) | (row_number() OVER (PARTITION BY stream_id ORDER BY rec_no) % 1048576) AS document_id FROM {_LOGS} AS t WHERE ts IS NOT NULL")
def document_id(spark, sf):
    rows = query.logs(_wal(spark, sf)).where("ts is not null").select("stream_id", "rec_no", "ts")
    return ids.with_ids(rows, "stream_id", "ts", ["rec_no"]).select("rec_no", "document_id")


@_query("SELECT stream_id, document_id, document_id >> 20 AS ms, document_id & 1048575 AS counter FROM query_results")
def document_id_unpack(spark, sf):
    i = F.col("document_id")
    return table(spark, sf, "query_results").select("stream_id", "document_id", ids.id_ms(i).alias("ms"), ids.id_counter(i).alias("counter"))


@_query(f"""
    SELECT rec_no, m AS id_ms, CASE WHEN ts < m THEN ts END AS _ooo_ts
    FROM (SELECT rec_no, ts, max(ts) OVER (PARTITION BY stream_id ORDER BY rec_no) AS m FROM {_LOGS} AS t WHERE ts IS NOT NULL) AS w""")
def late_ids(spark, sf):
    rows = query.logs(_wal(spark, sf)).where("ts is not null").select("stream_id", "rec_no", "ts")
    return archive.out_of_order(rows, "stream_id", ["rec_no"], "ts").select("rec_no", "id_ms", "_ooo_ts")


# --- archives (G1, F7, F8, S6 to S12, W5, U1, T8 rollups)


@_query(f"SELECT stream_id, file_no, col_key, {WIDER} AS col_type FROM {TYPED} AS t GROUP BY stream_id, file_no, col_key")
def infer_columns(spark, sf):
    return archive.infer_columns(_wal(spark, sf), ["stream_id", "file_no"])


@_query(f"SELECT col_key, {WIDER} AS col_type FROM {TYPED} AS t GROUP BY col_key")
def widen_types(spark, sf):
    return archive.infer_columns(_wal(spark, sf), [])


@_query(f"""
    SELECT stream_id, rn // 1000 AS block_no, count(*) AS n_rows, min(rec_no) AS first_value, max(rec_no) AS last_value
    FROM (SELECT stream_id, rec_no, row_number() OVER (PARTITION BY stream_id ORDER BY rec_no) - 1 AS rn FROM wal_records) AS t GROUP BY ALL""")
def archive_blocks(spark, sf):
    return archive.block_summary(_wal(spark, sf), "stream_id", ["rec_no"], "rec_no")


_ALL_FIELDS = """(SELECT rec_no, key AS col_key, json_type(d, '$."' || key || '"') AS t, json_extract_string(d, '$."' || key || '"') AS text FROM (SELECT rec_no, d, unnest(json_keys(d)) AS key FROM wal_records WHERE json_valid(d)) AS k)"""


def _typed_rows(spark, sf) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All documents as rows of all their columns, each of the type that holds its values."""
    columns = sorted((r["col_key"], r["col_type"]) for r in archive.infer_columns(_wal(spark, sf), []).collect())
    docs = _wal(spark, sf).withColumn("doc", F.try_parse_json("d")).where("doc is not null").withColumn("_id", F.col("rec_no"))
    return archive.projected(docs, columns, ["_id", "stream_id"]), columns


def _field_rows(rows: DataFrame, ident: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(rec_no, col_key, value, number): every field, texts and flags as text, numbers as double."""
    field = lambda k, t: F.struct(F.lit(k).alias("col_key"), (F.lit(None).cast("string") if t in ("int64", "float64") else F.col(f"`{k}`").cast("string")).alias("value"), (F.col(f"`{k}`").cast("double") if t in ("int64", "float64") else F.lit(None).cast("double")).alias("number"))
    each = rows.select(F.col(ident).alias("rec_no"), F.explode(F.array(*[field(k, t) for k, t in columns])).alias("f")).select("rec_no", "f.*")
    return each.where("value is not null or number is not null")


_FIELD_SQL = f"""
    SELECT rec_no, col_key, CASE WHEN col_type IN ('string', 'bool') THEN text END AS value, CASE WHEN col_type IN ('int64', 'float64') THEN CAST(text AS DOUBLE) END AS number
    FROM {_ALL_FIELDS} AS f JOIN (SELECT col_key, {WIDER} AS col_type FROM {TYPED} AS t GROUP BY col_key) AS c USING (col_key) WHERE t <> 'NULL'"""


@_query(_FIELD_SQL)
def archive_roundtrip(spark, sf):
    """All fields of all documents as typed columns, written to the streams' folders and read again."""
    path = scratch(spark, "archive")
    rows, columns = _typed_rows(spark, sf)
    archive.write_documents(_wal(spark, sf).withColumn("_id", F.col("rec_no")), columns, path, bloom=["_id"])
    return _field_rows(archive.read_archive(spark, path, rows.schema), "_id", columns)


@_query(_FIELD_SQL)
def row_to_document(spark, sf):
    """Rows made documents and read as rows again, with all their fields."""
    rows, columns = _typed_rows(spark, sf)
    out = archive.row_to_document(rows, [k for k, _ in columns]).select("_id", F.parse_json("document").alias("doc"))
    return _field_rows(archive.projected(out, columns, ["_id"]), "_id", columns)


@_query("SELECT rec_no, stream_id, NULL::BIGINT AS document_id, d AS document FROM wal_records UNION ALL SELECT NULL, stream_id, document_id, document FROM query_results")
def disk_union_wal(spark, sf):
    stored = table(spark, sf, "query_results").select("stream_id", "document_id", "document")
    return _wal(spark, sf).select("rec_no", "stream_id", F.col("d").alias("document")).unionByName(stored, allowMissingColumns=True)


@_query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, avg(value) AS mean_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def rollup_time(spark, sf):
    return archive.rollup_time(table(spark, sf, "events"), F.col("ts"), "hour", ["event_type"], "value")


@_query(f"""
    SELECT rec_no, nullif(regexp_extract(line, '(?:^| )(?:level|lvl)=(\\w+)', 1), '') AS lvl, nullif(trim(regexp_extract(line, '(?:^| )(?:time|ts)=("[^"]+"|\\S+)', 1), '"'), '') AS at
    FROM (SELECT rec_no, split_part(msg, chr(10), 1) AS line FROM {_LOGS} AS t) AS u WHERE regexp_matches(line, '^[A-Za-z_][\\w.]*=')""")
def logfmt_lines(spark, sf):
    """Level and time of every line of keys and values, whatever its first key."""
    line = F.split_part(F.col("msg"), F.lit("\n"), F.lit(1))
    rows = query.logs(_wal(spark, sf)).withColumn("line", line).where(F.col("line").rlike(r"^[A-Za-z_][\w.]*=")).withColumn("f", archive.logfmt(F.col("line")))
    return rows.select("rec_no", F.coalesce(F.col("f")["level"], F.col("f")["lvl"]).alias("lvl"), F.coalesce(F.col("f")["time"], F.col("f")["ts"]).alias("at"))


# --- trigram index

_HEX = "(SELECT coalesce(stream_id, 0) AS stream_id, doc_id AS document_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)"


def _occurrences(q: str) -> str:
    h = q.encode().hex().upper()
    return f"""SELECT stream_id, document_id, unnest(list_filter(range(CAST(length(h) / 2 AS BIGINT)), lambda i: substr(h, 2 * i + 1, {len(h)}) = '{h}')) AS position
        FROM {_HEX} AS t WHERE contains(h, '{h}')"""


_POSTED = "(SELECT DISTINCT lower(trigram) AS trigram, document_id, stream_id, position FROM postings)"


@_query(f"""
    SELECT lower(substr(p, 2 * i + 1, 6)) AS trigram, document_id, stream_id, i - 2 AS position
    FROM (SELECT document_id, stream_id, p, unnest(range(CAST(length(p) / 2 AS BIGINT) - 2)) AS i FROM (SELECT document_id, stream_id, 'FFFF' || h || 'FFFF' AS p FROM {_HEX} AS t) AS u) AS v""")
def trigram_extract(spark, sf):
    return trigram.postings(_texts(spark, sf), "text")


@_query(f"""
    SELECT trigram, count(*) AS n_postings, count(DISTINCT (stream_id, document_id)) AS n_documents, CAST(ceil(count(*) / 1024.0) AS BIGINT) AS n_blocks
    FROM {_POSTED} AS t GROUP BY trigram""")
def trigram_dictionary(spark, sf):
    index = table(spark, sf, "postings").withColumn("trigram", F.lower("trigram")).distinct()
    return trigram.dictionary(index)


@_query(f"SELECT trigram, document_id, stream_id, position FROM {_POSTED} AS t WHERE trigram = '726574'")
def trigram_postings(spark, sf):
    """Postings of one trigram, each once."""
    return table(spark, sf, "postings").where(F.lower("trigram") == "726574").withColumn("trigram", F.lower("trigram")).distinct()


_STORED: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index of all texts, written once for each application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = kept(spark, "trigram")
        trigram.stored(trigram.postings(_texts(spark, sf), "text", padded=False), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


@_query(f"""
    SELECT lower(substr(h, 2 * i + 1, 6)) AS trigram, count(*) AS n FROM (SELECT h, unnest(range(CAST(length(h) / 2 AS BIGINT) - 2)) AS i FROM {_HEX} AS t) AS v GROUP BY 1""")
def trigram_store(spark, sf):
    """The index written and read again: postings of each trigram."""
    return _index(spark, sf).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))


@_query(_occurrences("the lease"))
def trigram_search(spark, sf):
    return trigram.search(_index(spark, sf), "the lease")


@_query(_occurrences("0000"))
def trigram_search_repeat(spark, sf):
    return trigram.search(_index(spark, sf), "0000")


@_query(_occurrences("più"))
def trigram_search_utf8(spark, sf):
    return trigram.search(_index(spark, sf), "più")


@_query(_occurrences("we"))
def trigram_search_short(spark, sf):
    return trigram.scan_search(_texts(spark, sf), "text", "we")


@_query("SELECT coalesce(stream_id, 0) AS stream_id, doc_id AS document_id FROM documents WHERE contains(text, 'Checksum')")
def trigram_indexed_query(spark, sf):
    """Index stored in the shared folder, searched, documents fetched by semi-join."""
    return trigram.indexed_query(_index(spark, sf), _texts(spark, sf), "text", "Checksum").select("stream_id", "document_id")


@_query(_occurrences("cursor "))
def trigram_multi_segment(spark, sf):
    """Two overlapping segments: what both hold is found once."""
    texts = _texts(spark, sf)
    wanted = [t for _, t in trigram.pieces_of("cursor ")]
    parts = [trigram.postings(texts.where(c), "text", padded=False, only=wanted) for c in ("document_id % 3 < 2", "document_id % 3 > 0")]
    return trigram.search_segments(parts, "cursor ")


def _bitmaps(spark, sf) -> tuple[DataFrame, DataFrame]:
    index = table(spark, sf, "postings").select(F.lower("trigram").alias("trigram"), "stream_id", "document_id").distinct()
    numbers = written(trigram.document_numbers(index), "numbers")
    return trigram.bitmaps(index.join(numbers, ["stream_id", "document_id"]), F.col("no")), numbers


@_query("SELECT trigram, count(*) AS n FROM (SELECT DISTINCT lower(trigram) AS trigram, stream_id, document_id FROM postings) AS t GROUP BY 1")
def trigram_bitmaps(spark, sf):
    """Posting lists as bitmaps of dense document numbers, counted back per trigram."""
    return _bitmaps(spark, sf)[0].groupBy("trigram").agg(F.sum("n").alias("n"))


_HELD = "SELECT stream_id, document_id FROM (SELECT DISTINCT lower(trigram) AS trigram, stream_id, document_id FROM postings) AS t WHERE trigram IN ('726574', '657472', '747279') GROUP BY 1, 2"


@_query(f"{_HELD} HAVING count(*) = 3")
def trigram_bitmap_and(spark, sf):
    """Documents that hold every trigram of 'retry', by the bitmaps alone."""
    bits, numbers = _bitmaps(spark, sf)
    return numbers.join(trigram.documents_of(bits, ["726574", "657472", "747279"]), "no").select("stream_id", "document_id")


@_query(_HELD)
def trigram_bitmap_or(spark, sf):
    bits, numbers = _bitmaps(spark, sf)
    return numbers.join(trigram.documents_of(bits, ["726574", "657472", "747279"], every=False), "no").select("stream_id", "document_id")


@_query(f"SELECT a.stream_id, a.document_id, a.position FROM {_POSTED} AS a JOIN {_POSTED} AS b ON a.stream_id = b.stream_id AND a.document_id = b.document_id AND b.position = a.position + 1 WHERE a.trigram = '726574' AND b.trigram = '657472'")
def trigram_timed_search(spark, sf):
    """Occurrences of 'retr', searched only in the days in which both trigrams occur."""
    index = table(spark, sf, "postings").withColumn("trigram", F.lower("trigram"))
    return trigram.timed_search(index, trigram.time_rollup(index, "day"), "retr", "day")


@_query("SELECT lower(trigram) AS trigram, date_trunc('day', make_timestamp((document_id >> 20) * 1000)) AS bucket, count(DISTINCT (stream_id, document_id)) AS n_documents FROM postings GROUP BY 1, 2")
def trigram_time_rollup(spark, sf):
    index = table(spark, sf, "postings").withColumn("trigram", F.lower("trigram"))
    return trigram.time_rollup(index, "day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@_query("SELECT stream_id, count(DISTINCT document_id) AS n_documents, min(document_id) AS first_id, max(document_id) AS last_id FROM postings GROUP BY stream_id")
def matches_by_stream(spark, sf):
    docs = table(spark, sf, "postings").groupBy("stream_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("document_id").alias("first_id"), F.max("document_id").alias("last_id"))


# --- codecs

_BLOCKED = f"(SELECT rec_no, stream_id, ts, (row_number() OVER (PARTITION BY stream_id ORDER BY rec_no) - 1) // 1000 AS block_no FROM {_LOGS} AS t WHERE ts IS NOT NULL)"


def _blocks(spark, sf) -> DataFrame:
    rows = query.logs(_wal(spark, sf)).where("ts is not null").select("stream_id", "rec_no", "ts")
    placed = skew.pieces(rows, "stream_id", ["rec_no"], "codec")
    return skew.numbered(placed, "stream_id", ["rec_no"], codecs.ARCHIVE_BLOCK).select("rec_no", "stream_id", "ts", F.col(skew.CHUNK).alias("block_no"))


@_query(f"SELECT rec_no, ts - 2 * lag(ts, 1, 0) OVER w + lag(ts, 2, 0) OVER w AS dod FROM {_BLOCKED} AS b WINDOW w AS (PARTITION BY stream_id, block_no ORDER BY rec_no)")
def delta_of_delta(spark, sf):
    return codecs.delta_of_delta(_blocks(spark, sf), ["stream_id", "block_no"], ["rec_no"], "ts").select("rec_no", "dod")


@_query(f"SELECT rec_no, ts AS value FROM {_BLOCKED} AS b")
def delta_of_delta_decode(spark, sf):
    coded = codecs.delta_of_delta(_blocks(spark, sf), ["stream_id", "block_no"], ["rec_no"], "ts").drop("ts")
    return codecs.delta_of_delta_decode(coded, ["stream_id", "block_no"], ["rec_no"]).select("rec_no", "value")


_POST_BLOCK = f"(SELECT *, (row_number() OVER (PARTITION BY trigram ORDER BY document_id, stream_id, position) - 1) // 1024 AS block_no FROM {_POSTED} AS t)"


_TUPLE = ["document_id", "stream_id", "position"]


def _second(c: str) -> str:
    """Second difference of a column in 128 bits, brought back into 64 as two's complement does."""
    wide = lambda x: f"CAST({x} AS HUGEINT)"
    raw = f"({wide(c)} - 2 * {wide(f'lag({c}, 1, 0) OVER w')} + {wide(f'lag({c}, 2, 0) OVER w')})"
    return f"CAST((({raw} % 18446744073709551616 + 18446744073709551616 + 9223372036854775808) % 18446744073709551616) - 9223372036854775808 AS BIGINT) AS dod_{c}"


def _posting_blocks(spark, sf) -> DataFrame:
    index = table(spark, sf, "postings").withColumn("trigram", F.lower("trigram")).distinct()
    placed = skew.pieces(index, "trigram", _TUPLE, "posting-blocks")
    return skew.numbered(placed, "trigram", _TUPLE, codecs.POSTING_BLOCK).withColumnRenamed(skew.CHUNK, "block_no")


@_query(f"SELECT trigram, document_id, stream_id, position, {', '.join(map(_second, _TUPLE))} FROM {_POST_BLOCK} AS b WINDOW w AS (PARTITION BY trigram, block_no ORDER BY document_id, stream_id, position)")
def posting_delta(spark, sf):
    """Posting tuples coded per component inside blocks of 1024."""
    coded = codecs.tuple_delta(_posting_blocks(spark, sf), ["trigram", "block_no"], _TUPLE, _TUPLE)
    return coded.select("trigram", *_TUPLE, *[f"dod_{c}" for c in _TUPLE])


@_query(f"SELECT trigram, document_id, stream_id, position FROM {_POSTED} AS t")
def posting_delta_decode(spark, sf):
    """Postings out of their codes."""
    coded = codecs.tuple_delta(_posting_blocks(spark, sf), ["trigram", "block_no"], _TUPLE, _TUPLE).drop(*_TUPLE)
    return codecs.tuple_delta_decode(coded, ["trigram", "block_no"], skew.ROW, _TUPLE).select("trigram", *_TUPLE)


@_query("SELECT event_id // 8 AS byte_no, CAST(sum(CASE WHEN value > 5 THEN 1 << (event_id % 8) ELSE 0 END) AS INT) AS bits, count(*) AS n_bits FROM events GROUP BY 1")
def bit_pack(spark, sf):
    return codecs.bit_pack(table(spark, sf, "events"), F.col("event_id"), F.col("value") > 5)


@_query("SELECT event_id AS number, value > 5 AS flag FROM events")
def bit_unpack(spark, sf):
    return codecs.bit_unpack(codecs.bit_pack(table(spark, sf, "events"), F.col("event_id"), F.col("value") > 5))


@_query("SELECT event_id, CAST(ceil(length(ltrim(bin(CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END), '0')) / 7.0) AS INT) AS n_bytes FROM (SELECT event_id, (event_id - 5000) * 1000003 + 1 AS v FROM events) AS t")
def varint_size(spark, sf):
    return table(spark, sf, "events").select("event_id", codecs.varint_size((F.col("event_id") - 5000) * 1000003 + 1).alias("n_bytes"))


@_query("""
    SELECT event_id, array_to_string(list_transform(range(n), lambda i: printf('%02X', CAST(((z >> CAST(7 * i AS INT)) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END AS INT))), '') AS bytes
    FROM (SELECT event_id, z, CAST(ceil(length(ltrim(bin(z), '0')) / 7.0) AS BIGINT) AS n FROM (SELECT event_id, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS z FROM (SELECT event_id, (event_id - 5000) * 1000003 + 1 AS v FROM events) AS t) AS u) AS w""")
def varint_bytes(spark, sf):
    return table(spark, sf, "events").select("event_id", F.hex(codecs.varint_bytes((F.col("event_id") - 5000) * 1000003 + 1)).alias("bytes"))


@_query("""
    SELECT block_no, printf('%02X', CAST(n AS INT)) || array_to_string(list_transform(range(CAST(ceil(n / 8.0) AS BIGINT)), lambda i: printf('%02X', CAST(list_sum(list_transform(range(8), lambda k: CASE WHEN coalesce(f[8 * i + k + 1], false) THEN 1 << CAST(k AS INT) ELSE 0 END)) AS INT))), '') AS bytes
    FROM (SELECT event_id // 100 AS block_no, list(value > 5 ORDER BY event_id) AS f, count(*) AS n FROM events GROUP BY 1) AS t""")
def bit_pack_bytes(spark, sf):
    """Flags of blocks of 100 as bytes, with their number first."""
    each = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("block_no")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 5).alias("f")))).alias("e"))
    return each.select("block_no", F.hex(codecs.bit_pack_bytes(F.transform("e", lambda e: e["f"]))).alias("bytes"))


@_query(f"SELECT rec_no, coalesce(CASE WHEN json_valid(d) THEN 'read' END, 'line is no record') AS said, CASE WHEN json_valid(d) THEN length(d) ELSE 0 END AS n FROM wal_records WHERE d IS NOT NULL")
def result_columns(spark, sf):
    """Documents as results: what is read, and what is said of the others."""
    doc = F.try_parse_json("d")
    rows = _wal(spark, sf).where("d is not null").select("rec_no", F.when(doc.isNotNull(), F.length("d").cast("bigint")).alias("value"), F.when(doc.isNull(), F.lit(wal.RECORD_ERROR)).alias("error"))
    value, error = F.col("value"), F.col("error")
    return rows.select("rec_no", results.unwrap_or(F.lit("read"), error, error).alias("said"), results.unwrap_or(value, error, F.lit(0)).alias("n"))


@_query()
def compression_ratio(spark, sf):
    """Bytes of the documents as text and as a stored archive, and the share of the latter in percent."""
    documents = _wal(spark, sf)
    path = scratch(spark, "ratio")
    columns = [(r["col_key"], r["col_type"]) for r in archive.infer_columns(documents, []).collect()]
    docs = documents.withColumn("doc", F.try_parse_json("d")).where("doc is not null").withColumn("_id", F.col("rec_no"))
    archive.projected(docs, columns, ["_id", "stream_id"]).repartitionByRange("stream_id", "_id").sortWithinPartitions("stream_id", "_id").write.option("compression", "zstd").parquet(path)
    stored = blobs.listed(spark, path, ".parquet").agg(F.sum("size_bytes").alias("stored_bytes"))
    raw = documents.agg(F.sum(F.octet_length("d")).alias("raw_bytes"))
    both = raw.withColumn("k", F.lit(1)).join(stored.withColumn("k", F.lit(1)), "k")
    return both.select("raw_bytes", "stored_bytes", (100 * F.col("stored_bytes") / F.col("raw_bytes")).alias("percent"))


@_query("SELECT stream_id, sum(strlen(d)) AS raw_bytes, count(*) AS n_rows FROM wal_records GROUP BY stream_id")
def size_by_stream(spark, sf):
    return _wal(spark, sf).groupBy("stream_id").agg(F.sum(F.octet_length("d")).alias("raw_bytes"), F.count(F.lit(1)).alias("n_rows"))


# --- queue (Q1 to Q11, O5, O6) and objects

FILES = """(SELECT regexp_extract(obj_key, '([^/]+?)(?:\\.json)?$', 1) AS file_id, coalesce(nullif(json_extract_string(raw, '$.status'), ''), 'active') AS status,
    CAST(json_extract(raw, '$.jobs') AS JSON[]) AS jobs, raw FROM blob_objects WHERE obj_key LIKE 'queue/%' AND json_valid(raw))"""
JOBS = f"(SELECT file_id, f.status AS file_status, len(jobs) AS n_jobs, unnest(range(len(jobs))) AS job_no, unnest(jobs) AS j FROM {FILES} AS f)"
JOB = f"""(SELECT file_id, file_status, n_jobs, CAST(job_no AS INT) AS job_no, json_extract_string(j, '$.id') AS id, coalesce(nullif(json_extract_string(j, '$.status'), ''), 'pending') AS status,
    CAST(substr(json_extract_string(j, '$.lockedUntil'), 1, 26) AS TIMESTAMP) AS until FROM {JOBS} AS q)"""
FREE = f"(status = 'pending' OR status = 'in_progress' AND coalesce(until <= TIMESTAMP '{NOW}', false))"


def _snapshot(spark, sf) -> DataFrame:
    return queue.decode(table(spark, sf, "blob_objects").where(F.col("obj_key").startswith("queue/")))


def _now():
    return F.lit(NOW).cast("timestamp")


@_query(f"SELECT file_id, status, len(jobs) AS n_jobs FROM {FILES} AS f")
def queue_files(spark, sf):
    return _snapshot(spark, sf).select("file_id", "status", F.size("jobs").cast("bigint").alias("n_jobs"))


@_query(f"SELECT file_id, min(job_no) AS job_no, arg_min(id, job_no) AS id FROM {JOB} AS j WHERE file_status = 'active' AND {FREE} GROUP BY file_id")
def queue_claimable(spark, sf):
    return queue.claimable(_snapshot(spark, sf), _now())


@_query(f"SELECT file_id, id, until AS locked_until FROM {JOB} AS j WHERE until <= TIMESTAMP '{NOW}'")
def queue_expired(spark, sf):
    jobs = _snapshot(spark, sf).select("file_id", F.explode("jobs").alias("j"))
    return jobs.where(queue.expired(F.col("j.locked_until"), _now())).select("file_id", "j.id", F.col("j.locked_until").cast("timestamp_ntz").alias("locked_until"))


@_query(f"""
    SELECT file_id, job_no, id, job_no < n_jobs // 2 AS to_new
    FROM (SELECT *, bool_and(status = 'pending') OVER (PARTITION BY file_id) AS idle FROM {JOB} AS j) AS t WHERE idle AND n_jobs >= 2""")
def queue_split(spark, sf):
    """How the files with waiting jobs only would be split."""
    files = _snapshot(spark, sf).withColumn("status", F.lit(queue.PREPARING))
    return queue.split(files, F.lit("new")).select("file_id", "job_no", "id", "to_new")


@_query(f"""
    SELECT file_id, n_jobs FROM (SELECT file_id, CAST(len(jobs) AS INT) AS n_jobs FROM {FILES} AS f WHERE status IN ('active', 'preparing_split')) AS t
    ORDER BY n_jobs < 32, file_id LIMIT 1""")
def queue_place(spark, sf):
    return queue.place(_snapshot(spark, sf))


@_query("""
    SELECT file_id, file_status, split_into, split_from, job_no, id, status, until AS locked_until, json_extract_string(j, '$.payload.op') AS op, json_extract_string(j, '$.payload.src') AS src, json_extract_string(j, '$.payload.note') AS note
    FROM (SELECT file_id, status AS file_status, split_into, split_from, CAST(unnest(range(len(jobs))) AS INT) AS job_no, unnest(jobs) AS j FROM (
              SELECT *, json_extract_string(raw, '$.splitInto') AS split_into, json_extract_string(raw, '$.splitFrom') AS split_from FROM """ + FILES + """ AS f) AS g) AS q,
         LATERAL (SELECT json_extract_string(j, '$.id') AS id, coalesce(nullif(json_extract_string(j, '$.status'), ''), 'pending') AS status, CAST(substr(json_extract_string(j, '$.lockedUntil'), 1, 26) AS TIMESTAMP) AS until) AS x""")
def queue_roundtrip(spark, sf):
    """Files written as JSON and read again, with every field of their jobs."""
    again = queue.decode(queue.encode(_snapshot(spark, sf)), "file_id", "raw")
    jobs = again.select("file_id", F.col("status").alias("file_status"), "split_into", "split_from", F.posexplode("jobs").alias("job_no", "j"))
    told = lambda k: F.get_json_object("j.payload", f"$.{k}").alias(k)
    return jobs.select("file_id", "file_status", "split_into", "split_from", "job_no", "j.id", "j.status", F.col("j.locked_until").cast("timestamp_ntz").alias("locked_until"), told("op"), told("src"), told("note"))


@_query("SELECT obj_key, substr(hex(encode(raw)), 5, 16) AS part FROM blob_objects WHERE strlen(raw) >= 10")
def blob_range(spark, sf):
    """Bytes 2 to 9 of each object that has them."""
    rows = table(spark, sf, "blob_objects").where(F.octet_length("raw") >= 10)
    return rows.select("obj_key", F.hex(blobs.byte_range(F.encode("raw", "UTF-8"), 2, 9)).alias("part"))


@_query("SELECT split_part(obj_key, '/', 1) AS prefix, count(*) AS n_objects, sum(strlen(raw)) AS n_bytes FROM blob_objects GROUP BY 1")
def blob_list(spark, sf):
    rows = table(spark, sf, "blob_objects")
    return rows.groupBy(F.split_part("obj_key", F.lit("/"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n_objects"), F.sum(F.octet_length("raw")).alias("n_bytes"))


# --- streaming


@_query(f"SELECT msg, ts FROM {_LOGS} AS t WHERE {_LABELLED} AND contains(msg, 'retry')")
def stream_tail(spark, sf):
    """A log written as files and tailed by a streaming query."""
    path, out = scratch(spark, "tail-wal"), scratch(spark, "tail-found")
    wal.append(_wal(spark, sf).withColumn("d", F.try_parse_json("d")).where("d is not null"), path)
    ingest.drained(ingest.tail(spark, path, LABELS, TEXT, out, scratch(spark, "tail-state")))
    return spark.read.schema(ingest.TAILED).parquet(out).select("msg", "ts")


@_query(f"SELECT stream_id, count(*) AS n, count(DISTINCT msg) AS n_messages FROM {_LOGS} AS t WHERE msg IS NOT NULL GROUP BY stream_id")
def stream_compaction(spark, sf):
    """A log moved into archives by micro-batches, then read."""
    path, target = scratch(spark, "compact-wal"), scratch(spark, "compact-archive")
    wal.append(_wal(spark, sf).withColumn("d", F.try_parse_json("d")).where("d is not null"), path)
    ingest.drained(ingest.compaction(spark, path, target, scratch(spark, "compact-state")))
    return ingest.archived(spark, target).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msg").alias("n_messages"))


@_query(f"SELECT stream_id, rec_no AS seq, (ts << 20) | (row_number() OVER (PARTITION BY stream_id ORDER BY ts, rec_no) % 1048576) AS document_id FROM {_LOGS} AS t WHERE ts IS NOT NULL")
def stream_ids(spark, sf):
    """Ids given by the stateful streaming counter."""
    path, out = scratch(spark, "ids-in"), scratch(spark, "ids-out")
    rows = query.logs(_wal(spark, sf)).where("ts is not null").select("stream_id", F.col("rec_no").alias("seq"), "ts")
    rows.write.parquet(path)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = spark.readStream.schema(rows.schema).parquet(path)
        ingest.drained(with_stream_ids(seen).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ids-state")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema("stream_id bigint, seq bigint, document_id bigint").parquet(out)


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Daily counts by a watermarked streaming aggregation."""
    name = f"windows_{abs(hash(sf)) % 10**8}"
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = ingest.windowed(source.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 hour", "1 day", ["event_type"])
    ingest.drained(counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "windows-state")))
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
