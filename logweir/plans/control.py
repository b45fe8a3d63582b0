"""Queries of objects on a bucket, of the job queue and of the database at work. Each has its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..db import LogDB
from ..functions.ids import id_ms
from ..operators import jobqueue, queue
from ..operators.query import message, timestamp_ms
from ..session import scratch, table
from ..sources import blobs, wal
from ..streaming import ingest
from .core import FILES, FREE, JOB, NOW, WIDER, queries_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
_query = queries_of(QUERIES, SQL)

LEASE = 60


def _clock() -> datetime:
    return datetime.fromisoformat(NOW).replace(tzinfo=timezone.utc)


def _stored(spark: SparkSession, sf: str, change: Callable[[jobqueue.JobQueue], None]) -> tuple[DataFrame, list[str]]:
    """The snapshot of the queue files of the bucket after ``change``, and the files there were before."""
    uri = scratch(spark, "bucket")
    objects = table(spark, sf, "blob_objects").where(F.col("obj_key").startswith("queue/") & F.try_parse_json("raw").isNotNull())
    blobs.store(objects, uri, "obj_key", "raw")
    jobs = jobqueue.JobQueue(blobs.Bucket(uri, spark), "queue", _clock, lambda s: None)
    before = jobs.file_ids()
    change(jobs)
    stored = blobs.objects(spark, f"{uri}/queue", "*.json", content=True).select("key", F.decode("content", "UTF-8").alias("raw"))
    return queue.decode(stored, "key"), before


def _jobs(files: DataFrame) -> DataFrame:
    each = files.select("file_id", F.posexplode("jobs").alias("job_no", "j"))
    return each.select("file_id", "job_no", "j.id", "j.status", F.col("j.locked_until").cast("timestamp_ntz").alias("locked_until"))


@_query("SELECT split_part(obj_key, '/', 1) AS prefix, count(*) AS n_objects, sum(strlen(raw)) AS n_bytes FROM blob_objects WHERE raw IS NOT NULL GROUP BY 1")
def blob_list_stored(spark, sf):
    """Objects written to a bucket and listed there."""
    uri = scratch(spark, "bucket")
    blobs.store(table(spark, sf, "blob_objects"), uri, "obj_key", "raw")
    listed = blobs.listed(spark, uri)
    return listed.groupBy(F.regexp_extract("key", r"/bucket-[0-9a-f]+/([^/]+)", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n_objects"), F.sum("size_bytes").alias("n_bytes"))


@_query(f"SELECT file_id, CAST(min(job_no) AS INT) AS job_no, arg_min(id, job_no) AS id FROM {JOB} AS j WHERE file_status = 'active' AND {FREE} GROUP BY file_id")
def queue_pull(spark, sf):
    """The job that a pull leases of each file."""

    def pull(jobs):
        for f in jobs.file_ids():
            jobs.pull_from(f, LEASE)

    until = F.lit(_clock() + timedelta(seconds=LEASE)).cast("timestamp_ntz")
    return _jobs(_stored(spark, sf, pull)[0]).where(F.col("locked_until") == until).select("file_id", "job_no", "id")


@_query(f"SELECT file_id, job_no, id, CASE WHEN status = 'in_progress' THEN TIMESTAMP '{NOW}' + INTERVAL {LEASE} SECOND ELSE until END AS locked_until FROM {JOB} AS j")
def queue_extend(spark, sf):
    """Every job after those in progress were leased anew."""

    def extend(jobs):
        for f in jobs.file_ids():
            for job in jobs.read(f)[0]["jobs"]:
                if job["status"] == queue.RUNNING:
                    jobs.extend(jobqueue.Item(f, job["id"], None), LEASE)

    return _jobs(_stored(spark, sf, extend)[0]).select("file_id", "job_no", "id", "locked_until")


@_query(f"SELECT file_id, id FROM {JOB} AS j WHERE job_no > 0")
def queue_remove(spark, sf):
    """What is left when the first job of each file is done; files of one job are gone."""

    def remove(jobs):
        for f in jobs.file_ids():
            if state := jobs.read(f)[0]["jobs"]:
                jobs.remove(jobqueue.Item(f, state[0]["id"], None))

    return _jobs(_stored(spark, sf, remove)[0]).select("file_id", "id")


@_query(f"""SELECT file_id, len(jobs) + CASE WHEN file_id = (SELECT min(file_id) FROM {FILES} AS g WHERE status IN ('active', 'preparing_split')) THEN 80 ELSE 0 END AS n_jobs FROM {FILES} AS f""")
def queue_push(spark, sf):
    """Jobs per file after two pushes, of which the second goes where the first went."""

    def push(jobs):
        for _ in range(2):
            jobs.push([{"op": "test"}] * 40)

    return _stored(spark, sf, push)[0].select("file_id", F.size("jobs").cast("bigint").alias("n_jobs"))


_HALVES = f"""
    SELECT file_id AS origin, id, job_no < n_jobs // 2 AS moved
    FROM (SELECT *, bool_and(status = 'pending') OVER (PARTITION BY file_id) AS idle FROM {JOB} AS j WHERE file_status = 'active') AS t WHERE idle AND n_jobs >= 2"""


def _halves(spark, sf, begin: Callable[[jobqueue.JobQueue, str], str]) -> DataFrame:
    """(origin, id, moved): the jobs of all active files that can be split, after they were. ``begin`` gives the new file."""
    pairs: list[tuple[str, str, bool]] = []

    def run(jobs):
        for f in jobs.file_ids():
            state = jobs.read(f)[0]
            if state["status"] == queue.ACTIVE and len(state["jobs"]) >= 2 and all(j["status"] == queue.PENDING for j in state["jobs"]):
                pairs.extend([(f, f, False), (begin(jobs, f), f, True)])

    files, _ = _stored(spark, sf, run)
    of = spark.createDataFrame(pairs, "file_id string, origin string, moved boolean")
    return _jobs(files).join(of, "file_id").select("origin", "id", "moved")


@_query(_HALVES)
def queue_split_stored(spark, sf):
    """Files split on the bucket: the first half of the jobs is in the new file."""

    def begin(jobs, f):
        jobs.change(f, lambda s: s | {"status": queue.PREPARING})
        if (into := jobs.split(f)) is None:
            raise RuntimeError(f"{f} was not split")
        return into

    return _halves(spark, sf, begin)


@_query(_HALVES)
def queue_recover(spark, sf):
    """As ``queue_split_stored``, by whoever finds a split that was left after its file was locked."""

    def begin(jobs, f):
        into = jobqueue.new_id()
        jobs.change(f, lambda s: s | {"status": queue.SPLITTING, "splitInto": into, "lockedUntil": NOW.replace(" ", "T") + "Z"})
        jobs.settled(f)
        return into

    return _halves(spark, sf, begin)


_VALID = """json_valid(d) AND json_type(d, '$.msg') = 'VARCHAR' AND json_type(d, '$.ts') IN ('BIGINT', 'UBIGINT') AND json_type(d, '$._id') IS NULL"""
_DOCUMENTS = f"(SELECT rec_no, stream_id, d, json_extract_string(d, '$.msg') AS msg, CAST(json_extract_string(d, '$.ts') AS BIGINT) AS ts FROM wal_records WHERE {_VALID})"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wal_records").select("l", F.try_parse_json("d").alias("doc")).where("doc is not null")


def _database(spark: SparkSession, sf: str) -> LogDB:
    db = LogDB(spark, scratch(spark, "db"))
    db.add_documents(_documents(spark, sf))
    db.compact()
    return db


@_query(f"SELECT stream_id, ts, msg FROM {_DOCUMENTS} AS t")
def db_archive(spark, sf):
    """Documents of the log after they were moved into the archive, with the time of their ids."""
    return _database(spark, sf).archive.read().select("stream_id", id_ms(F.col("_id")).alias("ts"), "msg")


@_query(f"""SELECT key AS col_key, {WIDER} AS col_type FROM (
    SELECT key, CASE t WHEN 'BIGINT' THEN 'int64' WHEN 'UBIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' WHEN 'BOOLEAN' THEN 'bool' ELSE 'string' END AS kind
    FROM (SELECT key, json_type(d, '$."' || key || '"') AS t FROM (SELECT d, unnest(json_keys(d)) AS key FROM {_DOCUMENTS} AS e) AS k) AS f WHERE t <> 'NULL' AND key NOT IN ('msg', 'ts')) AS u GROUP BY key""")
def db_columns(spark, sf):
    """Columns of the archive, by the types its segments hold."""
    return _database(spark, sf).columns()


@_query(f"SELECT stream_id, ts, msg FROM {_DOCUMENTS} AS t WHERE contains(msg, 'retry')")
def db_search(spark, sf):
    """Documents that the database's index finds."""
    db = _database(spark, sf)
    db.index()
    return db.search("retry").select("stream_id", id_ms(F.col("_id")).alias("ts"), "msg")


@_query(f"SELECT stream_id, msg FROM {_DOCUMENTS} AS t WHERE ts % 7 = 0")
def db_get(spark, sf):
    """Documents of every seventh millisecond, fetched by stream and id and read from their JSON."""
    db = _database(spark, sf)
    wanted = db.archive.read().where(id_ms(F.col("_id")) % 7 == 0).select("stream_id", "_id")
    return db.get(wanted).select("stream_id", F.get_json_object("document", "$.msg").alias("msg"))


@_query(f"SELECT stream_id, count(*) AS n_documents, max(ts) AS last_ms FROM {_DOCUMENTS} AS t GROUP BY 1")
def recover_last_ids(spark, sf):
    """Where each stream's counter goes on when the database is opened again."""
    return _database(spark, sf).last_ids().select("stream_id", "n_documents", id_ms(F.col("last_id")).alias("last_ms"))


@_query(f"SELECT array_to_string(list_transform(list_sort(map_entries(l)), lambda e: e.key || '=' || e.value), ',') AS label_set, min(stream_id) AS stream_id, count(*) AS n_documents FROM wal_records WHERE {_VALID} GROUP BY 1")
def db_label_sets(spark, sf):
    return _database(spark, sf).label_sets()


@_query(f"SELECT count(*) AS n_rows FROM {_DOCUMENTS} AS t")
def db_directory(spark, sf):
    """Rows that the footers of the archive's files tell."""
    return _database(spark, sf).directory().agg(F.sum("n_rows").alias("n_rows"))


@_query(f"SELECT msg, ts FROM {_DOCUMENTS} AS t")
def stream_append(spark, sf):
    """Documents appended to the log by a stream: only valid ones, each batch whole."""
    source, path = scratch(spark, "append-in"), scratch(spark, "append-wal")
    _documents(spark, sf).select("l", F.to_json("doc").alias("d")).write.parquet(source)
    seen = spark.readStream.schema("l map<string,string>, d string").option("maxFilesPerTrigger", 2).parquet(source)
    ingest.drained(ingest.append_stream(seen.select("l", F.try_parse_json("d").alias("doc")), path, scratch(spark, "append-state")))
    back = wal.scan(spark, path)
    return back.select(message(F.col("d")).alias("msg"), timestamp_ms(F.col("d")).alias("ts"))
