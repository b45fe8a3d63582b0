"""The job queue's files and decisions, as transformations of a snapshot of its files.

A snapshot is a DataFrame (file_id, status, locked_until, split_into, split_from, jobs). What
changes a file gives its new state; storing it is a conditional write of one object
(sources.blobs.Bucket.put_if_match), and who loses the race reads again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a queue file and its states.
MAX_JOBS, SPLIT_SECONDS = 128, 30
ACTIVE, PREPARING, SPLITTING, PENDING, RUNNING = "active", "preparing_split", "splitting", "pending", "in_progress"

JOB = "struct<id string, status string, locked_until timestamp, payload string>"


def _time(text: Column) -> Column:
    """RFC 3339 with up to nine digits; microseconds are kept."""
    return F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp")


def decode(objects: DataFrame, key: str = "obj_key", raw: str = "raw") -> DataFrame:
    """Snapshot of queue files from their JSON; a missing or empty status is active or pending."""
    v = F.try_parse_json(raw)
    text = lambda c, p: F.try_variant_get(c, p, "string")
    jobs = F.transform(
        F.coalesce(F.try_variant_get("_v", "$.jobs", "array<variant>"), F.array().cast("array<variant>")),
        lambda j: F.struct(
            text(j, "$.id").alias("id"),
            F.coalesce(F.nullif(text(j, "$.status"), F.lit("")), F.lit(PENDING)).alias("status"),
            _time(text(j, "$.lockedUntil")).alias("locked_until"),
            F.to_json(F.try_variant_get(j, "$.payload", "variant")).alias("payload"),
        ),
    )
    return objects.withColumn("_v", v).where("_v is not null").select(
        F.regexp_extract(key, r"([^/]+?)(?:\.json)?$", 1).alias("file_id"),
        F.coalesce(F.nullif(text(F.col("_v"), "$.status"), F.lit("")), F.lit(ACTIVE)).alias("status"),
        _time(text(F.col("_v"), "$.lockedUntil")).alias("locked_until"),
        text(F.col("_v"), "$.splitInto").alias("split_into"),
        text(F.col("_v"), "$.splitFrom").alias("split_from"),
        jobs.alias("jobs"),
    )


def encode(files: DataFrame) -> DataFrame:
    """(file_id, raw): files as the JSON that ``decode`` reads."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    jobs = F.transform("jobs", lambda j: F.struct(j["id"].alias("id"), j["status"].alias("status"), stamp(j["locked_until"]).alias("lockedUntil"), F.try_parse_json(j["payload"]).alias("payload")))
    return files.select("file_id", F.to_json(F.struct("status", stamp(F.col("locked_until")).alias("lockedUntil"), F.col("split_into").alias("splitInto"), F.col("split_from").alias("splitFrom"), jobs.alias("jobs"))).alias("raw"))


def expired(locked_until: Column, now: Column) -> Column:
    """A lock ends at its time; what has no lock time is not expired."""
    return F.coalesce(locked_until <= now, F.lit(False))


def claimable(files: DataFrame, now: Column) -> DataFrame:
    """(file_id, job_no, id): of each active file the first job that is pending or whose lease ended."""
    free = F.filter(
        F.transform("jobs", lambda j, i: F.struct(i.alias("job_no"), j["id"].alias("id"), ((j["status"] == PENDING) | (j["status"] == RUNNING) & expired(j["locked_until"], now)).alias("free"))),
        lambda j: j["free"],
    )
    return files.where(F.col("status") == ACTIVE).select("file_id", F.get(free, F.lit(0)).alias("j")).where("j is not null").select("file_id", "j.job_no", "j.id")


def _with_job(files: DataFrame, file_id: str, job_id: str, change) -> DataFrame:
    here = F.col("file_id") == file_id
    return files.withColumn("jobs", F.when(here, F.transform("jobs", lambda j: F.when(j["id"] == job_id, change(j)).otherwise(j))).otherwise(F.col("jobs")))


def claim(files: DataFrame, file_id: str, job_id: str, until: Column) -> DataFrame:
    """The snapshot with a job leased until a time."""
    return _with_job(files, file_id, job_id, lambda j: j.withField("status", F.lit(RUNNING)).withField("locked_until", until))


def extend_claim(files: DataFrame, file_id: str, job_id: str, now: Column, seconds: float) -> DataFrame:
    """Leases a job anew; without a positive duration nothing changes."""
    if seconds <= 0:
        return files
    return claim(files, file_id, job_id, now + F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)")))


def remove(files: DataFrame, file_id: str, job_id: str) -> DataFrame:
    """The snapshot without a job; a file whose last job goes is gone too."""
    here = F.col("file_id") == file_id
    left = files.withColumn("_had", F.size("jobs")).withColumn("jobs", F.when(here, F.filter("jobs", lambda j: j["id"] != job_id)).otherwise(F.col("jobs")))
    return left.where(~(here & (F.col("_had") > 0) & (F.size("jobs") == 0))).drop("_had")


def all_pending(jobs: Column) -> Column:
    return F.forall(jobs, lambda j: j["status"] == PENDING)


def splittable(files: DataFrame) -> DataFrame:
    """Files that are to be split and may be: two jobs or more, all pending."""
    return files.where((F.col("status") == PREPARING) & (F.size("jobs") >= 2) & all_pending(F.col("jobs")))


def split(files: DataFrame, new_id: Column | None = None) -> DataFrame:
    """(old_id, new_id, job, to_new): what each job of splittable files becomes; the first half moves."""
    half = F.floor(F.size("jobs") / 2)
    cut = splittable(files).select("file_id", (new_id if new_id is not None else F.expr("replace(uuid(), '-', '')")).alias("new_id"), half.alias("half"), F.posexplode("jobs").alias("job_no", "job"))
    return cut.select("file_id", "new_id", "job_no", F.col("job.id").alias("id"), (F.col("job_no") < F.col("half")).alias("to_new"))


def split_state(files: DataFrame, now: Column) -> DataFrame:
    """What a reader does about each file: recover an expired split, begin one, or nothing."""
    act = (
        F.when((F.col("status") == SPLITTING) & expired(F.col("locked_until"), now), F.when(F.col("split_into").isNotNull(), "recover_original").when(F.col("split_from").isNotNull(), "recover_target").otherwise("none"))
        .when((F.col("status") == PREPARING) & (F.size("jobs") >= 2) & all_pending(F.col("jobs")), "split")
        .otherwise("none")
    )
    return files.select("file_id", act.alias("action"))


def must_extend_split(locked_until: Column, now: Column) -> Column:
    """Whether a split's lock has passed half of its time."""
    return F.unix_micros(locked_until) - F.unix_micros(now) < SPLIT_SECONDS * 500_000


def finalized(files: DataFrame, file_id: str) -> DataFrame:
    """A split file is active again and forgets its lock and its other half."""
    here = F.col("file_id") == file_id
    out = files.withColumn("status", F.when(here, ACTIVE).otherwise(F.col("status")))
    return out.withColumns({c: F.when(~here, F.col(c)) for c in ("locked_until", "split_into", "split_from")})


def place(files: DataFrame) -> DataFrame:
    """(file_id, n_jobs): where new jobs go; none if there is no open file.

    The first file in order of id with a quarter of MAX_JOBS or more, else the first of all. One
    row per partition reaches the minimum.
    """
    open_files = files.where(F.col("status").isin(ACTIVE, PREPARING)).select("file_id", F.size("jobs").alias("n_jobs"))
    best = open_files.agg(F.min(F.struct((F.col("n_jobs") < MAX_JOBS // 4).alias("low"), "file_id", "n_jobs")).alias("b"))
    return best.where("b is not null").select("b.file_id", "b.n_jobs")


def pushed(files: DataFrame, payloads: list[str], file_id: str | None) -> DataFrame:
    """The snapshot with pending jobs added to a file, or to a new one if ``file_id`` is None."""
    job = lambda p: F.struct(F.lit(uuid.uuid4().hex).alias("id"), F.lit(PENDING).alias("status"), F.lit(None).cast("timestamp").alias("locked_until"), F.lit(p).alias("payload"))
    new = F.array(*[job(p) for p in payloads])
    status = F.when(F.size("jobs") > MAX_JOBS, PREPARING)
    if file_id is None:
        made = files.sparkSession.range(1).select(F.lit(uuid.uuid4().hex).alias("file_id"), F.lit(ACTIVE).alias("status"), F.lit(None).cast("timestamp").alias("locked_until"), F.lit(None).cast("string").alias("split_into"), F.lit(None).cast("string").alias("split_from"), new.alias("jobs"))
        return files.unionByName(made.withColumn("status", F.coalesce(status, "status")))
    here = F.col("file_id") == file_id
    grown = files.withColumn("jobs", F.when(here, F.concat("jobs", new)).otherwise(F.col("jobs")))
    return grown.withColumn("status", F.when(here, F.coalesce(status, "status")).otherwise(F.col("status")))
