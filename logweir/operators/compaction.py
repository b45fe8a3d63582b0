"""Far too many small files: consolidate Parquet files by copying their encoded blocks.

Footers are read where the files are, in parallel; files of one schema are packed into bins of a
target size by prefix sums inside bounded groups of files; each bin is written by one task that
copies column blocks byte for byte and writes one footer. Nothing is decoded. Schemas, numbers of
blocks and of rows are compared before and after.

Defined results: an empty folder gives no output file; files without rows are dropped unless all
are empty (one is kept for its schema); files with different schemas go into different outputs;
a file that is no Parquet is an error, never skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from ..sources.blobs import listed
from ..sources.files import open_input, resolve
from ..sources.parquet_blocks import FILE_ROWS, BlockWriter, blocks_of, read_footer, schema_key
from .dedup import BLOCK, file_number, tasks, units

FOOTERS = "path string, size bigint, schema_key string, n_blocks bigint, n_rows bigint"
#: Files whose sizes are summed in one ordered window at most, on average.
GROUP_FILES = 50_000


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per Parquet file below ``folder``, from its footer alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open_input(path) as f:
                    footer = read_footer(f, size)
                rows.append((path, size, hashlib.sha256(schema_key(footer)).hexdigest()[:16], len(blocks_of(footer)), footer[FILE_ROWS][1]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    names=["path", "size", "schema_key", "n_blocks", "n_rows"],
                )

    files = listed(spark, folder, ".parquet").select(F.col("key").alias("path"), F.col("size_bytes").alias("length"))
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, FOOTERS)


def plan_bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """Adds the bin of each file: consecutive files of a schema until the target size is reached."""
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).collect()[0]
    groups = max(1, min(-(-total["n"] // GROUP_FILES), -(-total["b"] // target_bytes)))
    part = F.pmod(F.xxhash64("path"), F.lit(groups))
    running = F.sum("size").over(Window.partitionBy("schema_key", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("part", part).withColumn("bin", F.floor(F.coalesce(running, F.lit(0)) / F.lit(target_bytes)))


def copy_blocks(spark: SparkSession, folder: str, out: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Consolidates the Parquet files of ``folder`` into ``out``; gives one row per written file.

    A repeated or lost task writes the same bytes under the same name: it writes beside and
    renames. Raises if blocks or rows were lost or doubled.
    """
    small = written(footers(spark, folder), "footers")
    keep = small.where("n_rows > 0")
    if keep.isEmpty():
        keep = small.orderBy("path").limit(1)
    system, base = resolve(out)
    system.create_dir(base, recursive=True)

    def merge(key: tuple, files: pa.Table) -> pa.Table:
        system, base = resolve(out)
        schema, part, bin_no = (k.as_py() for k in key)
        name = f"{base}/part-{schema}-{part:06d}-{bin_no:06d}.parquet"
        beside = f"{base}/_{uuid.uuid4().hex}"
        blocks = 0
        with system.open_output_stream(beside) as sink:
            writer = BlockWriter(sink)
            for path, size in sorted(zip(files.column("path").to_pylist(), files.column("size").to_pylist())):
                with open_input(path) as f:
                    blocks += writer.append(f, size)[0]
            end = writer.close()
        with system.open_input_file(beside) as f:
            footer = read_footer(f, end)
        if (len(blocks_of(footer)), footer[FILE_ROWS][1]) != (blocks, writer.rows):
            raise ValueError(f"{name} doesn't hold what was copied")
        system.move(beside, name)
        return pa.table({"path": [name], "size": [end], "n_files": [len(files)], "n_blocks": [blocks], "n_rows": [writer.rows]})

    done = written(
        plan_bins(keep, target_bytes).groupBy("schema_key", "part", "bin").applyInArrow(merge, "path string, size bigint, n_files bigint, n_blocks bigint, n_rows bigint"),
        "copied",
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_blocks", "n_rows")]
    before, after = keep.agg(*sums).collect()[0], done.agg(*sums).collect()[0]
    if before != after:
        raise ValueError(f"blocks and rows before {before} and after {after}")
    return done


def consolidate(records: DataFrame, name: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Writes ``records`` as each task's small files and gives what the consolidated files hold."""
    spark = records.sparkSession
    small, packed = scratch(spark, f"{name}-small"), scratch(spark, f"{name}-packed")
    records.write.option("compression", "zstd").parquet(small)
    copy_blocks(spark, small, packed, target_bytes)
    return spark.read.schema(records.schema).parquet(packed)


def _wal_keys(record: Column) -> tuple[Column, Column]:
    """Stream and id of a WAL record; both null unless it has both."""
    stream, ident = F.try_variant_get(record, "$.l.stream", "string"), F.try_variant_get(record, "$.d._id", "string")
    known = stream.isNotNull() & ident.rlike(r"^-?\d+$")
    return F.when(known, stream), F.when(known, F.regexp_replace(ident, r"^(-?)0+(?=\d)", "$1"))


def _job_key(job: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_variant_get(job, "$.id", "string"), r"[\s{}-]", ""))


def wal_records(objects: DataFrame) -> DataFrame:
    """Readable lines of WAL objects: (obj_kind, stream_name, rec_key, body, version).

    A line that is no JSON, an empty line and a null object hold no record. A readable line
    without stream or _id is a record without key, told apart by its text alone.
    """
    lines = objects.where(F.col("obj_key").startswith("wal/")).select("obj_key", "modified_at", "spot", F.posexplode(F.split("raw", "\r?\n")).alias("line", "body"))
    read = lines.where(F.trim("body") != "").withColumn("v", F.try_parse_json("body")).where("v is not null")
    stream, key = _wal_keys(F.col("v"))
    return read.select(
        F.lit("wal").alias("obj_kind"),
        stream.alias("stream_name"),
        key.alias("rec_key"),
        "body",
        F.struct("modified_at", "obj_key", "line", "spot").alias("version"),
    )


def queue_records(objects: DataFrame) -> DataFrame:
    """Jobs of queue files, as ``wal_records``; a file that is no JSON holds none."""
    files = objects.where(F.col("obj_key").startswith("queue/")).select("obj_key", "modified_at", "spot", F.try_parse_json("raw").alias("v"))
    jobs = F.try_variant_get("v", "$.jobs", "array<variant>")
    each = files.select("obj_key", "modified_at", "spot", F.posexplode(jobs).alias("line", "job"))
    return each.select(
        F.lit("queue").alias("obj_kind"),
        F.lit("").alias("stream_name"),
        _job_key(F.col("job")).alias("rec_key"),
        F.to_json("job").alias("body"),
        F.struct("modified_at", "obj_key", "line", "spot").alias("version"),
    )


def winners(records: DataFrame) -> DataFrame:
    """Each record once, as last written, by its place: (spot, line).

    Bodies stay where they are: a record without key is told apart by a 256-bit hash of its text.
    Combined before the shuffle, so copies stay local.
    """
    keyless = F.when(F.col("rec_key").isNull(), F.sha2("body", 256))
    best = records.groupBy("obj_kind", "stream_name", "rec_key", keyless.alias("text_hash")).agg(F.max("version").alias("best"))
    return best.select("best.spot", "best.line")


def _bodies(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The winning records with their bodies: each task reads one row group with the places of its winners."""
    block = F.floor(F.col("spot.row") / BLOCK)
    places = found.select(F.col("spot.file").alias("file"), block.alias("block"), F.struct(F.col("spot.row").alias("row"), "line").alias("at"))
    lists = places.groupBy("file", "block").agg(F.collect_list("at").alias("at"))
    work = units(spark, path).join(lists, ["file", "block"]).groupBy("path", "row_group", "first", "n").agg(F.flatten(F.collect_list("at")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import re

        import pyarrow.parquet as pq

        for batch in batches:
            for unit in batch.to_pylist():
                first, by_row = unit["first"], {}
                for a in unit["at"]:
                    if first <= a["row"] < first + unit["n"]:
                        by_row.setdefault(a["row"] - first, []).append(a["line"])
                with open_input(unit["path"]) as f:
                    at = 0
                    for part in pq.ParquetFile(f).iter_batches(batch_size=1024, row_groups=[unit["row_group"]], columns=["obj_key", "raw"]):
                        out = []
                        for i in range(len(part)):
                            wanted = by_row.get(at + i)
                            if not wanted:
                                continue
                            key, raw = part.column("obj_key")[i].as_py(), part.column("raw")[i].as_py()
                            jobs = key.startswith("queue/")
                            parts = json.loads(raw)["jobs"] if jobs else re.split("\r?\n", raw)
                            out += [(json.dumps(parts[n], ensure_ascii=False, separators=(",", ":")) if jobs else parts[n], key, n) for n in wanted]
                        at += len(part)
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int32()))], names=["body", "obj_key", "line"])

    bodies = work.repartition(tasks(spark), "path", "row_group").mapInArrow(read, "body string, obj_key string, line int").withColumn("v", F.parse_json("body"))
    job, (stream, key) = F.col("obj_key").startswith("queue/"), _wal_keys(F.col("v"))
    return bodies.select(F.when(job, "queue").otherwise("wal").alias("obj_kind"), F.when(job, "").otherwise(stream).alias("stream_name"), F.when(job, _job_key(F.col("v"))).otherwise(key).alias("rec_key"), "body", "obj_key", "line")


def consolidated_objects(objects: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """As ``consolidated_files``, of objects that are in no Parquet files yet."""
    spark = objects.sparkSession
    path = scratch(spark, "raw")
    objects.select("obj_key", "modified_at", "raw").write.option("compression", "zstd").parquet(path)
    return consolidated_files(spark, path, target_bytes)


def consolidated_files(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> DataFrame:
    """The records of a bucket's small objects (obj_key, modified_at, raw), each exactly once, out of consolidated files.

    Only keys, versions and places are shuffled; bodies are read where they are.
    """
    spot = F.struct(file_number("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    objects = spark.read.parquet(path).select("obj_key", "modified_at", "raw", spot.alias("spot"))
    found = written(winners(wal_records(objects).unionAll(queue_records(objects))), "winners")
    return consolidate(_bodies(spark, path, found), "objects", target_bytes)
