"""Streams of log records: append to the log, tail it, compact it into archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.labels import labels_match, stream_id
from ..operators.query import holds, logs, message, timestamp_ms, validated
from ..sources import wal

#: A batch of records is made durable at least this often.
FLUSH = "1 second"
#: Log objects that a compaction takes at once at most.
COMPACT_FILES = 1000


def read_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of the log as they are committed: only complete objects are seen."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").schema("value string")
    return wal.decode((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))


def append_stream(documents: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes valid documents (l, doc) to the log, each batch one commit: a group acknowledgement.

    Repeated batches write nothing twice: the file sink's log names what belongs to each batch.
    """
    good = validated(documents).where("error is null")
    lines = good.select(wal.record_line(F.col("l"), F.col("doc")).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=FLUSH)


TAILED = "labels string, msg string, ts bigint"


def tail(spark: SparkSession, path: str, labels: dict[str, str], text: str, out: str, checkpoint: str) -> DataStreamWriter:
    """New records of a label set with a text, as they arrive, written to files below ``out``.

    For a screen, take the records from ``tailed`` to a console or memory sink instead.
    """
    return tailed(spark, path, labels, text).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def tailed(spark: SparkSession, path: str, labels: dict[str, str], text: str) -> DataFrame:
    """(labels, msg, ts) of the records as they arrive."""
    seen = read_records(spark, path).where(F.col("error").isNull() & labels_match(F.col("l"), labels)).withColumns({"msg": message(F.col("d")), "ts": timestamp_ms(F.col("d"))})
    return seen.where(holds(text)).select(F.to_json("l").alias("labels"), "msg", "ts")


def compaction(spark: SparkSession, path: str, archive: str, checkpoint: str) -> DataStreamWriter:
    """Moves log records into the archive, one folder per batch.

    A batch that is run again overwrites its own folder, so a crash between writing and committing
    doubles nothing.
    """

    def move(batch: DataFrame, number: int) -> None:
        rows = batch.where("error is null").select(stream_id(F.col("l")).alias("stream_id"), "l", F.to_json("d").alias("d"))
        rows.repartitionByRange("stream_id", "d").write.mode("overwrite").option("compression", "zstd").parquet(f"{archive}/batch={number}")

    return read_records(spark, path, COMPACT_FILES).writeStream.foreachBatch(move).option("checkpointLocation", checkpoint)


def drained(writer: DataStreamWriter) -> StreamingQuery:
    """Runs a stream over what is there now, and stops."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed(records: DataFrame, at: str, lateness: str, length: str, keys: list[str]) -> DataFrame:
    """Records per time window and keys; rows later than the lateness are left out."""
    return records.withWatermark(at, lateness).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def archived(spark: SparkSession, archive: str) -> DataFrame:
    return logs(spark.read.parquet(archive))
