"""Per-key results when a few keys hold most rows: exact offset chunking.

A hash partitioning by key puts a hot key into one task. Here rows are range-partitioned by
(key, order), which cuts a hot key into as many pieces as it needs; the rows of each piece are
counted, prefix sums of the counts give every piece its offset, and with them every row its exact
number inside its key. Equal-sized chunks of a key are processed on their own and their boundary
states are merged in order. Results per key need the ordered pieces only once: they are written
sorted, counted, and read file by file, so that rows are shuffled once.

Defined results: a null key is a key of its own, rows with equal order values are
ordered by the given tie-breaker, repeated rows are all counted, an empty input gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from ..sources.files import open_input

PIECE, ROW, CHUNK, OFFSET = "_piece", "_row_no", "_chunk_no", "_offset"


def pieces(df: DataFrame, key: str, order: list[str], name: str = "pieces") -> DataFrame:
    """``df`` in ranges of (key, order), with the number of its range; kept as a written table.

    Written because the range bounds come from a sample: what reads it twice must see the same
    pieces, also after an executor was lost.
    """
    spread = df.repartitionByRange(F.col(key), *[F.col(c) for c in order])
    return written(spread.withColumn(PIECE, F.spark_partition_id()), name)


def piece_offsets(counted: DataFrame, key: str, value: str) -> DataFrame:
    """(piece, key, offset): the sum of ``value`` over the pieces of the key that come before.

    One row for each piece and key: the window holds at most as many rows of a key as there are
    pieces.
    """
    before = Window.partitionBy(key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(PIECE, key, F.coalesce(F.sum(value).over(before), F.lit(0)).alias(OFFSET))


def with_offset(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Adds the offset to each row of its piece. The key must not be null: see ``null_safe``.

    Both sides are clustered by (piece, key) by the window that numbered the rows.
    """
    return rows.join(offsets, [PIECE, key])


def null_safe(key: Column) -> Column:
    """A key as a string that is never null: '' for null, else '=' and the value."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def numbered(placed: DataFrame, key: str, order: list[str], chunk_rows: int, **inside_piece) -> DataFrame:
    """Rows of ``pieces`` with their exact number inside the key (from 0) and their chunk.

    inside_piece: further columns, each made by a function of the ordered window of the row's
    key inside its piece, so that they share its sort.
    """
    counted = placed.groupBy(PIECE, key).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(PIECE, key).orderBy(*order)
    rows = placed.withColumns({ROW: F.row_number().over(inside) - 1} | {k: f(inside) for k, f in inside_piece.items()})
    out = with_offset(rows, piece_offsets(counted, key, "_n"), key)
    number = F.col(ROW).cast("long") + F.col(OFFSET)
    return out.withColumns({ROW: number, CHUNK: F.floor(number / F.lit(chunk_rows)).cast("long")}).drop(OFFSET)


STATES = "key string, chunk bigint, piece int, n bigint, first bigint, last bigint, step bigint"


def sorted_pieces(narrow: DataFrame, order: list[str], name: str) -> str:
    """Writes rows in ranges of ``order``, each range sorted in a file of its own; gives the folder."""
    path = scratch(narrow.sparkSession, name)
    narrow.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    return path


def _batch_states(keys, values, valid, start: int, chunk_rows: int):
    """States of the runs of a sorted batch, cut where a chunk ends; ``start``: rows of the first key before it."""
    import numpy as np

    n = len(values)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    number = np.arange(n) - begin + np.where(begin == 0, start, 0)
    chunk = number // chunk_rows
    cut = fresh.copy()
    cut[1:] |= chunk[1:] != chunk[:-1]
    at = np.flatnonzero(cut)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    step, stepped = np.full(n, low), np.zeros(n, dtype=bool)
    stepped[1:] = valid[1:] & valid[:-1] & ~cut[1:]
    step[1:][stepped[1:]] = (values[1:] - values[:-1])[stepped[1:]]
    any_value, any_step = np.logical_or.reduceat(valid, at), np.logical_or.reduceat(stepped, at)
    first = np.minimum.reduceat(np.where(valid, values, high), at)
    last = np.maximum.reduceat(np.where(valid, values, low), at)
    most = np.maximum.reduceat(step, at)
    sizes = np.diff(np.append(at, n))
    states = [
        [keys[i], int(chunk[i]), int(size), int(f) if has else None, int(t) if has else None, int(m) if moved else None]
        for i, size, f, t, m, has, moved in zip(at, sizes, first, last, most, any_value, any_step)
    ]
    return states, int(number[-1]) + 1


def _joined(a: list, b: list) -> list:
    """The state of two neighbouring parts of a chunk."""
    edge = [b[3] - a[4]] if a[4] is not None and b[3] is not None else []
    steps = [x for x in (a[5], b[5], *edge) if x is not None]
    return [a[0], a[1], a[2] + b[2], b[3] if a[3] is None else a[3], a[4] if b[4] is None else b[4], max(steps, default=None)]


def chunk_states(spark: SparkSession, folder: str, chunk_rows: int) -> DataFrame:
    """(key, chunk, piece, n, first, last, step) of the sorted files of ``folder``, with columns key and value.

    Rows are counted per file and key; as files are sorted ranges, only a file's first key can have
    rows in files before it, whose sum is its offset. Each task then numbers and cuts one file, read
    in bounded batches; rows are not shuffled again.
    """
    rows = spark.read.parquet(folder)
    piece = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    counted = rows.select(F.col("_metadata.file_path").alias("path"), piece.alias(PIECE), "key").groupBy("path", PIECE, "key").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("key").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn(OFFSET, F.coalesce(F.sum("_n").over(before), F.lit(0)))
    work = offsets.groupBy("path", PIECE).agg(F.min(F.struct("key", OFFSET)).alias("first")).select("path", PIECE, F.col(f"first.{OFFSET}").alias(OFFSET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in batches:
            for unit in batch.to_pylist():
                states, now, done = [], unit[OFFSET], None
                with open_input(unit["path"]) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=1 << 18, columns=["key", "value"]):
                        if not len(part):
                            continue
                        keys = np.asarray(part.column("key").to_pylist(), dtype=object)
                        values = part.column("value")
                        start = now if done is None or keys[0] == done else 0
                        found, now = _batch_states(keys, pc.fill_null(values, 0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False), start, chunk_rows)
                        done = keys[-1]
                        if states and states[-1][:2] == found[0][:2]:
                            states[-1] = _joined(states[-1], found.pop(0))
                        states += found
                        if len(states) > 1:
                            yield _state_batch(states[:-1], unit[PIECE])
                            states = states[-1:]
                if states:
                    yield _state_batch(states, unit[PIECE])

    # a number of its own, since rows that name files are too few bytes to be left to AQE
    return work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), PIECE).mapInArrow(run, STATES)


def _state_batch(states: list[list], piece: int) -> pa.RecordBatch:
    key, chunk, n, first, last, step = zip(*states)
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([key, chunk, [piece] * len(key), n, first, last, step], kinds)], names=["key", "chunk", "piece", "n", "first", "last", "step"])


def keyed_runs(df: DataFrame, key: Column, value: Column, tie: Column, chunk_rows: int = 1 << 20, name: str = "runs") -> DataFrame:
    """Per key: number of rows, first and last ``value`` and the largest step between neighbours; written.

    ``value`` is a long that orders the rows of a key; null values come first and make no step.
    ``tie`` tells rows of equal value apart, so that a range bound may fall between them.
    The largest step needs the order across chunks: it is the largest inside any chunk, or
    between the last value of a chunk and the first of the next.
    """
    narrow = df.select(null_safe(key).alias("key"), value.cast("long").alias("value"), tie.alias("tie"))
    states = written(chunk_states(df.sparkSession, sorted_pieces(narrow, ["key", "value", "tie"], name), chunk_rows), "states")
    ordered = Window.partitionBy("key").orderBy("chunk", "piece")
    merged = states.withColumn("edge", F.col("first") - F.lag("last").over(ordered))
    return (
        merged.groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("first").alias("first_value"),
            F.max("last").alias("last_value"),
            F.max(F.greatest("step", "edge")).alias("max_step"),
            F.max("chunk").alias("last_chunk"),
        )
        .withColumn("n_chunks", F.col("last_chunk") + 1)
        .withColumn("key", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
        .drop("last_chunk")
    )


def heavy_keys(runs: DataFrame, share: float) -> DataFrame:
    """Keys of ``keyed_runs`` that hold at least ``share`` of all rows; at most 1 / share rows."""
    total = runs.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("t")).collect()[0]["t"]
    # rounded, so that a key of exactly the share counts whatever its binary fraction
    return runs.where(F.col("n_rows") >= F.lit(math.ceil(round(share * total, 6))))
