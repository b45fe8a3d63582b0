"""Messages delivered more than once: one copy of each, by narrow winners and deletion vectors.

Only the identifier, the delivery order and the position of a row (file, row number) are
shuffled, once. Winners are chosen by a partial and a final minimum, so a hot identifier is reduced
before the shuffle; a row without identifier wins by itself. Winners become bitmaps of 32,768 rows
per file and block; what is not in its block's bitmap is deleted. The wide columns are then read row
group by row group with these vectors applied, and never shuffled.

Defined results: a null or unreadable identifier makes no message and is never surplus (it is
kept by ``survivors``); ties in time are decided by the delivery number, and equal rows by their
position; an empty table gives an empty result; further columns are passed through by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from ..sources.files import open_input

#: Rows of a bitmap of bitmap_construct_agg: its fixed size of 4 KiB in bits.
BLOCK = 32768


def id128(text: Column) -> Column:
    """A 128-bit number in hex, however spelled, as 16 bytes; null if it is none.

    Case, white space, hyphens, braces, a 0x or urn:uuid: prefix and missing leading zeros make
    no difference.
    """
    plain = F.lower(F.regexp_replace(text, r"(?i)^\s*(urn:uuid:|0x)|[\s{}\-]", ""))
    bare = F.regexp_replace(plain, r"^0+(?=.)", "")
    return F.when(bare.rlike("^[0-9a-f]{1,32}$"), F.unhex(F.lpad(bare, 32, "0")))


def file_number(path: str) -> Column:
    """Number of a file by its path, which Spark spells with one or three slashes behind file:."""
    return F.xxhash64(F.regexp_replace(path, "^file:/+", "file:///"))


def deletion_vectors(spark: SparkSession, path: str | list[str], ident: Column, order: list[str]) -> DataFrame:
    """(file, block, kept): the rows of each block of each file that stay; a block without a row here has none.

    ``file`` is the hash of the path that Spark names, ``kept`` a little-endian bitmap.
    """
    spot = F.struct(file_number("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = spark.read.parquet(path).select(ident.alias("id"), *order, spot.alias("spot"))
    at = F.struct(*order, F.col("spot.file").alias("file"), F.col("spot.row").alias("row"))
    winners = rows.groupBy("id", F.when(F.col("id").isNull(), F.col("spot")).alias("alone")).agg(F.min(at).alias("at"))
    places = winners.select(F.col("at.file").alias("file"), F.floor(F.col("at.row") / BLOCK).alias("block"), (F.col("at.row") % BLOCK).alias("bit"))
    return written(places.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("kept")), "vectors")


def units(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row_group, first, n, file, block): row groups of each file, what a task reads at once, a row for each block. Only footers are read."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out: dict[str, list] = {"path": [], "row_group": [], "first": [], "n": []}
            for p in batch.column("path").to_pylist():
                with open_input(p) as f:
                    meta, at = pq.ParquetFile(f).metadata, 0
                    for g in range(meta.num_row_groups):
                        n = meta.row_group(g).num_rows
                        for k, v in zip(out, (p, g, at, n)):
                            out[k].append(v)
                        at += n
            yield pa.RecordBatch.from_pydict({"path": pa.array(out["path"], pa.string()), **{k: pa.array(out[k], pa.int64()) for k in ("row_group", "first", "n")}})

    files = spark.createDataFrame([(p,) for p in spark.read.parquet(path).inputFiles()], "path string")
    found = files.repartition(tasks(spark)).mapInArrow(groups, "path string, row_group bigint, first bigint, n bigint").withColumn("file", file_number("path"))
    return found.withColumn("block", F.explode(F.when(F.col("n") > 0, F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK)))))


def tasks(spark: SparkSession) -> int:
    """A number of partitions of its own, since rows that name files are too few bytes to be left to AQE."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_with_vectors(spark: SparkSession, path: str | list[str], vectors: DataFrame, columns: list[str], surplus: bool = False) -> DataFrame:
    """The rows of ``path`` that the vectors leave, or with ``surplus`` those that they delete.

    Each task reads one row group with the bitmaps of its blocks; payloads stay where they are.
    """
    schema = T.StructType([f for f in spark.read.parquet(path).select(*columns).schema])
    arrow = to_arrow_schema(schema)
    joined = units(spark, path).join(vectors, ["file", "block"], "left")
    work = joined.groupBy("path", "row_group", "first", "n").agg(F.collect_list(F.struct("block", "kept")).alias("maps"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.parquet as pq

        for batch in batches:
            for unit in batch.to_pylist():
                first, n = unit["first"], unit["n"]
                keep = np.zeros(n, dtype=bool)
                for m in unit["maps"]:
                    if m["block"] is None or m["kept"] is None:
                        continue
                    kept = np.unpackbits(np.frombuffer(m["kept"], np.uint8), bitorder="little").astype(bool)
                    low, high = max(first, m["block"] * BLOCK), min(first + n, (m["block"] + 1) * BLOCK)
                    keep[low - first : high - first] = kept[low - m["block"] * BLOCK : high - m["block"] * BLOCK]
                keep = ~keep if surplus else keep
                if not keep.any():
                    continue
                with open_input(unit["path"]) as f:
                    at = 0
                    for part in pq.ParquetFile(f).iter_batches(batch_size=8192, row_groups=[unit["row_group"]], columns=columns):
                        chosen = part.filter(pa.array(keep[at : at + len(part)]))
                        at += len(part)
                        if len(chosen):
                            yield pa.Table.from_batches([chosen]).select(columns).cast(arrow).combine_chunks().to_batches()[0]

    return work.repartition(tasks(spark), "path", "row_group").mapInArrow(read, schema)


def surplus_rows(spark: SparkSession, path: str | list[str], ident: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The deliveries beyond the first of each message."""
    return read_with_vectors(spark, path, deletion_vectors(spark, path, ident, order), columns, surplus=True)


def survivors(spark: SparkSession, path: str | list[str], ident: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Exactly one copy of each message, and every row without an identifier."""
    return read_with_vectors(spark, path, deletion_vectors(spark, path, ident, order), columns)
