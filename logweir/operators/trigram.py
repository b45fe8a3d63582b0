"""Positional trigram index over message bytes: extraction, segments, exact search.

A message is its UTF-8 bytes with two padding bytes FF on either side. A posting is a trigram
with document, stream and byte position, from -2. A search divides the index by the query's
trigrams: an occurrence is a start where all of them stand at their distance, found by one
equi-join on the trigram and one aggregation by (stream, document, start).

Defined results: null texts have no posting; an empty text has the two padding ones; repeated
documents count once; queries of fewer than three bytes are answered by a scan; the empty query
is in every text, at byte 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import POSTING_BLOCK
from . import skew

#: Folders over which a stored index is spread, so that a search reads few of them.
BUCKETS = 64
#: Bytes of texts whose trigrams are cut at once.
CUT = 1 << 19


def postings(documents: DataFrame, text: str, stream: str = "stream_id", document: str = "document_id", padded: bool = True, only: list[str] | None = None) -> DataFrame:
    """(trigram, document_id, stream_id, position) of each trigram of each text; ``only``: of these trigrams.

    Bytes are cut in bulk, a bounded number at a time, so that long texts take no more memory.
    """
    edge, wanted = b"\xff\xff" if padded else b"", None if only is None else sorted({int(t, 16) for t in only})
    read = documents.select(F.col(stream).alias("stream_id"), F.col(document).alias("document_id"), F.encode(F.col(text), "UTF-8").alias("_b")).where("_b is not null")
    kinds = dict(read.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, bases, size = [], [], [], 0
            for i, data in enumerate(batch.column("_b").to_pylist()):
                data = edge + data + edge
                for at in range(0, len(data) - 2, CUT):
                    part = data[at : at + CUT + 2]
                    rows.append(i), parts.append(part), bases.append(at - len(edge))
                    size += len(part)
                    if size >= CUT:
                        yield from _cut(batch, rows, parts, bases, wanted)
                        rows, parts, bases, size = [], [], [], 0
            yield from _cut(batch, rows, parts, bases, wanted)

    return read.mapInArrow(run, f"trigram string, document_id {kinds['document_id']}, stream_id {kinds['stream_id']}, position bigint")


def _cut(batch: pa.RecordBatch, rows: list[int], parts: list[bytes], bases: list[int], wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
    import numpy as np

    if not parts:
        return
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    last = np.zeros(len(data), dtype=bool)
    last[ends - 1] = last[ends - 2] = True
    at = np.flatnonzero(~last)
    if wanted is not None:
        at = at[np.isin((data[at].astype(np.int32) << 16) | (data[at + 1].astype(np.int32) << 8) | data[at + 2], wanted)]
    part = np.searchsorted(ends, at, side="right")
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)
    text = np.concatenate([digits[data[at]], digits[data[at + 1]], digits[data[at + 2]]], axis=1)
    hexes = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(0, 6 * len(at) + 1, 6, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
    of = pa.array(np.array(rows)[part])
    spots = pa.array((at - starts[part] + np.array(bases)[part]).astype(np.int64))
    yield pa.RecordBatch.from_arrays([hexes, batch.column("document_id").take(of), batch.column("stream_id").take(of), spots], names=["trigram", "document_id", "stream_id", "position"])


def dictionary(index: DataFrame) -> DataFrame:
    """(trigram, n_postings, n_documents, n_blocks): what a segment's directory holds."""
    counted = index.groupBy("trigram", "stream_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy("trigram").agg(F.sum("n").alias("n_postings"), F.count(F.lit(1)).alias("n_documents"))
    return out.withColumn("n_blocks", F.ceil(F.col("n_postings") / POSTING_BLOCK).cast("bigint"))


def stored(index: DataFrame, path: str, mode: str = "append") -> None:
    """Appends a segment: hashed by trigram into folders, sorted, so that row groups can be skipped.

    A frequent trigram is spread by document over several files of its folder.
    """
    bucketed = index.withColumn("tri_bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))
    spread = bucketed.repartitionByRange("tri_bucket", "trigram", "document_id", "stream_id", "position").sortWithinPartitions("tri_bucket", "trigram", "document_id", "stream_id", "position")
    spread.write.mode(mode).option("compression", "zstd").partitionBy("tri_bucket").parquet(path)


def pieces_of(query: str) -> list[tuple[int, str]]:
    data = query.encode()
    return [(i, data[i : i + 3].hex()) for i in range(len(data) - 2)]


def search(index: DataFrame, query: str) -> DataFrame:
    """(stream_id, document_id, position): every occurrence, overlapping ones included.

    For queries of three bytes or more. The query's trigrams are a predicate of the scan, so a
    stored index reads their folders only; a repeated posting doesn't count twice.
    """
    parts = pieces_of(query)
    if not parts:
        raise ValueError("a search by index needs three bytes")
    wanted = sorted({t for _, t in parts})
    hits = index.where(F.col("trigram").isin(*wanted))
    if "tri_bucket" in index.columns:
        spark = index.sparkSession
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        hits = hits.where(F.col("tri_bucket").isin(*buckets))
    offsets = F.create_map(*[x for t in wanted for x in (F.lit(t), F.array(*[F.lit(i) for i, u in parts if u == t]))])
    starts = hits.select("stream_id", "document_id", F.explode(offsets[F.col("trigram")]).alias("i"), "position").select("stream_id", "document_id", (F.col("position") - F.col("i")).alias("position"), "i")
    found = starts.groupBy("stream_id", "document_id", "position").agg(F.countDistinct("i").alias("n"))
    return found.where(F.col("n") == len(parts)).select("stream_id", "document_id", "position")


def scan_search(documents: DataFrame, text: str, query: str, stream: str = "stream_id", document: str = "document_id") -> DataFrame:
    """As ``search`` for queries of any length, by reading the texts."""
    rows = documents.select(F.col(stream).alias("stream_id"), F.col(document).alias("document_id"), F.col(text).alias("_t")).where("_t is not null")
    if not query:
        return rows.select("stream_id", "document_id", F.lit(0).cast("long").alias("position")).distinct()
    wanted = query.encode()
    held = rows.where(F.contains(F.col("_t"), F.lit(query))).select("stream_id", "document_id", F.encode("_t", "UTF-8").alias("_b"))
    places = F.sequence(F.lit(0), F.octet_length("_b") - len(wanted))
    starts = F.filter(places, lambda i: F.substring(F.col("_b"), i + 1, F.lit(len(wanted))) == F.unhex(F.lit(wanted.hex())))
    return held.select("stream_id", "document_id", F.explode(starts).alias("position")).withColumn("position", F.col("position").cast("long")).distinct()


def indexed_query(index: DataFrame, documents: DataFrame, text: str, query: str, keys: tuple[str, str] = ("stream_id", "document_id")) -> DataFrame:
    """Documents that hold the query: found by index, fetched by semi-join; short queries by scan."""
    if len(query.encode()) < 3:
        return documents.where(F.coalesce(F.contains(F.col(text), F.lit(query)), F.lit(False)))
    found = search(index, query).select("stream_id", "document_id").distinct()
    return documents.join(found.select(F.col("stream_id").alias(keys[0]), F.col("document_id").alias(keys[1])), list(keys), "left_semi")


def search_segments(segments: list[DataFrame], query: str) -> DataFrame:
    """Occurrences in any of several segments, each once even if segments overlap."""
    every = segments[0]
    for s in segments[1:]:
        every = every.unionByName(s)
    return search(every, query)


def time_rollup(index: DataFrame, unit: str) -> DataFrame:
    """(trigram, bucket, n_documents): a coarser index that tells in which times a trigram occurs.

    Its document numbers carry their time, so no document is read; a search skips times first.
    """
    docs = index.select("trigram", "stream_id", "document_id").distinct()
    at = F.date_trunc(unit, F.timestamp_millis(F.shiftright("document_id", 20)))
    return docs.groupBy("trigram", at.alias("bucket")).agg(F.count(F.lit(1)).alias("n_documents"))


def timed_search(index: DataFrame, rollup: DataFrame, query: str, unit: str) -> DataFrame:
    """As ``search``, after the rollup told the times in which every trigram of the query occurs.

    Postings of other times are not searched; an index stored by time doesn't read them.
    """
    wanted = sorted({t for _, t in pieces_of(query)})
    times = rollup.where(F.col("trigram").isin(*wanted)).groupBy("bucket").agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(wanted)).select("bucket")
    at = F.date_trunc(unit, F.timestamp_millis(F.shiftright("document_id", 20)))
    near = index.where(F.col("trigram").isin(*wanted)).withColumn("bucket", at).join(times, "bucket", "left_semi").drop("bucket")
    return search(near, query)


def document_numbers(index: DataFrame) -> DataFrame:
    """(stream_id, document_id, no): documents numbered densely from 1, by offsets of ordered pieces.

    Dense numbers fill bitmaps; 32,768 documents share one.
    """
    docs = index.select("stream_id", "document_id").distinct().withColumn("_all", F.lit(""))
    placed = skew.pieces(docs, "_all", ["stream_id", "document_id"], "documents")
    return skew.numbered(placed, "_all", ["stream_id", "document_id"], 1 << 15).select("stream_id", "document_id", (F.col(skew.ROW) + 1).alias("no"))


def bitmaps(index: DataFrame, number: Column) -> DataFrame:
    """(trigram, bucket, bits, n): posting lists as bitmaps of document numbers."""
    rows = index.select("trigram", number.alias("no")).distinct()
    return rows.groupBy("trigram", F.bitmap_bucket_number("no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits")).withColumn("n", F.bitmap_count("bits"))


def documents_of(bits: DataFrame, trigrams: list[str], every: bool = True) -> DataFrame:
    """(no): numbers of documents that hold all of the trigrams, or any of them, from their bitmaps alone."""
    found = bits.where(F.col("trigram").isin(*trigrams)).groupBy("bucket")
    if every:
        both = found.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(trigrams)))
    else:
        both = found.agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = lambda i: F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int")
    filled = both.select("bucket", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("i"), "bits").select("bucket", "i", byte(F.col("i")).alias("b")).where("b > 0")
    bit = filled.select("bucket", "i", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.getbit(F.col("b"), F.col("k")) == 1)
    return bit.select(((F.col("bucket") - 1) * (1 << 15) + F.col("i") * 8 + F.col("k") + 1).alias("no"))
