"""Frequency of every distinct term: occurrences, records that hold it, and frequency bounds.

Copies of an occurrence are dropped inside each batch, rows are shuffled once by record and term,
counted there per record, and the counts are combined by term before their small shuffle. A term
that is in every record is spread over its records, and reaches its task as one row per upstream
partition; what one record holds of one term is no more than that record's length.

Defined results: terms are compared in lower case; a row without term or without record is no
posting; an occurrence stored more than once counts once; no postings give no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_counts(postings: DataFrame, term: Column, record: list[str], position: str) -> DataFrame:
    """(record, term, n): distinct occurrences of each term in each record."""
    rows = _clean(postings, term, record).select(*record, F.lower(term).alias("term"), position)
    once = rows.mapInArrow(_once, rows.schema)
    return once.repartition(*record, "term").distinct().groupBy(*record, "term").agg(F.count(F.lit(1)).alias("n"))


def record_terms(postings: DataFrame, term: Column, record: list[str]) -> DataFrame:
    """(record, term): each term once in each record, combined before the shuffle; without counting occurrences."""
    return _clean(postings, term, record).select(*record, F.lower(term).alias("term")).distinct()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct row of a batch once: a posting stored many times is few rows before the shuffle."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()


def _clean(postings: DataFrame, term: Column, record: list[str]) -> DataFrame:
    keep = term.isNotNull()
    for c in record:
        keep = keep & F.col(c).isNotNull()
    return postings.where(keep)


def n_records(postings: DataFrame, term: Column, record: list[str]) -> int:
    """Number of distinct records, over all terms: a narrow scan, records combined before the shuffle."""
    return _clean(postings, term, record).select(*record).distinct().count()


def term_counts(counts: DataFrame) -> DataFrame:
    """(term, n_occurrences, n_records) from the counts per record."""
    return counts.groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))


def marked(terms: DataFrame, records: int, rare: int = 2, common: float = 0.2) -> DataFrame:
    """Adds ``mark``: 'rare' for at most ``rare`` records, 'common' for more than a share, else ''.

    A term that is both, in a very small collection, is rare.
    """
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.lit(common) * F.lit(records), "common").otherwise("")
    return terms.withColumn("mark", mark)


def term_frequencies(postings: DataFrame, term: str = "trigram", record: tuple[str, ...] = ("stream_id", "document_id"), position: str = "position", rare: int = 2, common: float = 0.2, occurrences: bool = True) -> DataFrame:
    """(term, n_occurrences, n_records, mark) for every distinct term; without ``occurrences`` only records are counted."""
    records = n_records(postings, F.col(term), list(record))
    if occurrences:
        return marked(term_counts(record_counts(postings, F.col(term), list(record), position)), records, rare, common)
    counted = record_terms(postings, F.col(term), list(record)).groupBy("term").agg(F.count(F.lit(1)).alias("n_records"))
    return marked(counted, records, rare, common)
