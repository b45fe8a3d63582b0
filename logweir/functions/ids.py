"""Document ids: milliseconds and a 20-bit counter of the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import skew

COUNTER_BITS = 20


def pack_id(ms: Column, counter: Column) -> Column:
    return F.shiftleft(ms.cast("bigint"), COUNTER_BITS).bitwiseOR(F.pmod(counter.cast("bigint"), F.lit(1 << COUNTER_BITS)))


def id_ms(ident: Column) -> Column:
    return F.shiftright(ident, COUNTER_BITS)


def id_counter(ident: Column) -> Column:
    return ident.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1))


def with_ids(df: DataFrame, stream: str, ms: str, order: list[str], name: str = "document_id") -> DataFrame:
    """Adds ids in order of arrival: the stream's counter starts at 1 and wraps to 0 at 2^20.

    Counted over ranges of (stream, order), so that a large stream isn't in one task. Streams
    and ``order`` must not be null and ``order`` unique inside a stream.
    """
    placed = skew.pieces(df, stream, order, "ids")
    rows = skew.numbered(placed, stream, order, 1 << COUNTER_BITS)
    return rows.withColumn(name, pack_id(F.col(ms), F.col(skew.ROW) + 1)).drop(skew.PIECE, skew.ROW, skew.CHUNK)
