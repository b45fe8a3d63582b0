"""Integer and boolean encodings as column operations; Parquet does the physical encoding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an archive block and postings of a posting block, where encodings start anew.
ARCHIVE_BLOCK, POSTING_BLOCK = 1000, 1024


def wrapping(value: Column) -> Column:
    """A decimal brought back into the range of int64 as two's complement arithmetic does."""
    span, half = (F.lit(Decimal(1 << n)).cast("decimal(38,0)") for n in (64, 63))
    return (F.pmod(value.cast("decimal(38,0)") + half, span) - half).cast("bigint")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def delta_of_delta(df: DataFrame, block: list[str], order: list[str], column: str, name: str = "dod") -> DataFrame:
    """Second differences inside each block, both starts taken as 0: the first value, then v1 - 2 v0."""
    w = Window.partitionBy(*block).orderBy(*order)
    v = F.col(column)
    second = _wide(v) - 2 * _wide(F.lag(v, 1, 0).over(w)) + _wide(F.lag(v, 2, 0).over(w))
    return df.withColumn(name, wrapping(second))


def delta_of_delta_decode(df: DataFrame, block: list[str], order: list[str], column: str = "dod", name: str = "value") -> DataFrame:
    """Inverse of ``delta_of_delta``: two running sums."""
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = df.withColumn("_delta", F.sum(_wide(F.col(column))).over(w))
    return first.withColumn(name, wrapping(F.sum("_delta").over(w))).drop("_delta")


def tuple_delta(df: DataFrame, block: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``dod_<column>`` for each component of a tuple, restarted in each block."""
    for c in columns:
        df = delta_of_delta(df, block, order, c, f"dod_{c}")
    return df


def tuple_delta_decode(df: DataFrame, block: list[str], number: str, columns: list[str]) -> DataFrame:
    """Inverse of ``tuple_delta``, from the codes and the rows' number in their block alone."""
    for c in columns:
        df = delta_of_delta_decode(df, block, [number], f"dod_{c}", c)
    return df


def bit_pack(df: DataFrame, number: Column, flag: Column) -> DataFrame:
    """(byte_no, bits, n_bits): flags packed by eight, the first in the lowest bit; null is false.

    number: the flag's place from 0; a byte is a sum of its flags' bits, so no order is needed.
    """
    spot = F.pmod(number, F.lit(8)).cast("int")
    return (
        df.select(F.floor(number / 8).alias("byte_no"), F.when(flag, F.expr("1")).otherwise(0).alias("_f"), spot.alias("_s"))
        .groupBy("byte_no")
        .agg(F.sum(F.call_function("shiftleft", F.col("_f"), F.col("_s"))).cast("int").alias("bits"), F.count(F.lit(1)).alias("n_bits"))
    )


def bit_unpack(packed: DataFrame) -> DataFrame:
    """(number, flag): inverse of ``bit_pack``."""
    each = packed.select("byte_no", "bits", F.explode(F.sequence(F.lit(0), F.col("n_bits").cast("int") - 1)).alias("i"))
    return each.select((F.col("byte_no") * 8 + F.col("i")).alias("number"), (F.getbit(F.col("bits"), F.col("i")) == 1).alias("flag"))


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def uvarint_size(value: Column) -> Column:
    """Bytes of an unsigned base-128 varint: one for each seven bits, at least one."""
    bits = F.length(F.regexp_replace(F.bin(value), "^0+(?=.)", ""))
    return F.ceil(bits / 7).cast("int")


def varint_size(value: Column) -> Column:
    """Bytes of a signed varint in zigzag form."""
    return uvarint_size(zigzag(value.cast("bigint")))


def uvarint_bytes(value: Column) -> Column:
    """Unsigned base-128 varint of a long: seven bits a byte, the lowest first, the high bit says that more follow."""
    n = uvarint_size(value)
    each = lambda i: F.call_function("shiftrightunsigned", value, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(each(i)), 2, "0")), ""))


def varint_bytes(value: Column) -> Column:
    """Signed varint in zigzag form."""
    return uvarint_bytes(zigzag(value.cast("bigint")))


def bit_pack_bytes(flags: Column) -> Column:
    """An array of flags as bytes: their number as an unsigned varint, then eight a byte, the first lowest.

    An empty array has no byte, a null flag is false, a null array stays null.
    """
    n = F.size(flags)
    byte = lambda i: F.aggregate(F.slice(flags, i * 8 + 1, F.lit(8)), F.struct(F.lit(0).alias("b"), F.lit(1).alias("w")), lambda now, f: F.struct((now["b"] + F.when(f, now["w"]).otherwise(0)).alias("b"), (now["w"] * 2).alias("w")))["b"]
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))
    return F.when(n > 0, F.concat(uvarint_bytes(n.cast("bigint")), body)).when(n == 0, F.unhex(F.lit("")))
