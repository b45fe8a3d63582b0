"""Label sets: canonical text, subset match and the 64-bit stream id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits: offset basis (high and low half) and the prime 2^40 + 435.
FNV_OFFSET_HIGH, FNV_OFFSET_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW = 435


def sorted_entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def label_text(labels: Column) -> Column:
    """``name=value`` joined by ``,`` in order of name. Null for a null map, '' for an empty one.

    Unlike the stream id this tells {a: "bc"} from {ab: "c"}.
    """
    return F.array_join(F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")


def labels_match(labels: Column, wanted: dict[str, str]) -> Column:
    """Whether every wanted key is present with the wanted value; {} matches everything."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out = out & F.coalesce(labels[k] == F.lit(v), F.lit(False))
    return out


def fnv1a64(data: Column) -> Column:
    """FNV-1a of a binary column as a signed long, in two 32-bit halves so that nothing overflows."""
    low32 = 0xFFFFFFFF

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        product = x * F.lit(FNV_PRIME_LOW)
        carry = F.shiftright(product, 32)
        shifted = F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        high = state["hi"] * F.lit(FNV_PRIME_LOW) + carry + shifted
        return F.struct(high.bitwiseAND(F.lit(low32)).alias("hi"), product.bitwiseAND(F.lit(low32)).alias("lo"))

    digits = F.hex(data)
    pairs = F.when(
        F.octet_length(data) > 0,
        F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")),
    ).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(FNV_OFFSET_HIGH).cast("long").alias("hi"), F.lit(FNV_OFFSET_LOW).cast("long").alias("lo"))
    return F.aggregate(pairs, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def stream_id(labels: Column) -> Column:
    """FNV-1a of sorted keys and values without separators, so equal label sets share an id.

    Two label sets may collide by construction ({a: "bc"} and {ab: "c"}); group by ``label_text``
    where that matters.
    """
    text = F.array_join(F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.coalesce(e["value"], F.lit("")))), "")
    return fnv1a64(F.encode(text, "UTF-8"))
