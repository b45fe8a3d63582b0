"""Filling fixed-capacity containers with texts: harmonic packing, independently on each worker.

Lengths fall into classes by reciprocal capacity: class k holds what fits k times but not k + 1
times, and a container of class k takes exactly k pieces. Each worker fills its own containers
from its own share of the pieces, without talking to others. What the large classes leave free in
their containers is then filled with the worker's small pieces, and each class's incomplete last
containers are emptied into each other by first fit decreasing.

Defined results: a text longer than the capacity is split into pieces of the capacity and a rest,
any other text is one piece; an empty or null text is a piece of no size in some container; ties
are broken by position in the table; repeated rows are texts of their own; no texts, no containers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tokens import DEFAULT_TOKENIZER, n_tokens

#: Pieces that a worker packs at once, on average; its memory is proportional to it.
WORKER_PIECES = 20_000
#: Classes up to this are filled up with small pieces; above MANY their counts grow by 5 %.
LARGE, MANY = 4, 20


def class_sizes(capacity: int) -> list[int]:
    """The fixed numbers of pieces of a container, ascending: 1 to MANY, then in steps of 5 %."""
    out, k = [], 1
    while k <= capacity:
        out.append(k)
        k = k + 1 if k < MANY else max(k + 1, int(k * 1.05))
    return out


def pack(lengths: list[int], capacity: int) -> list[int]:
    """Container number of each piece; no length may exceed the capacity."""
    from bisect import bisect_right

    sizes = class_sizes(capacity)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[int] = []
    out = [-1] * len(lengths)
    classes: dict[int, list[int]] = {}
    empty = []
    for i in order:
        if lengths[i] <= 0:
            empty.append(i)
        else:
            fits = capacity // lengths[i]
            classes.setdefault(sizes[bisect_right(sizes, fits) - 1], []).append(i)

    def fill(pieces: list[int], k: int) -> list[int]:
        """Complete containers of k pieces; gives the pieces left over."""
        whole = len(pieces) // k * k
        for at in range(0, whole, k):
            for i in pieces[at : at + k]:
                out[i] = len(bins)
            bins.append(sum(lengths[i] for i in pieces[at : at + k]))
        return pieces[whole:]

    left = [i for k in sorted(c for c in classes if c <= LARGE) for i in fill(classes[k], k)]
    small = [i for k in sorted((c for c in classes if c > LARGE), reverse=True) for i in reversed(classes[k])]
    keys = [lengths[i] for i in small]
    for b in sorted(range(len(bins)), key=lambda b: bins[b]):
        while keys and (at := bisect_right(keys, capacity - bins[b])):
            out[small[at - 1]] = b
            bins[b] += keys.pop(at - 1)
            small.pop(at - 1)
    rest: dict[int, list[int]] = {}
    for i in reversed(small):
        rest.setdefault(sizes[bisect_right(sizes, capacity // lengths[i]) - 1], []).append(i)
    for k in sorted(rest):
        left += fill(rest[k], k)

    open_bins: list[int] = []
    for i in sorted(left, key=lambda i: (-lengths[i], i)):
        b = next((b for b in open_bins if bins[b] + lengths[i] <= capacity), None)
        if b is None:
            b = len(bins)
            bins.append(0)
            open_bins.append(b)
        bins[b] += lengths[i]
        out[i] = b
    if empty and not bins:
        bins.append(0)
    for i in empty:
        out[i] = len(bins) - 1
    return out


def lengths(documents: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(ident, n_tokens, spot): each text's length, written; ``spot`` tells equal rows apart."""
    sized = written(documents.select(F.col(ident), n_tokens(F.col(text), tokenizer).alias("n_tokens")), "lengths")
    return sized.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("spot"))


def packed(sized: DataFrame, capacities: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Each piece with its container, for every capacity.

    capacities: (pack_name, capacity_tokens), a fixed small table; rows without a positive
    capacity are ignored.
    """
    packs = [(r["pack_name"], r["capacity_tokens"]) for r in capacities.select("pack_name", "capacity_tokens").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).collect()[0]
    kind = dict(sized.dtypes)[ident]

    def one(name: str, capacity: int) -> DataFrame:
        n = F.col("n_tokens")
        count: Column = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
        pieces = sized.withColumn("n_parts", count).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        pieces = pieces.withColumn("start_token", F.col("part_no").cast("long") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), n - F.col("start_token")))
        workers = max(1, -(-(total["n"] + total["t"] // capacity) // WORKER_PIECES))
        return pieces.withColumn("worker", F.pmod(F.xxhash64("spot", "part_no"), F.lit(workers))).withColumns({"pack_name": F.lit(name), "capacity_tokens": F.lit(capacity)})

    def worker(key: tuple, table: pa.Table) -> pa.Table:
        name, capacity, number = (k.as_py() for k in key)
        table = table.sort_by([("spot", "ascending"), ("part_no", "ascending")])
        bins = pack(table.column("size").to_pylist(), capacity)
        n = len(table)
        return pa.table(
            {
                "pack_name": pa.array([name] * n, pa.string()),
                "capacity_tokens": pa.array([capacity] * n, pa.int32()),
                "container_id": pa.array([f"{name}-{number}-{b}" for b in bins], pa.string()),
                ident: table.column(ident),
                "part_no": table.column("part_no").cast(pa.int32()),
                "n_parts": table.column("n_parts").cast(pa.int32()),
                "start_token": table.column("start_token"),
                "n_tokens": table.column("size"),
            }
        )

    schema = f"pack_name string, capacity_tokens int, container_id string, `{ident}` {kind}, part_no int, n_parts int, start_token bigint, n_tokens bigint"
    work = [one(*p).select("pack_name", "capacity_tokens", "worker", ident, "spot", "part_no", "n_parts", "start_token", "size") for p in packs]
    if not work:
        return sized.sparkSession.createDataFrame([], schema)
    every = work[0]
    for w in work[1:]:
        every = every.unionAll(w)
    return every.groupBy("pack_name", "capacity_tokens", "worker").applyInArrow(worker, schema)


def fill_report(pieces: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, unused share and texts that were split."""
    return pieces.groupBy("pack_name", "capacity_tokens").agg(
        F.countDistinct("container_id").alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count(F.when((F.col("part_no") == 0) & (F.col("n_parts") > 1), 1)).alias("n_split"),
    ).withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
