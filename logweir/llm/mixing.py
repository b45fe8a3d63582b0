"""Mixing sources to target weights: iterative proportional fitting of token weights.

Tokens are summed per cell of source, language and topic. The cells' weights are raked in turn to
the sources' target shares and to the corpus' own shares of languages and topics, and capped by
the source's repeats; the source comes last, so its shares are met as far as the caps allow. A
text's expected number of copies is its cell's weight: the whole part is taken for sure, the
rest by a number derived from the row alone, so a lost task repeats the same choice. The
probabilities of each source are scaled so that its tokens come out as near as single texts allow.

Cells are bounded: sources come from the targets, languages are two letters, topics are as many as
the topic model has (``topics``), which is learned from all chosen sources' texts.

Defined results: a source is compared in lower case without blanks, hyphens or underscores; a text
of no or an unknown source is never chosen; an unknown language is 'und', a text of no topic
'general'; an empty text has no tokens and is taken as its cell says; a target without any text
is reported with share 0 and the others are scaled; targets that are null, negative or zero and
repeats below 1 give nothing. Repeated rows draw the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tokens import DEFAULT_TOKENIZER
from .topics import encoded, with_topics

ROUNDS = 200
#: Numbers that decide the rest are multiples of this.
GRAIN = 1 << 30
#: Steps of equal probability by which the draws are calibrated.
STEPS = 1000


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", "")


def sized(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Texts of wanted sources with cell and length, written: the text itself is read once."""
    wanted = targets.where("source is not null and target_share > 0 and max_repeats >= 1").select(F.col("source").alias("to_source"), plain_name(F.col("source")).alias("plain"), "max_repeats").dropDuplicates(["plain"])
    lang = F.lower(F.trim("lang"))
    rows = documents.select(
        F.col(ident),
        plain_name(F.col("source")).alias("plain"),
        F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("und").alias("lang"),
        F.pmod(F.xxhash64(F.lit("mix"), ident, "text"), F.lit(GRAIN)).alias("draw"),
        "text",
    )
    # the targets are few: a source's name and limits
    named = rows.join(F.broadcast(wanted), "plain").drop("plain").withColumnRenamed("to_source", "source")
    read = written(encoded(named, "text", [ident, "source", "lang", "draw", "max_repeats"], tokenizer), "mix-tokens")
    return written(with_topics(read, tokenizer), "mix-sized")


def rake(cells: list[dict], shares: dict[str, float], total: float | None = None) -> list[float]:
    """Weight of each cell ({source, lang, topic, tokens, cap}), by iterative proportional fitting.

    total: tokens of the mixture; by default the most for which every source can reach its share.
    """
    have: dict[str, float] = {}
    caps: dict[str, float] = {}
    for c in cells:
        have[c["source"]] = have.get(c["source"], 0) + c["tokens"]
        caps[c["source"]] = c["cap"]
    present = {s: w for s, w in shares.items() if have.get(s)}
    if not present:
        return [0.0] * len(cells)
    norm = sum(present.values())
    present = {s: w / norm for s, w in present.items()}
    size = min(have[s] * caps[s] / w for s, w in present.items()) if total is None else total
    every = sum(have[s] for s in present)
    goals = {"source": {s: w * size for s, w in present.items()}}
    for dim in ("lang", "topic"):
        sums: dict[str, float] = {}
        for c in cells:
            if c["source"] in present:
                sums[c[dim]] = sums.get(c[dim], 0) + c["tokens"]
        goals[dim] = {k: v / every * size for k, v in sums.items()}
    weights = [size / every if c["source"] in present else 0.0 for c in cells]
    for turn in range(ROUNDS):
        dims = ("lang", "topic", "source") if turn < ROUNDS - 20 else ("source",)
        for dim in dims:
            now: dict[str, float] = {}
            for c, w in zip(cells, weights):
                now[c[dim]] = now.get(c[dim], 0) + w * c["tokens"]
            for i, c in enumerate(cells):
                if weights[i] and now[c[dim]] > 0:
                    weights[i] = min(c["cap"], weights[i] * goals[dim][c[dim]] / now[c[dim]])
    return weights


def mixed(rows: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Adds ``repeats`` to the rows of ``sized``: how often each text is taken, 0 left out."""
    cells = [r.asDict() for r in rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.max("max_repeats").alias("cap")).collect()]
    shares = {r["source"]: r["target_share"] for r in targets.where("source is not null and target_share > 0").collect()}
    weights = rake(cells, shares, total)
    spark = rows.sparkSession
    table = spark.createDataFrame([(c["source"], c["lang"], c["topic"], float(w)) for c, w in zip(cells, weights)], "source string, lang string, topic string, weight double")
    whole = F.floor("weight").cast("int")
    part = F.col("weight") - whole
    late = F.floor(F.col("draw") / GRAIN / part * STEPS)
    step = F.when(part > 0, F.least(F.lit(2 * STEPS), late)).otherwise(2 * STEPS).cast("int")
    drawn = rows.join(F.broadcast(table), ["source", "lang", "topic"]).withColumns({"whole": whole, "step": step})
    size = F.col("n_tokens")
    sums = drawn.groupBy("source", "step").agg(F.sum(size * F.col("weight")).alias("goal"), F.sum(size * F.col("whole")).alias("sure"), F.sum(size).alias("tokens")).collect()
    last = calibrated([r.asDict() for r in sums])
    limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair]) if last else F.create_map(F.lit(""), F.lit(0))
    repeats = F.col("whole") + (F.col("step") < limit[F.col("source")]).cast("int")
    return drawn.withColumn("repeats", F.least("max_repeats", repeats)).where("repeats > 0").drop("whole", "step", "weight")


def calibrated(sums: list[dict]) -> dict[str, int]:
    """Per source the step before which rests are taken, so that its tokens come closest to the goal.

    Texts lie on 2 * STEPS steps by their draw over their probability; without calibration the
    limit would be STEPS, and the tokens reached would vary with the draws.
    """
    out = {}
    for source in {r["source"] for r in sums}:
        own = sorted((r for r in sums if r["source"] == source), key=lambda r: r["step"])
        need = sum(r["goal"] - r["sure"] for r in own)
        best, far, taken = 0, abs(need), 0
        for r in own:
            if r["step"] < 2 * STEPS:
                taken += r["tokens"]
                if abs(taken - need) < far:
                    best, far = r["step"] + 1, abs(taken - need)
        out[source] = best
    return out


def share_report(chosen: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per target: tokens of the mixture, the share reached, and with ``rows`` of ``sized`` what there was of it.

    ``is_binding`` is the source whose tokens, at its repeats, allow the smallest mixture: it
    decides the mixture's size unless a total is given.
    """
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("mixed_tokens")).collect()[0][0] or 0
    out = targets.join(got, "source", "left").fillna({"mixed_tokens": 0, "n_texts": 0, "most_repeats": 0})
    out = out.withColumn("share", F.col("mixed_tokens") / F.lit(max(total, 1)))
    if rows is None:
        return out
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens")).where("own_tokens > 0")
    room = out.join(have, "source", "left").withColumn("room", F.when(F.col("target_share") > 0, F.col("own_tokens") * F.col("max_repeats") / F.col("target_share")))
    least = room.agg(F.min("room")).collect()[0][0]
    return room.withColumn("is_binding", F.coalesce(F.col("room") == F.lit(least), F.lit(False))).fillna({"own_tokens": 0}).drop("room")


def marginals(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(dim, name, own_share, share) of languages and topics: in the corpus of ``rows``, which is their goal, and in the mixture."""

    def shares(df: DataFrame, tokens: Column, name: str) -> DataFrame:
        sums = [df.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("name")).agg(F.sum(tokens).alias("t")) for dim in ("lang", "topic")]
        every = sums[0].unionAll(sums[1])
        # some hundred rows at most: the cells are bounded
        return every.withColumn(name, F.col("t") / F.sum("t").over(Window.partitionBy("dim"))).drop("t")

    own = shares(rows, F.col("n_tokens"), "own_share")
    got = shares(chosen, F.col("n_tokens") * F.col("repeats"), "share")
    return own.join(got, ["dim", "name"], "left").fillna({"share": 0.0})
