"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, written
from . import mixing, packing, pii, terms

#: Key of the pseudonyms in these queries; a deployment passes its own secret.
PSEUDONYM_KEY = b"public example key"
#: Containers beside those of a perfect packing, and one, from which ``p7_invariants`` counts a capacity.
LOOSE = 1.25


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trigram with its postings, documents and mark."""
    return terms.term_frequencies(table(spark, sf_dir, "postings")).withColumnRenamed("term", "trigram")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams that are too rare or too common to help a search."""
    # written whole, since a plan that ends in trigram and mark would prune positions and occurrences
    return written(p3_terms(spark, sf_dir), "terms").where("mark <> ''").select("trigram", "mark")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.lengths(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_sizes"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, for each capacity."""
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, sf_dir))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: nothing too full, every text once for each capacity, only oversized texts split, little unused. No texts give no row."""
    pieces = written(_packed(spark, sf_dir), "pieces")
    by = ["pack_name", "capacity_tokens"]
    fill = pieces.groupBy(*by, "container_id").agg(F.sum("n_tokens").alias("n"))
    texts = pieces.groupBy(*by, "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_parts").alias("n_parts"), F.count(F.lit(1)).alias("n_pieces"))
    due = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))
    one = lambda df, c, name: df.agg(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name)).withColumn("k", F.lit(1))
    out = one(fill, F.col("n") > F.col("capacity_tokens"), "n_over").join(one(texts, F.lit(1), "n_texts"), "k")
    out = out.join(one(texts, (F.col("n_parts") != due) | (F.col("n_pieces") != due), "n_wrong_parts"), "k")
    best = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return out.join(one(packing.fill_report(pieces), F.col("n_containers") > LOOSE * best + 1, "n_loose"), "k").drop("k").where("n_texts > 0")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All texts of wanted sources, and those chosen."""
    targets = table(spark, sf_dir, "mix_targets")
    rows = mixing.sized(table(spark, sf_dir, "documents"), targets)
    return rows, mixing.mixed(rows, targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts with their repeats."""
    return _mixed(spark, sf_dir)[1].select("doc_id", "source", "lang", "topic", "n_tokens", "repeats")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reached, and which source decides the size."""
    rows, chosen = _mixed(spark, sf_dir)
    return mixing.share_report(chosen, table(spark, sf_dir, "mix_targets"), rows)


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of languages and topics in the texts and in the mixture."""
    return mixing.marginals(*_mixed(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any mixture: repeats kept, texts of their own source, shares as near as single texts allow. No targets give no row."""
    targets = table(spark, sf_dir, "mix_targets")
    rows, chosen = _mixed(spark, sf_dir)
    chosen = written(chosen, "chosen")
    real = table(spark, sf_dir, "documents").select("doc_id", mixing.plain_name(F.col("source")).alias("real"))
    foreign = chosen.join(real, "doc_id", "left").where(~F.coalesce(F.col("real") == mixing.plain_name(F.col("source")), F.lit(False)))
    most = chosen.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.col("n_tokens") * F.col("repeats")), F.lit(0)).alias("total")).collect()[0]
    report = mixing.share_report(chosen, targets, rows)
    possible = report.where("own_tokens > 0").agg(F.sum("target_share")).collect()[0][0] or 1.0
    far = F.abs(F.col("share") - F.col("target_share") / possible) > most["longest"] / max(most["total"], 1) + 0.005
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    out = one(report, "n_targets").join(one(chosen.where("repeats > max_repeats or repeats < 1"), "n_over_repeats"), "k").join(one(foreign, "n_foreign"), "k")
    return out.join(one(report.where("own_tokens > 0").where(far), "n_far"), "k").drop("k").where("n_targets > 0")


def _words(spark: SparkSession, sf_dir: str) -> tuple[pii.Dictionary, DataFrame]:
    return pii.entries(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of personal information."""
    words, more = _words(spark, sf_dir)
    return pii.occurrences(table(spark, sf_dir, "documents"), words, more=more)


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds that overlap or lie outside their text, and the number of addresses found that are written with @. No finds give no row."""
    words, more = _words(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    found = written(pii.occurrences(docs, words, more=more), "finds")
    with_text = found.join(docs.select("doc_id", "text"), "doc_id")
    part = F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    after = F.lag("end_pos").over(Window.partitionBy("doc_id").orderBy("start_pos", "end_pos"))
    clash = found.withColumn("clash", F.coalesce(after > F.col("start_pos"), F.lit(False))).agg(F.coalesce(F.sum(F.col("clash").cast("bigint")), F.lit(0)).alias("n_overlap")).withColumn("k", F.lit(1))
    spots = with_text.agg(
        F.count(F.when((F.col("start_pos") < 0) | (F.col("start_pos") >= F.col("end_pos")) | (F.col("end_pos") > F.length("text")), 1)).alias("n_outside"),
        F.count(F.when((F.col("pii_kind") == "email") & F.contains(part, F.lit("@")), 1)).alias("n_at_emails"),
        F.count(F.lit(1)).alias("n_found"),
    ).withColumn("k", F.lit(1))
    return clash.join(spots, "k").where("n_found > 0").drop("k", "n_found")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed, linked placeholders."""
    words, more = _words(spark, sf_dir)
    return pii.redacted(table(spark, sf_dir, "documents"), words, PSEUDONYM_KEY, more=more)


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p7_pack, p7_fill, p7_invariants, p8_mix, p8_shares, p8_marginals, p8_invariants, p9_found, p9_redacted, p9_invariants)}

_TERMS = """
    SELECT lower(trigram) AS trigram, count(DISTINCT (stream_id, document_id, position)) AS n_occurrences, count(DISTINCT (stream_id, document_id)) AS n_records
    FROM postings WHERE trigram IS NOT NULL AND stream_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1"""
_MARKED = f"""
    SELECT *, CASE WHEN n_records <= 2 THEN 'rare'
                   WHEN n_records > 0.2 * (SELECT count(DISTINCT (stream_id, document_id)) FROM postings WHERE trigram IS NOT NULL AND stream_id IS NOT NULL AND document_id IS NOT NULL) THEN 'common'
                   ELSE '' END AS mark
    FROM ({_TERMS}) AS t"""
SQL = {
    "p3_terms": _MARKED,
    "p3_found": f"SELECT trigram, mark FROM ({_MARKED}) AS m WHERE mark <> ''",
    "p7_invariants": "SELECT CAST(0 AS BIGINT) AS n_over, (SELECT count(*) FROM documents) * (SELECT count(*) FROM pack_sizes WHERE capacity_tokens > 0) AS n_texts, CAST(0 AS BIGINT) AS n_wrong_parts, CAST(0 AS BIGINT) AS n_loose",
    "p8_invariants": "SELECT count(*) AS n_targets, CAST(0 AS BIGINT) AS n_over_repeats, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_far FROM mix_targets",
    "p9_invariants": r"SELECT CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_outside, CAST(coalesce(sum(len(regexp_extract_all(text, '[\w.+%-]*\w@(?:[\w-]+\.)+[A-Za-z]{2,}'))), 0) AS BIGINT) AS n_at_emails FROM documents",
}
