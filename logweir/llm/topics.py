"""Topics of texts, learned from which tokens stand together in the corpus.

Every text is encoded once, and its distinct tokens are counted over all texts. The TERMS words that
are in most texts, but in no more than COMMON of them, are features; how often each two stand in one
text is counted over all texts as well. Words whose neighbours are alike are one topic: the rows of
positive pointwise mutual information are clustered on the driver, which is a matrix of TERMS by
TERMS whatever the corpus. A text has the topic of most of its features, by their rarity.

Defined results: a text without features is 'general', as is every text of a corpus without any;
ties go to the topic named first; repeated texts count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import DEFAULT_TOKENIZER, encoder

#: Words that make up the model, and topics: the size of the model, not of the corpus.
TERMS, TOPICS = 128, 12
#: Share of the texts that a word may be in at most, and must be in at least.
COMMON, RARE = 0.2, 0.002


def encoded(documents: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The kept columns, ``n_tokens`` and ``tokens``, the distinct token ids of each text, in one pass."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            sizes, ids = [], []
            for t in batch.column(text).to_pylist():
                found = encode([t])[0] if t else []
                sizes.append(len(found))
                ids.append(np.unique(np.asarray(found, np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "n_tokens", "tokens"])

    return documents.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens bigint, tokens array<int>")


def _features(rows: DataFrame, tokenizer: str) -> tuple[list[int], list[str], np.ndarray, int]:
    """Ids, words and text counts of the features, and the number of texts. A vocabulary bounds what is gathered."""
    from tokenizers import Tokenizer

    n = rows.count()
    often = rows.select(F.explode("tokens").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= COMMON * n) & (F.col("n") >= max(2, RARE * n))).collect()
    t = Tokenizer.from_file(tokenizer)
    known = sorted((-r["n"], r["id"], t.decode([r["id"]])) for r in often)
    words = [(m, i, w.strip().lower()) for m, i, w in known if w.startswith(" ") and w.strip().isalpha() and len(w) > 4][:TERMS]
    return [i for _, i, _ in words], [w for _, _, w in words], np.array([-m for m, _, _ in words]), n


def _membership(tokens: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Texts by features: 1 where a text has a feature. ``ids`` are sorted."""
    flat = tokens.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    spot = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    hit = ids[spot] == flat
    out = np.zeros((len(tokens), len(ids)), np.float32)
    out[row[hit], spot[hit]] = 1
    return out


def _together(rows: DataFrame, ids: np.ndarray) -> np.ndarray:
    """Number of texts that hold each two features; one matrix a task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ids), len(ids)))
        for batch in batches:
            x = _membership(batch.column("tokens"), ids)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    out = np.zeros((len(ids), len(ids)))
    for r in rows.select("tokens").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def _clusters(both: np.ndarray, n: int, size: int) -> np.ndarray:
    """Cluster of each feature: spherical k-means of mutual information, begun with features far from each other."""
    alone = np.diag(both)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(both * n / np.outer(alone, alone))
    x = np.nan_to_num(np.maximum(pmi, 0), posinf=0, neginf=0)
    np.fill_diagonal(x, x.max(initial=1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < min(size, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centre = x[chosen]
    for _ in range(30):
        of = np.argmax(x @ centre.T, axis=1)
        new = np.stack([x[of == k].sum(axis=0) if (of == k).any() else centre[k] for k in range(len(centre))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.allclose(new, centre):
            break
        centre = new
    return of


def with_topics(rows: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, terms: int = TERMS, topics: int = TOPICS) -> DataFrame:
    """Replaces ``tokens`` of written rows by ``topic``."""
    keep = [c for c in rows.columns if c != "tokens"]
    ids, words, often, n = _features(rows, tokenizer)
    if len(ids) < 2:
        return rows.select(*keep, F.lit("general").alias("topic"))
    order = np.argsort(ids)
    ids, words, often = np.array(ids)[order], [words[i] for i in order], often[order]
    of = _clusters(_together(rows, ids), n, topics)
    weight = np.zeros((len(ids), of.max() + 1))
    weight[np.arange(len(ids)), of] = np.log(n / often)
    # a topic is named by the feature of it that is in most texts
    names = [words[max(np.flatnonzero(of == k), key=lambda i: (often[i], -i))] if (of == k).any() else "" for k in range(of.max() + 1)]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _membership(batch.column("tokens"), ids) @ weight
            best = np.where(score.max(axis=1) > 0, score.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([names[b] if b >= 0 else "general" for b in best], pa.string())], names=[*keep, "topic"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", topic string")
