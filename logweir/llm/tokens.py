"""Tokens of texts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# How a byte-level tokenizer cuts a text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blanks in a row that the quicker library's pattern is not trusted with: it keeps a stack of them.
LONG_BLANK = 2000
_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one beyond 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes of a plain byte-level BPE's tokens with their ids; None unless ids follow the order of merging."""
    content, letters = model["model"], _byte_letters()
    cut = model.get("pre_tokenizer") or {}
    odd = (model.get("normalizer"), model.get("post_processor"), content.get("dropout"), content.get("unk_token"), content.get("continuing_subword_prefix"), content.get("end_of_word_suffix"), content.get("byte_fallback"))
    if content.get("type") != "BPE" or any(odd) or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    if not all(t.get("special") for t in model.get("added_tokens", ())):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in content["merges"]]
    if any(content["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special = {t["content"] for t in model.get("added_tokens", ())}
    return {bytes(letters[c] for c in token): number for token, number in content["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Token ids of texts. Plain byte-level BPE goes through the quicker of two libraries that agree on it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    sure = Tokenizer.from_file(path)
    sure.encode_special_tokens = True
    surely = lambda texts: [e.ids for i in range(0, len(texts), 256) for e in sure.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        ranks = _ranks(json.load(f))
    if ranks is None:
        return surely
    import tiktoken

    quick = tiktoken.Encoding("byte-level", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [surely([t])[0] if len(t) > LONG_BLANK and _BLANK.search(t) else quick.encode_ordinary(t) for t in texts]


def n_tokens(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Number of tokens of the whole text; 0 for null and empty. Special tokens count as text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            yield pd.Series([len(encode([t])[0]) if t else 0 for t in texts], dtype="int64")

    return count(text)
