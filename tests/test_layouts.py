"""Headers of programs whose layouts are rare or do not begin with their time."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from logweir.operators import logparse
from logweir.plans import core

MS = 1735689600000  # 2025-01-01 00:00:00
RECORD = "rec_no bigint, stream_id bigint, received_at timestamp, d string"
RESULT = "stream_id bigint, document_id bigint, document string"


def parsed(spark, messages):
    rows = [(i, 1, datetime(2025, 1, 1), json.dumps({"msg": m, "ts": MS})) for i, m in enumerate(messages)]
    out = logparse.entries(spark.createDataFrame(rows, RECORD), spark.createDataFrame([], RESULT), texts=True).collect()
    return {r["first_id"]: (r["ts_ms"], r["lvl"], r["component"], r["message"]) for r in out}


def test_headers_with_time_behind_other_tokens(spark):
    at = "2025-01-01 00:00:01"
    said = ["opened", "closed", "retried"]
    messages = [f"ERROR [a.b] {at} failed"] + [f"[warn] {at} {w} it" for w in said] + [f"gate[7]: INFO {at} - {w}" for w in said]
    prose = [f"> {at} ERROR a.b {w}" for w in said] + [f"lease valid until {at}, owner {w}" for w in said] + [f"debug {at} quoted by {w}" for w in said] + [f"  INFO a.b {at} {w}" for w in said]
    got = parsed(spark, messages + prose)
    t = MS + 1000
    want = [(t, "ERROR", "a.b", "failed"), *[(t, "WARN", "", f"{w} it") for w in said], *[(t, "INFO", "gate", w) for w in said]]
    assert got == dict(enumerate(want))


def test_rare_layout_among_many_lines(spark):
    # shapes as counted: a program of five lines beside one of two million
    often, rare = (f"{logparse.TIME} {mark} " for mark in (logparse.LEVEL, f"({logparse.LEVEL}) {logparse.NAME}:"))
    shapes = spark.createDataFrame([(often + "went", 2_000_000, often), (rare + "came", 5, rare), ("text", 9, "")], "shape string, n bigint, head string")
    assert {r["head"]: r["n_lines"] for r in logparse.layouts(shapes).collect()} == {often: 2_000_000, rare: 5}


def test_logfmt_of_every_first_key(spark, sf):
    got = core.QUERIES["logfmt_lines"](spark, sf).collect()
    first = {json.loads(r["d"])["msg"].partition("=")[0] for r in spark.read.parquet(f"{sf}/wal_records.parquet").where(F.col("rec_no").isin(*[r["rec_no"] for r in got])).collect()}
    assert len(first) > 1 and all(r["lvl"] and r["at"] for r in got)


WORDS = ["opened", "closed", "retried", "merged", "split", "lost", "found", "kept", "sent", "read", "wrote", "slept"]


def unseen(n=60):
    """Lines of layouts that no pattern is written for, with what is to be read from each."""
    messages, want = [], []
    for i in range(n):
        said = f"{WORDS[i % 12]} {WORDS[i * 5 % 12]} it"
        at, level, ms = f"2025-01-01 00:00:{i % 60:02d}", ["INFO", "ERROR"][i % 2], MS + i % 60 * 1000
        messages += [f"{at} worker main {level} a.b - {said}", f"gate speaks {level} at {at} | {said}", f"lease of gate valid until {at} unless {said}"]
        want += [(ms, level, "a.b", said), (ms, level, "gate", said), None]
    return messages, {i: w for i, w in enumerate(want) if w}


def test_unseen_layouts_are_read_by_the_dictionaries(spark):
    messages, want = unseen()
    assert parsed(spark, messages) == want


def test_without_dictionaries_the_words_of_a_header_are_not_known(spark, monkeypatch):
    messages, want = unseen()
    grams = logparse.dictionaries
    monkeypatch.setattr(logparse, "dictionaries", lambda shapes: grams(shapes).limit(0))
    got = parsed(spark, messages)
    assert got != want and not any(r[2] == "gate" for r in got.values()) and not any(r[1] for r in got.values())


def test_long_dotted_components_are_whole(spark):
    name = ".".join("abcdefghijklmnopqrstuvwxyz")
    at = "2025-01-01 00:00:01"
    assert parsed(spark, [f"{at} INFO {name}: opened"]) == {0: (MS + 1000, "INFO", name, "opened")}


def test_hot_contexts_and_long_lines(spark):
    long = "2025-01-01 00:00:01 INFO a.b: " + "word " * 20_000
    got = parsed(spark, [long, "x" * 200_000, "2025-01-01 00:00:01", "", "\n"])
    assert got[0][:3] == (MS + 1000, "INFO", "a.b") and set(got) == {0, 2}
