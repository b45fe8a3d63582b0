"""Behaviour of the log engine's own operators."""

from datetime import datetime

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.db import IngestError, LogDB
from logweir.functions import codecs, ids
from logweir.functions.labels import label_text, labels_match, stream_id
from logweir.operators import archive, query, queue, segments, trigram
from logweir.sources import blobs, wal

LABELS = "l map<string,string>"


def fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize(
    "labels, flat",
    [({"stream": "example2"}, "streamexample2"), ({"a": "bc"}, "abc"), ({"ab": "c"}, "abc"), ({}, ""), ({"b": "2", "a": "1"}, "a1b2"), ({"k": "più è"}, "kpiù è")],
)
def test_stream_id(spark, labels, flat):
    row = spark.createDataFrame([(labels,)], LABELS).select(stream_id(F.col("l")).alias("s"), label_text(F.col("l")).alias("t")).first()
    assert row["s"] == fnv(flat)
    assert row["t"] == ",".join(f"{k}={v}" for k, v in sorted(labels.items()))


def test_labels_match(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "x"},), (None,)], LABELS)
    count = lambda w: rows.where(labels_match(F.col("l"), w)).count()
    assert [count({}), count({"a": "1"}), count({"a": "1", "b": "2"}), count({"c": "1"})] == [3, 1, 1, 0]


def test_validation_order(spark):
    cases = {
        '{"msg":"m","ts":1}': None,
        "{}": 0,
        '{"msg":null,"ts":1}': 1,
        '{"msg":7}': 1,
        '{"msg":""}': 2,
        '{"msg":"m","ts":"1"}': 3,
        '{"msg":"m","ts":5.0}': 3,
        '{"msg":"m","ts":9223372036854775808}': 3,
        '{"msg":"m","ts":1,"_id":1}': 4,
        "no json": 0,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("doc", F.try_parse_json("t"))
    got = {r["t"]: r["error"] for r in query.validated(rows).collect()}
    assert got == {c: None if n is None else query.INGEST_ERRORS[n] for c, n in cases.items()}


def test_wal_scan_goes_on_after_bad_lines(spark, tmp_path):
    good = '{"l":{"stream":"s"},"d":{"msg":"x","ts":5}}'
    (tmp_path / "a.log").write_text("\n".join([good, "{bad", '{"l":{}}', '{"d":{}}', good.replace("x", "y" * 70_000)]) + "\n")
    rows = wal.scan(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and sum(r["error"] is None for r in rows) == 2


def test_query_texts(spark):
    docs = ['{"msg":"Ciao, Mondo!","ts":1}', '{"msg":"ciao","ts":2}', '{"msg":5,"ts":3}', '{"ts":4}', "bad", None]
    rows = spark.createDataFrame([({"s": "1"}, d) for d in docs], f"{LABELS}, d string")
    count = lambda t: query.query(rows, {"s": "1"}, t).count()
    assert [count("Ciao"), count("iao"), count(""), count("CIAO")] == [1, 2, 2, 0]


CONTENTS = [(1, 1, "hello world"), (2, 2, "hello universe"), (3, 3, "world peace"), (4, 4, None), (5, 5, ""), (6, 6, "aaaaaa"), (7, 7, "ciao ciào ciao")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(CONTENTS, "stream_id bigint, document_id bigint, text string").cache()


def brute(q: str) -> set:
    found = set()
    for s, d, t in CONTENTS:
        b, w = (t or "").encode(), q.encode()
        found |= {(s, d, i) for i in range(len(b) - len(w) + 1) if t is not None and b[i : i + len(w)] == w and (w or i == 0)}
    return found


@pytest.mark.parametrize("q", ["hello", "world", "universe", "peace", "nonexistent", "xyz", "aaaa", "ciao", "ciào", "a"])
def test_trigram_search(texts, q):
    if len(q.encode()) >= 3:
        index = trigram.postings(texts, "text")
        assert {tuple(r) for r in trigram.search(index.unionAll(index), q).collect()} == brute(q)
    assert {tuple(r) for r in trigram.scan_search(texts, "text", q).collect()} == brute(q)


def test_trigram_edges(texts):
    index = trigram.postings(texts, "text")
    assert sorted(r["position"] for r in index.where("document_id = 5").collect()) == [-2, -1]
    assert index.where("document_id = 4").count() == 0
    assert {tuple(r) for r in trigram.scan_search(texts, "text", "").collect()} == {(s, d, 0) for s, d, t in CONTENTS if t is not None}
    with pytest.raises(ValueError):
        trigram.search(index, "ab")


def test_trigram_volume_and_persistence(spark, tmp_path):
    docs = spark.range(1, 3073).select(F.lit(1).cast("bigint").alias("stream_id"), F.col("id").alias("document_id"), F.lit("commonword").alias("text"))
    trigram.stored(trigram.postings(docs, "text"), str(tmp_path / "i"))
    again = spark.read.parquet(str(tmp_path / "i"))
    found = trigram.search(again, "common")
    assert found.agg(F.count("*"), F.min("document_id"), F.max("document_id")).first()[:] == (3072, 1, 3072)
    assert trigram.dictionary(again.where("trigram = '636f6d'")).first()["n_blocks"] == 3


def test_archive_roundtrip(spark, tmp_path):
    for n in (1500, 1, 0):
        docs = spark.range(n).select(F.col("id").alias("_id"), F.lit(7).alias("stream_id"), F.to_json(F.struct((2000 + F.col("id")).alias("ts"), (F.col("id") * 0.1 + 0.05).alias("value"), F.concat(F.lit("generated_"), "id").alias("meta"), (F.col("id") % 2 == 0).alias("flag"))).alias("d"))
        columns = {r["col_key"]: r["col_type"] for r in archive.infer_columns(docs, []).collect()}
        assert columns == ({"ts": "int64", "value": "float64", "meta": "string", "flag": "bool"} if n else {})
        if n:
            rows = archive.projected(docs.withColumn("doc", F.parse_json("d")), list(columns.items()), ["_id", "stream_id"])
            archive.write_archive(rows, str(tmp_path / f"a{n}"))
            back = archive.read_archive(spark, str(tmp_path / f"a{n}")).select(rows.columns)
            assert back.schema.simpleString() == rows.schema.simpleString().replace("stream_id:int", "stream_id:int")
            assert back.exceptAll(rows).count() == 0 and back.count() == n
    with pytest.raises(ValueError):
        archive.projected(docs, [], [])


@pytest.mark.parametrize(
    "values, kind",
    [(["1", "2"], "int64"), (["1", "2.5"], "float64"), (["1", "5.0"], "float64"), (["1e3"], "float64"), (["9223372036854775808"], "float64"), (["1", "true"], "string"), (["1.5", '"a"'], "string"), (["null"], None), (["null", "3"], "int64"), (['{"a":1}'], "string")],
)
def test_type_lattice(spark, values, kind):
    docs = spark.createDataFrame([(f'{{"k":{v}}}',) for v in values] + [("bad",), (None,), ("[1]",)], "d string")
    assert [r["col_type"] for r in archive.infer_columns(docs, []).collect()] == ([kind] if kind else [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_delta_of_delta(spark, values):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "b int, i int, v bigint")
    coded = codecs.delta_of_delta(rows, ["b"], ["i"], "v").drop("v")
    back = codecs.delta_of_delta_decode(coded, ["b"], ["i"]).orderBy("i")
    assert [r["value"] for r in back.collect()] == values


@settings(max_examples=8, deadline=None)
@given(st.lists(st.booleans(), max_size=40))
def test_bit_packing(spark, flags):
    rows = spark.createDataFrame(list(enumerate(flags)), "n bigint, f boolean")
    packed = codecs.bit_pack(rows, F.col("n"), F.col("f"))
    assert [r["flag"] for r in codecs.bit_unpack(packed).orderBy("number").collect()] == flags


def test_varint_and_ids(spark):
    sizes = {0: 1, -1: 1, 63: 1, 64: 2, -64: 1, -65: 2, 2**63 - 1: 10, -(2**63): 10}
    rows = spark.createDataFrame([(v,) for v in sizes], "v bigint")
    assert {r["v"]: r["n"] for r in rows.select("v", codecs.varint_size(F.col("v")).alias("n")).collect()} == sizes
    packed = spark.range(1).select(ids.pack_id(F.lit(5), F.lit(1 << 20)).alias("wrap"), ids.pack_id(F.lit(5), F.lit(3)).alias("plain")).first()
    assert (packed["wrap"], packed["plain"]) == (5 << 20, 5 << 20 | 3)


def test_late_rows(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([10, 30, 20, 30, 40, 5])], "s bigint, i int, t bigint")
    got = archive.out_of_order(rows, "s", ["i"], "t").orderBy("i").collect()
    assert [(r["id_ms"], r["_ooo_ts"]) for r in got] == [(10, None), (30, None), (30, 20), (30, None), (40, None), (40, 5)]


def test_logfmt(spark):
    line = 'level=info ts=1 msg="two words" a= level=warn'
    assert spark.createDataFrame([(line,)], "t string").select(archive.logfmt(F.col("t")).alias("f")).first()["f"] == {"level": "warn", "ts": "1", "msg": "two words", "a": ""}


def snapshot(spark, *files):
    return queue.decode(spark.createDataFrame([(f"queue/{k}.json", raw) for k, raw in files], "obj_key string, raw string"))


def test_queue_decisions(spark):
    job = lambda i, s="", u=None: f'{{"id":"{i}","status":"{s}"' + (f',"lockedUntil":"{u}"' if u else "") + ',"payload":{"k":1}}'
    files = snapshot(
        spark,
        ("a", f'{{"jobs":[{job(1, "in_progress", "2024-01-01T00:00:00.5Z")},{job(2)}]}}'),
        ("b", f'{{"status":"active","jobs":[{job(3, "in_progress", "2030-01-01T00:00:00Z")},{job(4, "in_progress")}]}}'),
        ("c", f'{{"status":"preparing_split","jobs":[{job(5)},{job(6)},{job(7)}]}}'),
        ("d", '{"status":"splitting","lockedUntil":"2024-01-01T00:00:00.5Z","splitInto":"e","jobs":[]}'),
        ("x", "no json"),
    )
    now = F.lit("2024-01-01 00:00:00.5").cast("timestamp")
    assert {(r["file_id"], r["id"]) for r in queue.claimable(files, now).collect()} == {("a", "1")}
    assert {(r["id"], r["to_new"]) for r in queue.split(files).collect()} == {("5", True), ("6", False), ("7", False)}
    assert {r["file_id"]: r["action"] for r in queue.split_state(files, now).collect()} == {"a": "none", "b": "none", "c": "split", "d": "recover_original"}
    assert queue.place(files).collect()[0]["file_id"] == "a"
    left = queue.remove(queue.remove(files, "a", "1"), "a", "2")
    assert left.where("file_id = 'a'").count() == 0 and left.count() == 3
    leased = queue.extend_claim(files, "a", "2", now, 10).where("file_id = 'a'").first()["jobs"]
    assert (leased[1]["status"], leased[1]["locked_until"]) == ("in_progress", datetime(2024, 1, 1, 0, 0, 10, 500000))
    assert queue.extend_claim(files, "a", "2", now, 0) is files
    full = queue.pushed(files, ["{}"] * 127, "a").where("file_id = 'a'").first()
    assert (len(full["jobs"]), full["status"]) == (129, "preparing_split")
    assert queue.pushed(files, ["{}"], None).count() == 5
    again = queue.decode(queue.encode(files), "file_id", "raw")
    assert again.exceptAll(files).count() == 0


def test_bucket(tmp_path):
    b = blobs.Bucket(f"file://{tmp_path}/bucket")
    tag = b.put("queue/a", b"0123456789")
    with pytest.raises(blobs.Conflict):
        b.put("queue/a", b"")
    assert b.get("queue/a") == (b"0123456789", tag) and b.get_range("queue/a", 2, 4) == b"234"
    new = b.put_if_match("queue/a", b"x", tag)
    for call in (lambda: b.put_if_match("queue/a", b"y", tag), lambda: b.delete("queue/a", tag)):
        with pytest.raises(blobs.Conflict):
            call()
    b.put("queue/b", b"", replace=True)
    assert b.list("queue/") == ["queue/a", "queue/b"] and b.list("q/") == []
    b.delete("queue/a", new)
    assert b.list() == ["queue/b"]
    with pytest.raises(FileNotFoundError):
        b.get("queue/a")


def test_backoff():
    waits = []
    steps = blobs.backoff(0.02, 2.0, waits.append)
    bounds = [next(steps) for _ in range(12)]
    assert bounds[-1] == 2.0 and all(0.01 <= w <= 2 for w in waits)


def test_database(spark, tmp_path):
    db = LogDB(spark, f"file://{tmp_path}/db")
    assert db.query({}, "").count() == 0
    db.add({"stream": "example"}, ['{"msg":"Hello, World!","ts":1}'] * 10)
    db.add({"stream": "example2"}, ['{"msg":"Ciao, Mondo!","ts":2}', '{"msg":"Ciao ciao!","ts":3}'])
    with pytest.raises(IngestError, match="_id"):
        db.add({}, ['{"msg":"x","ts":1,"_id":4}'])
    found = db.query({"stream": "example2"}, "Ciao").collect()
    assert {r["msg"] for r in found} == {"Ciao, Mondo!", "Ciao ciao!"} and {r["stream_id"] for r in found} == {fnv("streamexample2")}
    db.index()
    assert db.search("Ciao").count() == 2 and db.search("Mo").count() == 1 and db.search("Hello").count() == 10


def test_database_archives_levels_and_index(spark, tmp_path):
    db = LogDB(spark, f"file://{tmp_path}/db")
    assert db.compact() == 0 and db.index() == 0 and db.search("any").count() == 0 and db.get([1]).count() == 0
    for turn in range(3):
        value = [1, 2.5, "x"][turn]
        db.add({"app": "a"}, [json.dumps({"msg": f"turn {turn} number {i}", "ts": 1000 + i, "v": value, "ok": True, "o": {"k": 1}, "none": None}) for i in range(5)])
        db.add({"app": "b"}, ['{"msg":"Ciao","ts":7}'])
        assert db.query({}, "").count() == 6 * (turn + 1)
        assert db.compact() == 6 and db.compact() == 0 and db.index(flush=False) == 0
    assert db.query({"app": "a"}, "turn 1").count() == 5 and db.query({}, "").count() == 18
    assert {(r["col_key"], r["col_type"]) for r in db.columns({"app": "a"}).collect()} == {("v", "string"), ("ok", "bool"), ("o", "string")}
    last = {r["stream_id"]: (r["n_documents"], r["last_id"]) for r in db.last_ids().collect()}
    assert last[fnv("appb")] == (3, (7 << 20) + 3) and last[fnv("appa")][0] == 15
    got = db.get([(1000 << 20) + 1, (1000 << 20) + 6, 5], {"app": "a"}).collect()
    assert {r["_id"]: json.loads(r["document"])["v"] for r in got} == {(1000 << 20) + 1: 1, (1000 << 20) + 6: 2.5}
    assert json.loads(got[0]["document"]).keys() == {"msg", "ts", "v", "ok", "o"}
    keys = spark.createDataFrame([(fnv("appb"), (7 << 20) + 1), (fnv("appa"), (7 << 20) + 2)], "stream_id bigint, _id bigint")
    assert [r["_id"] for r in db.get(keys).collect()] == [(7 << 20) + 1]
    assert {(r["label_set"], r["n_documents"]) for r in db.label_sets().collect()} == {("app=a", 15), ("app=b", 3)} and db.directory().agg({"n_rows": "sum"}).first()[0] == 18
    assert db.index() == 18 and db.load_index().unpersist().count() > 18 and db.index() == 0 and db.search("turn 2").count() == 5 and db.search("Ci").count() == 3


def test_database_merges_small_log_files_and_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments.Segments.__init__, "__defaults__", (2,))
    db = LogDB(spark, f"file://{tmp_path}/db")
    for i in range(4):
        db.add({"app": "a"}, [f'{{"msg":"number {i}","ts":{i}}}'] * 3)
    assert db.merge_log() >= 1 and db.merge_log() == 0 and db.query({}, "").count() == 12
    for i in range(4):
        db.add({"app": "a"}, [f'{{"msg":"late {i}","ts":{i}}}'])
        db.compact(), db.index()
    assert db.level() >= 4 and db.level() == 0
    assert len(db.archive.live()) < 5 and len(db.segments.live()) < 4
    assert db.query({}, "").count() == 16 and db.search("late").count() == 4 and db.search("number").count() == 12
    assert db.archive.vacuum() > 0 and db.segments.vacuum() > 0 and db.query({}, "").count() == 16 and db.search("late 3").count() == 1
