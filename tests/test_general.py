"""Small files, log parsing, deliveries, skew and drift: against brute force and on edge cases."""

import json
from collections import Counter
from datetime import datetime

import duckdb
import logreference
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logweir.functions.labels import label_text
from logweir.operators import compaction, dedup, drift, logparse, skew
from logweir.plans import general
from logweir.session import table

T0 = datetime(2024, 12, 10)


# --- small files


def test_blocks_are_copied_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = pa.table({"a": list(range(1000)), "s": [None if i % 7 == 0 else "è" * (i % 50) for i in range(1000)], "m": [[("k", i)] for i in range(1000)]}, schema=pa.schema([("a", pa.int64()), ("s", pa.string()), ("m", pa.map_(pa.string(), pa.int64()))]))
    for i in range(10):
        pq.write_table(t.slice(i * 100, 100), tmp_path / f"in/{i}.parquet", row_group_size=40, compression=["zstd", "snappy", "none"][i % 3], use_dictionary=i % 2 == 0)
    pq.write_table(t.slice(0, 0), tmp_path / "in/empty.parquet")
    pq.write_table(pa.table({"other": [1.5]}), tmp_path / "in/other.parquet")
    done = compaction.copy_blocks(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 6000).collect()
    assert sum(r["n_rows"] for r in done) == 1001 and sum(r["n_blocks"] for r in done) == 31 and 3 <= len(done) < 10
    back = [pq.read_table(r["path"]) for r in done]
    rows = sorted((x for b in back if "a" in b.column_names for x in b.to_pylist()), key=lambda x: x["a"])
    assert rows == t.to_pylist()
    assert spark.read.parquet(*[r["path"] for r in done if r["n_rows"] > 1]).agg(F.sum("a")).first()[0] == sum(range(1000))


def test_only_empty_files_and_no_parquet(spark, tmp_path):
    (tmp_path / "e").mkdir()
    pq.write_table(pa.table({"a": pa.array([], pa.int64())}), tmp_path / "e/0.parquet")
    assert compaction.copy_blocks(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/eo").first()["n_rows"] == 0
    (tmp_path / "e/bad.parquet").write_bytes(b"PAR1 this is none")
    with pytest.raises(Exception, match="Parquet"):
        compaction.copy_blocks(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/eo2").collect()


def test_objects_hold_each_record_once(spark):
    line = lambda s, i, m="x": json.dumps({"l": {"stream": s}, "d": {"_id": i, "msg": m, "ts": 1}})
    rows = [
        ("wal/1", T0, "\n".join([line("a", 1), line("a", "2"), "", '{"l":{"str', line("b", 1)])),
        ("wal/2", T0.replace(day=11), "\r\n".join([line("a", 1, "newer"), line("a", 3), '{"l":{},"d":{}}', '{"l":{},"d":{}}'])),
        ("wal/3", T0, ""),
        ("wal/4", T0, None),
        ("queue/1.json", T0, '{"jobs":[{"id":"aB","status":"pending"},{"id":"c"}]}'),
        ("queue/2.json", None, '{"jobs":[{"id":"ab"},{"id":null}]}'),
        ("queue/3.json", T0, '{"jobs":'),
        ("queue/4.json", T0, "{}"),
        (None, None, None),
    ]
    out = compaction.consolidated_objects(spark.createDataFrame(rows, "obj_key string, modified_at timestamp, raw string")).collect()
    got = Counter((r["obj_kind"], r["stream_name"], r["rec_key"]) for r in out)
    want = [("wal", "a", "1"), ("wal", "a", "2"), ("wal", "a", "3"), ("wal", "b", "1"), ("wal", None, None), ("queue", "", "ab"), ("queue", "", "c"), ("queue", "", None)]
    assert got == Counter(want)
    assert "newer" in next(r["body"] for r in out if r["rec_key"] == "1" and r["stream_name"] == "a")
    empty = spark.createDataFrame([], "obj_key string, modified_at timestamp, raw string")
    assert compaction.consolidated_objects(empty).count() == 0


# --- logs


def as_tuples(df):
    return Counter(tuple(r) for r in df.select("tab", "stream_id", "first_id", "last_id", "ts_ms", "lvl", "component").collect())


def test_logs_match_plain_parser(spark, sf):
    con = duckdb.connect()
    records = con.sql(f"SELECT rec_no, stream_id, d FROM '{sf}/wal_records.parquet'").fetchall()
    results = con.sql(f"SELECT stream_id, document_id, document FROM '{sf}/query_results.parquet'").fetchall()
    assert as_tuples(general.p2_found(spark, sf)) == Counter(logreference.entries(records, results))


RECORD = "rec_no bigint, stream_id bigint, received_at timestamp, d string, msg string"
RESULT = "stream_id bigint, document_id bigint, document string, near string"


def test_log_edge_cases(spark):
    ms = 1735689600000  # 2025-01-01 00:00:00
    doc = lambda m, ts=ms: json.dumps({"msg": m, "ts": ts})
    long = "2024-12-10 06:37:46,093 WARN  [t-1] a.b - " + "x" * 300_000
    records = [
        (1, 1, T0, doc("Dec 31 23:59:59 host-1 prog[5]: said"), "clash"),
        (2, 1, T0, doc("23:59:59.500 W/a.b(7): said"), None),
        (3, 1, T0, doc(long), None),
        (4, None, None, "bad", None),
        (5, None, None, None, None),
        (6, 1, T0, doc(""), None),
        (7, 1, T0, json.dumps({"msg": None, "ts": ms}), None),
        (8, None, None, json.dumps({"msg": "<11>Jan  1 00:00:01 h-1 p-q[5]: x"}), None),
        (9, 1, T0, doc("no header"), None),
    ]
    line = [(9, 1, doc("stray")), (9, 2, doc("2024-12-10 06:37:46,093 INFO  [t-1] a.b - one")), (9, 3, doc("  two")), (9, 3, doc("  two")), (9, 4, doc("")), (9, 5, doc("2024-12-10 06:37:47,000 - c.d - CRITICAL - next")), (8, 6, doc("alone")), (None, 7, doc("2024-12-10 06:37:47,000 - c.d - ERROR - null stream")), (9, None, None)]
    r, q = spark.createDataFrame(records, RECORD), spark.createDataFrame([(*x, "clash") for x in line], RESULT)
    got = as_tuples(logparse.entries(r, q))
    assert got == Counter(
        [
            ("wal_records", 1, 1, 1, ms - 1000, "", "prog"),
            ("wal_records", 1, 2, 2, ms - 500, "WARN", "a.b"),
            ("wal_records", 1, 3, 3, 1733812666093, "WARN", "a.b"),
            ("wal_records", None, 8, 8, None, "ERROR", "p-q"),
            ("query_results", 9, 2, 4, 1733812666093, "INFO", "a.b"),
            ("query_results", 9, 5, 5, 1733812667000, "FATAL", "c.d"),
            ("query_results", None, 7, 7, 1733812667000, "ERROR", "c.d"),
        ]
    )
    texts = {(x["tab"], x["first_id"]): x["message"] for x in logparse.entries(r, q, texts=True).collect()}
    assert texts["query_results", 2] == "one\n  two\n" and texts["wal_records", 1] == "said" and len(texts["wal_records", 3]) == 300_000
    assert logparse.entries(r.limit(0), q.limit(0)).count() == 0


# --- deliveries


def spell(n):
    h = f"{n:032x}"
    return [h, h.upper(), f" {h}\n", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{n:x}", "{" + h + "}", "0x" + h]


def test_deliveries(spark, tmp_path):
    rows, no = [], 0
    for n in (0, 1, 0xABC, 2**128 - 1):
        for text in spell(n):
            no += 1
            rows.append((no, T0.replace(minute=no % 3), text, None if no % 2 else "p" * no, f"s{no}"))
    rows += [(100 + i, T0, None, None, None) for i in range(3)] + [(200, T0, "not hex", "", None), (201, None, "ff", "", None), (202, T0, "FF", "", None)]
    rows += [(1000 + i, T0, "77", "hot", None) for i in range(40_000)]
    schema = "delivery_no bigint, delivered_at timestamp_ntz, id string, payload string, row string"
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, schema).repartition(3).write.option("parquet.block.size", 1 << 16).parquet(path)
    ident, order = dedup.id128(F.col("id")), ["delivered_at", "delivery_no"]
    want, first = set(), {}
    number = lambda t: int(t.strip().strip("{}").lower().removeprefix("0x").replace("-", ""), 16)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        if r[2] is not None and r[2] != "not hex":
            if number(r[2]) in first:
                want.add(r[0])
            first.setdefault(number(r[2]), r[0])
    got = [r[0] for r in dedup.surplus_rows(spark, path, ident, order, ["delivery_no"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = dedup.survivors(spark, path, ident, order, ["delivery_no", "payload", "row"])
    assert sorted(r[0] for r in left.collect()) == sorted({r[0] for r in rows} - want)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e"))
    assert dedup.surplus_rows(spark, str(tmp_path / "e"), ident, order, ["delivery_no"]).count() == 0


# --- skew


@pytest.mark.parametrize("chunk", [7, 1000])
def test_keyed_runs(spark, chunk):
    rows = [("hot", i * i % 977, i) for i in range(600)] + [(None, 5, 1000), (None, None, 1001), ("", 3, 1002)] + [(f"k{i % 50}", i % 9, 2000 + i) for i in range(300)] + [("tie", 4, 3000)] * 20
    df = spark.createDataFrame([(*r, "x") for r in rows], "name string, v bigint, no bigint, key string")
    got = {r["key"]: r for r in skew.keyed_runs(df, F.col("name"), F.col("v"), F.col("no"), chunk).collect()}
    for k in {r[0] for r in rows}:
        vs = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        steps = [b - a for a, b in zip(vs, vs[1:])]
        n = sum(r[0] == k for r in rows)
        assert (got[k]["n_rows"], got[k]["first_value"], got[k]["last_value"], got[k]["max_step"], got[k]["n_chunks"]) == (n, vs[0], vs[-1], max(steps, default=None), -(-n // chunk)), k
    assert len(got) == len({r[0] for r in rows})
    heavy = skew.heavy_keys(skew.keyed_runs(df, F.col("name"), F.col("v"), F.col("no"), chunk), 0.05)
    assert [r["key"] for r in heavy.collect()] == ["hot"]
    assert skew.keyed_runs(df.limit(0), F.col("name"), F.col("v"), F.col("no")).count() == 0


def test_label_text_has_no_collisions(spark):
    rows = spark.createDataFrame([({"a": "bc"},), ({"ab": "c"},), ({},), (None,)], "l map<string,string>")
    assert {r[0] for r in rows.select(label_text(F.col("l"))).collect()} == {"a=bc", "ab=c", "", None}


# --- drift

WAL, DEFS = "rec_no bigint, stream_id bigint, file_no int, d string, col_key string", "stream_id bigint, file_no int, col_key string, col_type int, kind string"


def changes_of(spark, files, definitions=(), stream=1):
    """files: per file the documents as dicts or text."""
    rows = [(i, stream, no, d if d is None or isinstance(d, str) else json.dumps(d), "clash") for i, (no, d) in enumerate((no, d) for no, ds in files.items() for d in ds)]
    rows += [(-1, None, 0, '{"z":1}', None), (-2, stream, None, '{"z":1}', None)]
    out = drift.changes(spark.createDataFrame(rows, WAL), spark.createDataFrame([(*x, None) for x in definitions], DEFS))
    return {(r["file_no"], r["change_kind"], r["col_key"], r["col_to"]) for r in out.collect()}


def test_drift_cases(spark):
    same = {"msg": "m", "ts": 1}
    files = {
        0: [same | {"n": 1, "old": "a", "bye": 900, "gap": 1, "flag": True}, same | {"old": "b"}, "bad", None, "[]", "{}"],
        1: [same | {"n": 2.5, "old": "a", "bye": 901, "flag": False, "nul": None}, same | {"n": 1, "old": "b", "bye": 905}],
        3: [same | {"n": "x", "new": "a", "gap": 2, "late": 7}, same | {"new": "b", "other": False}],
        4: [same | {"n": "x", "new": "b", "gap": 2, "late": 8, "other": True}],
    }
    assert changes_of(spark, files) == {
        (1, "retyped", "n", "float64"), (3, "retyped", "n", "string"), (3, "renamed", "old", "new"), (3, "removed", "bye", ""),
        (3, "added", "late", "int64"), (3, "removed", "flag", ""), (3, "added", "other", "bool"),
    }


def test_drift_takes_stored_definitions(spark):
    files = {0: [{"a": 1}], 1: [{"a": 1}]}
    told = [(1, 0, "a", 0), (1, 0, "a", 0), (1, 1, "a", 2), (1, 1, "b", 3), (1, 2, "b", 3), (None, 0, "q", 0), (1, None, "q", 0), (1, 0, None, 0), (1, 0, "w", None), (1, 0, "w", 9)]
    assert changes_of(spark, files, told) == {(1, "retyped", "a", "string"), (1, "added", "b", "bool"), (2, "removed", "a", "")}
    assert changes_of(spark, {}, []) == set()


def test_one_table_follows_names(spark):
    rows = [(0, {"a": 1, "ts": 5}), (0, {"a": 2}), (1, {"b": 1}), (1, {"b": 2.5, "msg": "x"}), (2, {"c": 2}), (2, {"c": 1}), (2, {"c": None})]
    wal = spark.createDataFrame([(i, 1, f, json.dumps(d), None) for i, (f, d) in enumerate(rows)], WAL)
    out = drift.one_table(wal, spark.createDataFrame([], DEFS), ["rec_no"]).orderBy("rec_no").collect()
    assert [r["c"] for r in out] == [1.0, 2.0, 1.0, 2.5, 2.0, 1.0, None] and out[0]["ts"] == 5 and out[3]["msg"] == "x"
    few = drift.one_table(wal, spark.createDataFrame([], DEFS), ["rec_no"], most=1).orderBy("rec_no").collect()
    assert [r["rest"].get("ts") for r in few] == ["5", *[None] * 6] and few[4]["c"] == 2.0


def test_islands_are_counted_from_the_first_type(spark):
    columns = spark.createDataFrame([(1, f, "a", t) for f, t in enumerate(["int64", "int64", "string", "int64"])] + [(1, 9, "b", "bool")], "stream_id bigint, file_no int, col_key string, col_type string")
    spans = drift.lifespans(columns)
    assert {(r["col_key"], r["island"], r["first_file"], r["last_file"], r["n_files"]) for r in spans.collect()} == {("a", 1, 0, 1, 2), ("a", 2, 2, 2, 1), ("a", 3, 3, 3, 1), ("b", 1, 9, 9, 1)}
    assert {tuple(r) for r in drift.retypes(spans).collect()} == {(1, 2, "a", "string"), (1, 3, "a", "int64")}


def test_columns_that_share_values_by_chance_only_are_not_renamed(spark):
    # both hold most of the numbers below 40 that any such column holds, so 6 common ones are chance
    files = {0: [{"x": 1, "gone": v} for v in range(0, 23)], 1: [{"x": 1, "come": v} for v in range(17, 40)]}
    assert changes_of(spark, files) == {(1, "removed", "gone", ""), (1, "added", "come", "int64")}


def test_drift_on_the_test_data(spark, sf):
    """Against a plain reading of the rules with sets of values."""
    con = duckdb.connect()
    values, kinds = {}, {}
    for s, f, d in con.sql(f"SELECT stream_id, file_no, d FROM '{sf}/wal_records.parquet'").fetchall():
        try:
            doc = json.loads(d)
        except ValueError:
            continue
        for k, v in doc.items():
            if v is not None:
                kinds.setdefault((s, f), {}).setdefault(k, set()).add({bool: "bool", int: "int64", float: "float64", str: "string"}[type(v)])
                values.setdefault((s, k), set()).add(str(v).lower())
    widest = lambda z: next(iter(z)) if len(z) == 1 else "float64" if z == {"int64", "float64"} else "string"
    files = {at: {k: widest(z) for k, z in cols.items()} for at, cols in kinds.items()}
    for s, f, k, n in con.sql(f"SELECT stream_id, file_no, col_key, col_type FROM '{sf}/archive_columns.parquet'").fetchall():
        files.setdefault((s, f), {})[k] = ["int64", "float64", "string", "bool"][n]
    want = set()
    for s in {s for s, _ in files}:
        nos = sorted(f for t, f in files if t == s)
        after, first, last = dict(zip(nos, nos[1:])), {}, {}
        for f in nos:
            for k, t in files[s, f].items():
                if k in last and last[k][1] != t:
                    want.add((s, f, "retyped", k, t))
                first.setdefault(k, (f, t))
                last[k] = (f, t)
        ends = {k: after[f] for k, (f, _) in last.items() if f in after}
        starts = {k: f for k, (f, _) in first.items() if f != nos[0]}
        for k, f in sorted(ends.items()):
            new = [n for n, g in starts.items() if g == f and values[s, k] & values[s, n] and not values[s, k] <= {"true", "false"}]
            if new:
                want.add((s, f, "renamed", k, new[0]))
                starts.pop(new[0])
            else:
                want.add((s, f, "removed", k, ""))
        want |= {(s, f, "added", k, files[s, f][k]) for k, f in starts.items()}
    assert {tuple(r) for r in general.p6_found(spark, sf).collect()} == want


def test_queries_take_empty_tables(spark, sf, tmp_path):
    for name in ("wal_records", "query_results", "postings", "queue_jobs", "blob_objects", "archive_columns"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in general.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name
