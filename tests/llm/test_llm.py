"""Training-data operators: against brute force, exact invariants and edge cases."""

import random
import re
import time
from collections import Counter
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from logweir.llm import mixing, packing, pii, queries, terms, tokens, topics
from logweir.session import table, written

# --- terms


def test_terms_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aAbBcC") + "x", rng.randrange(4), rng.randrange(3), rng.randrange(5)) for _ in range(400)]
    rows += [("hot", 9, d, 0) for d in range(300)] + [(None, 1, 1, 1), ("ab", None, 1, 1), ("ab", 1, None, 1), ("pos", 1, 1, None), ("pos", 1, 1, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "trigram string, stream_id bigint, document_id bigint, position bigint, term string")
    clean = {(t.lower(), s, d, p) for t, s, d, p in rows if None not in (t, s, d)}
    docs = {(s, d) for _, s, d, _ in clean}
    want = {}
    for t in {c[0] for c in clean}:
        n = len({c[1:3] for c in clean if c[0] == t})
        want[t] = (sum(c[0] == t for c in clean), n, "rare" if n <= 2 else "common" if n > 0.2 * len(docs) else "")
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in terms.term_frequencies(df.drop("term")).collect()}
    assert got == want
    fewer = terms.term_frequencies(df.drop("term"), occurrences=False).collect()
    assert {r["term"]: (r["n_records"], r["mark"]) for r in fewer} == {t: w[1:] for t, w in want.items()}
    assert terms.term_frequencies(df.drop("term").limit(0)).count() == 0


def test_null_positions_count_once(spark):
    df = spark.createDataFrame([("t", 1, 1, None), ("T", 1, 1, None), ("t", 1, 1, 0)], "trigram string, stream_id bigint, document_id bigint, position bigint")
    assert terms.term_frequencies(df).first()["n_occurrences"] == 2


def test_marked_trigrams_are_chosen_among_counted_ones(spark, tmp_path, monkeypatch):
    """p3_found reads its rows from all trigrams with their occurrences, which no plan may prune."""
    rows = [("AA", 1, d, p) for d in range(20) for p in range(3)] + [("aa", 1, 0, 0), ("bb", 1, 0, 5), ("bb", 1, 0, 6), ("Bb", 2, 0, 5), ("cc", 1, None, 1)]
    rows += [("dd", 1, d, 9) for d in range(3)]
    spark.createDataFrame(rows, "trigram string, stream_id bigint, document_id bigint, position bigint").write.parquet(f"{tmp_path}/postings.parquet")
    kept = []
    monkeypatch.setattr(queries, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    found = queries.p3_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("aa", "common"), ("bb", "rare")}
    assert len(kept) == 1 and sorted(found.inputFiles()) == sorted(kept[0].inputFiles())
    assert {tuple(r) for r in kept[0].select("trigram", "n_occurrences", "n_records", "mark").collect()} == {("aa", 60, 20, "common"), ("bb", 3, 2, "rare"), ("dd", 3, 3, "")}


# --- packing


@pytest.mark.parametrize("seed", range(6))
def test_pack_fits(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 512, 8192])
    sizes = [min(capacity, int(rng.paretovariate(0.7))) * rng.choice([0, 1, 1, 1]) for _ in range(rng.choice([0, 1, 50, 3000]))]
    bins = packing.pack(sizes, capacity)
    fill = Counter()
    for b, s in zip(bins, sizes):
        fill[b] += s
    assert len(bins) == len(sizes) and all(v <= capacity for v in fill.values()) and (not bins or min(bins) == 0)
    if sum(sizes) > 50 * capacity:
        assert len(fill) <= 1.35 * sum(sizes) / capacity + 2


def test_pack_classes_take_fixed_counts():
    assert Counter(packing.pack([100] * 50, 512)).most_common() == [(b, 5) for b in range(10)]


def test_packed_texts(spark):
    texts = [(1, "word " * 3000), (2, ""), (3, None), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "x" * 200_000), (7, "y " * 512)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id bigint, text string, size string")
    packs = spark.createDataFrame([("small", 512), ("none", 0), ("null", None), ("one", 1)], "pack_name string, capacity_tokens int")
    out = packing.packed(packing.lengths(docs), packs).collect()
    length = {r["doc_id"]: r["n"] for r in docs.dropDuplicates(["doc_id"]).select("doc_id", tokens.n_tokens(F.col("text")).alias("n")).collect()}
    assert {r["pack_name"] for r in out} == {"small", "one"}
    for name, capacity in (("small", 512), ("one", 1)):
        rows = [r for r in out if r["pack_name"] == name]
        fill = Counter()
        for r in rows:
            fill[r["container_id"]] += r["n_tokens"]
            assert r["n_parts"] == max(1, -(-length[r["doc_id"]] // capacity))
        assert max(fill.values()) <= capacity
        for d, n in length.items():
            parts = [r for r in rows if r["doc_id"] == d]
            copies = sum(t[0] == d for t in texts)
            assert sum(r["n_tokens"] for r in parts) == n * copies and len(parts) == copies * parts[0]["n_parts"]
    assert packing.packed(packing.lengths(docs.limit(0)), packs).count() == 0


def test_packing_of_the_test_data(spark, sf):
    pieces = queries.p7_pack(spark, sf).cache()
    over = pieces.groupBy("pack_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).where("n > capacity_tokens")
    assert over.count() == 0
    n_docs = table(spark, sf, "documents").count()
    assert {r["n"] for r in pieces.where("part_no = 0").groupBy("pack_name").agg(F.count("*").alias("n")).collect()} == {n_docs}
    assert all(r["unused_share"] < 0.25 for r in packing.fill_report(pieces).collect())


def test_quick_tokens_are_those_of_the_tokenizer(sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)
    plain.encode_special_tokens = True
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    texts += ["", " ", " " * 50_000, "x" * 20_000, "a1" * 9_000, "é ü\u00a0\u2003 \n\n\t x", "<|endoftext|> it's we'LL", "日本語 🙂🙂", "\x00\x1b[0m", "_a__b -- ¿?"]
    assert tokens.encoder(tokens.DEFAULT_TOKENIZER)(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


# --- mixing

DOCS = "doc_id bigint, source string, lang string, text string, max_repeats string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mixing(spark):
    rng = random.Random(3)
    names = {"big": 3000, "mid": 600, "tiny": 60}
    spell = [str, str.upper, lambda s: f" {s}\t", lambda s: s[0] + "-" + s[1:]]
    rows, i = [], 0
    for s, n in names.items():
        for _ in range(n):
            i += 1
            rows.append((i, rng.choice(spell)(s), rng.choice(["en", "EN", "it", None, "english"]), "the queue " * rng.randrange(1, 8) + rng.choice(["wal", "cache", ""])))
    rows += [(-1, None, "en", "text"), (-2, "unknown", "en", "text"), (-3, "big", None, None), (-4, "big", "en", "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).drop("max_repeats")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 4), ("null", None, 1), (None, 0.1, 1), ("never", 0.2, 0)], TARGETS)
    chosen = mixing.mixed(mixing.sized(docs, targets), targets).cache()
    got = {r["source"]: r for r in mixing.share_report(chosen, targets).collect()}
    for s, want in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(got[s]["share"] - want) < 0.04, s
    assert got["absent"]["share"] == 0 and all(r["repeats"] <= r["max_repeats"] for r in chosen.collect())
    assert not {r["doc_id"] for r in chosen.collect()} & {-1, -2}
    assert {r["lang"] for r in chosen.collect()} == {"en", "it", "und"}
    empty = mixing.mixed(mixing.sized(docs.limit(0), targets), targets)
    assert empty.count() == 0 and mixing.share_report(empty, targets).count() == 7


def test_topics_are_words_that_stand_together(spark):
    rng = random.Random(4)
    groups = [["queue", "lease", "worker", "producer"], ["trigram", "posting", "segment", "dictionary"], ["coffee", "kitchen", "garden", "weather"]]
    texts = [(i, " " + " ".join(rng.choice(groups[i % 3]) for _ in range(12)), i % 3) for i in range(300)] + [(999, "", None), (998, None, None), (997, "12 + 5", None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, kind int").repartition(3)
    rows = written(topics.encoded(docs, "text", ["doc_id", "kind"]), "t")
    common, topics.COMMON = topics.COMMON, 0.5
    try:
        got = topics.with_topics(rows, topics=3).collect()
    finally:
        topics.COMMON = common
    found = {k: Counter(r["topic"] for r in got if r["kind"] == k) for k in range(3)}
    assert all(c.most_common(1)[0][1] >= 95 for c in found.values()) and len({c.most_common(1)[0][0] for c in found.values()}) == 3
    assert {r["topic"] for r in got if r["kind"] is None} == {"general"} and {r["n_tokens"] for r in got if r["doc_id"] in (999, 998)} == {0}
    assert {r["topic"] for r in topics.with_topics(rows.limit(0)).collect()} == set()


def test_marginals_and_the_binding_source_are_reported(spark, sf):
    targets = table(spark, sf, "mix_targets")
    rows = mixing.sized(table(spark, sf, "documents"), targets)
    chosen = mixing.mixed(rows, targets)
    out = mixing.marginals(rows, chosen).collect()
    for dim in ("lang", "topic"):
        assert abs(sum(r["own_share"] for r in out if r["dim"] == dim) - 1) < 1e-9 and abs(sum(r["share"] for r in out if r["dim"] == dim) - 1) < 1e-9
    assert sum(r["is_binding"] for r in mixing.share_report(chosen, targets, rows).collect()) == 1


def test_rake_meets_marginals():
    rng = random.Random(2)
    cells = [{"source": s, "lang": g, "topic": t, "tokens": rng.randrange(100, 1000), "cap": 5} for s in "ab" for g in ("en", "it") for t in ("x", "y")]
    weights = mixing.rake(cells, {"a": 0.7, "b": 0.3})
    total = sum(w * c["tokens"] for w, c in zip(weights, cells))
    share = lambda k, v: sum(w * c["tokens"] for w, c in zip(weights, cells) if c[k] == v) / total
    have = lambda k, v: sum(c["tokens"] for c in cells if c[k] == v) / sum(c["tokens"] for c in cells)
    assert abs(share("source", "a") - 0.7) < 1e-6 and max(weights) <= 5
    assert abs(share("lang", "en") - have("lang", "en")) < 0.02 and abs(share("topic", "x") - have("topic", "x")) < 0.02
    assert mixing.rake([], {"a": 1.0}) == []


# --- personal information

STAFF = [f"{s}{e}" for s in ("Brod", "Corv", "Falk", "Lind", "Merk", "Quell") for e in ("aldi", "berg", "ette", "holt", "wick")]
WORDS = pii.Dictionary({"anna", "vera", "miles"}, {f.lower() for f in STAFF[:-3]} | {"reed"}, *pii.name_stems(STAFF[:-3]), {"port tansley", "rocca filora"})

FOUND = [
    ("Mail «ann-b.c+x@mail.example.com», or «a.b [at] example [dot] org», or «a at ops dot example dot org».", "email"),
    ("<«a@b.example»> mailto:«x_y@z.test».", "email"),
    ("git@host-1:repo and job@79ab are none; ann@ nobody", "email"),
    ("Ring «+44 (0)20 7946 0989», «020 7946 0989», «07700 900123», «030/23125-215», «+4930 23125 194».", "phone"),
    ("Ring «(201) 555-0103», «201-555-0103», «+1.201.555.0144», «3125550198», «01 99 00 88 48», «+336 39 98 04 39».", "phone"),
    ("10.183.237.7 2024-12-10 1733825449082 53879-6107707 v31.79.146-50295 20241228.16 1733855079.118891", "phone"),
    ("ssn=«953-13-5091», «QQ 16 00 06 A», «qq160006a», «HSKLCU14B26Z970U»; Ticket 936 55 3872, REQ-907-52-3566", "idnum"),
    ("At «98 Tanner's Row Suite 277», «174 Copperwind Lane, Unit 5, Wexholm 31996», «1 Weir St\nPort Tansley». The end", "address"),
    ("In «Via San Fiorello n. 8, 29996 Rocca Filora» Grant it; «Gerberweg 22a»; «Neue Torfstr. 95, 07941 Krummeck am See»; «Am Salzhang 226c».", "address"),
    ("Cluster Baker Lane keeps 77 objects; die Straße der Sperren; Row 84188 of the dump", "address"),
    ("By «Anna Brodaldi», «A. B. Corvette»? «Vera von der Lindwick-Falkette», «FALKHOLT, ANNA», «miles merkholt», «Reed, Vera»; «V. Lindberg».", "name"),
    ("Dear «Vera», The Vera Reed rollout; cluster Vera keeps; Miles of lines; a reed; Gemeldet von «Brodwick, Anna» am", "name"),
]


@pytest.mark.parametrize("marked, kind", FOUND)
def test_found(marked, kind):
    marked = marked.replace("«A. B. Corvette»?", "A. «B. Corvette»?")
    text = re.sub("[«»]", "", marked)
    want, shift = [], 0
    for m in re.finditer("«([^»]*)»", marked):
        want.append((kind, m.start() - shift, m.start() - shift + len(m[1])))
        shift += 2
    got = pii.find(text, WORDS)
    show = lambda spans: [(k, text[a:b]) for k, a, b in spans if k == kind]
    assert show(got) == show(want)
    assert [s for s in got if s[0] == kind] == want


def test_long_and_empty_texts():
    assert pii.find(None, WORDS) == [] and pii.find("", WORDS) == [] and pii.replaced(None, [], b"k") is None
    start = time.time()
    for piece in ("x", "X", "1", "A-", "a.", "a@", "Anna ", "1 A ", "(2", "+1 ", "Via Roma ", "\n, "):
        pii.find(piece * (200_000 // len(piece)), WORDS)
    assert time.time() - start < 60
    text = "é" * 1000 + " Anna Brodaldi " + "z" * 100_000
    assert pii.find(text, WORDS) == [("name", 1001, 1014)]


def test_pseudonyms_keep_format_and_differ():
    key = b"test"
    values = [f"9{n:02d}-{n % 97:02d}-{n * 7919 % 10_000:04d}" for n in range(100)]
    out = [pii.permuted(v, key) for v in values]
    assert len(set(out)) == len(set(values)) and all(re.fullmatch(r"\d{3}-\d\d-\d{4}", o) for o in out)
    assert pii.permuted("QQ 12 34 56 A", key).replace(" ", "") == pii.permuted("QQ123456A", key)
    assert pii.permuted("qq123456a", key) == pii.permuted("QQ123456A", key).lower() and pii.permuted("QQ123456A", b"other") != pii.permuted("QQ123456A", key)
    assert pii.placeholder("phone", "+44 20 7946 0989", key).startswith("[PHONE +44 ")
    assert pii.placeholder("name", "Anna Brodaldi", key) == pii.placeholder("name", "ANNA  BRODALDI", key) != pii.placeholder("name", "Vera Brodaldi", key)
    every = {pii.permuted(f"{n:04d}", key) for n in range(10_000)}
    assert len(every) == 10_000


def test_dictionary_is_learned_from_the_corpus(spark):
    unlisted = ["Zora", "Petra"]
    texts = [f"Seen by {g} {f} on call. The Amber Falcon rollout. At 5 Mill Lane, Newtown {10_000 + i}." for i, (g, f) in enumerate((g, f) for g in [*unlisted, "Anna"] for f in [*STAFF, "Kelp"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id bigint, text string")
    parts = spark.createDataFrame([(f, "family") for f in STAFF[:-3]] + [("Anna", "given"), ("Amber", "given"), (None, "given")], "name_part string, part_kind string")
    words = pii.learned(docs, parts)
    assert {"zora", "petra", "anna"} <= words.given and "falcon" not in words.family and {"kelp"} <= words.family and words.towns == {"newtown"}
    got = pii.occurrences(docs, words)
    assert Counter(r["pii_kind"] for r in got.collect()) == {"name": len(texts), "address": len(texts)}
    assert pii.occurrences(docs.limit(0), pii.learned(docs.limit(0), parts.limit(0))).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs, words, b"k").collect()}
    assert out[len(texts)] is None and out[len(texts) + 1] == "" and not any("Zora" in (t or "") or "Newtown" in (t or "") for t in out.values())


def test_rare_names_among_many_mentions(spark):
    listed = [f"{s}{e}" for s in ("Brod", "Corv", "Falk", "Lind", "Merk", "Quell") for e in ("aldi", "berg", "ette", "holt", "wick")]
    often = "; ".join(["by Anna Brodaldi"] * 400)
    rare = [f"by Zora {f} on call" for f in listed[:3]]
    docs = spark.createDataFrame([*enumerate(rare), *((10 + i, often) for i in range(100)), (5, None), (None, rare[0])], "doc_id bigint, text string")
    parts = spark.createDataFrame([(f, "family") for f in listed] + [("Anna", "given")], "name_part string, part_kind string")
    words, more = pii.entries(docs, parts)
    assert [tuple(r) for r in more.collect()] == [("given", "zora")] and "zora" not in words.given
    got = pii.occurrences(docs.where("doc_id < 10 or doc_id is null"), words, more=more).collect()
    assert sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in got) == sorted((i, 3, 8 + len(f)) for i, f in [*enumerate(listed[:3]), (0, listed[0])])
    assert not any("Zora" in (r["text"] or "") for r in pii.redacted(docs, words, b"k", more=more).where("doc_id < 10").collect())

def _enlarged(copies: int) -> tuple[list[str], list[tuple[str, int, int, int]]]:
    """Texts with planted names, and copies of them with other given names; the cases (kind, text number, start, end)."""
    rng = random.Random(5)
    given = ["Anna", "Zora", "Petra", "Miles", "Vera", "Mark", "Grant", "Will", "Iris"]
    plain = ["The Compactor read the log.", "Contact the owner until noon.", "Mark the queue file.", "Grant the lease again.", "Will the retry reach it?", "On Monday the Cluster keeps all.", "The node kelp-24 is up."]
    texts, cases = [], []
    for c in range(copies):
        turned = given[c % len(given) :] + given[: c % len(given)]
        to = dict(zip(given, turned))
        for i in range(120):
            family = rng.choice([*STAFF, "Kelp", "Sable"])
            name = f"{to[rng.choice(given)]} {family}"
            parts = [rng.choice(plain) for _ in range(6)]
            # signed texts, whose given name stands before the next sentence
            closing = f"{rng.choice(STAFF)}, {to[rng.choice(given)]}"
            text = f"{parts[0]} {parts[1]} Seen by {name} on call. {parts[2]} {parts[3]} Thanks, {closing}\n{parts[4]} {parts[5]}"
            for n in (name, closing):
                cases.append(("name", len(texts), text.index(n), text.index(n) + len(n)))
            texts.append(text)
    return texts, cases


@pytest.mark.parametrize("copies", [1, 9, 40])
def test_found_names_stay_right_as_the_corpus_grows(spark, copies):
    texts, cases = _enlarged(copies)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    parts = spark.createDataFrame([(f, "family") for i, f in enumerate(STAFF) if i not in (1, 7, 13)] + [("Anna", "given"), ("Vera", "given")], "name_part string, part_kind string")
    words, more = pii.entries(docs, parts)
    assert {r["word"] for r in more.where("role = 'family'").collect()} - {f.lower() for f in STAFF} == {"kelp", "sable"}
    got = {(r["pii_kind"], r["doc_id"], r["start_pos"], r["end_pos"]) for r in pii.occurrences(docs, words, more=more).collect()}
    want = set(cases)
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_sent_and_joined_entries_find_the_same(spark, sf):
    docs, parts = table(spark, sf, "documents"), table(spark, sf, "name_parts")
    words, more = pii.entries(docs, parts)
    sent = pii.occurrences(docs, words, more=more)
    joined = pii.occurrences(docs, words, more=more, sent=0)
    assert sent.exceptAll(joined).count() == joined.exceptAll(sent).count() == 0 < sent.count()


def test_redacted_test_data_keep_the_rest_and_link_values(spark, sf):
    docs = table(spark, sf, "documents")
    words, more = pii.entries(docs, table(spark, sf, "name_parts"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    spans: dict = {}
    for r in pii.occurrences(docs, words, more=more).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["pii_kind"]))
    linked: dict = {}
    for r in pii.redacted(docs, words, b"k", more=more).collect():
        rest, text = r["text"], texts[r["doc_id"]]
        assert r["n_found"] == len(spans.get(r["doc_id"], []))
        at = done = 0
        for start, end, kind in sorted(spans.get(r["doc_id"], [])):
            kept = text[done:start]
            assert rest[at : at + len(kept)] == kept
            tag = re.match(rf"\[{kind.upper()} [^\]]+\]", rest[at + len(kept) :])[0]
            plain = re.sub(r"\W+", " ", text[start:end].lower()).strip()
            if kind in ("name", "address"):
                assert linked.setdefault((kind, plain), tag) == tag
            elif kind in ("phone", "idnum"):
                assert re.sub(r"\w", "w", tag.partition(" ")[2][:-1]) == re.sub(r"\w", "w", text[start:end]) and text[start:end] not in rest
            at, done = at + len(kept) + len(tag), end
        assert rest is None or rest[at:] == text[done:]
    assert len(set(linked.values())) == len(linked) > 50


def test_birth_dates_are_permuted_within_their_format():
    key = b"test"
    days = [f"19{y:02d}-0{m}-{d:02d}" for y in range(30, 90, 7) for m in range(1, 10) for d in (1, 15, 28)]
    out = [pii.permuted_date(d, key) for d in days]
    assert len(set(out)) == len(set(days)) and all(date.fromisoformat(o).year in range(1900, 2100) for o in out)
    assert pii.permuted_date("7.3.1980", key).count(".") == 2 and pii.permuted_date("31/12/2099", key).count("/") == 2
    assert pii.permuted_date("1980-13-45", key) == "1980-13-45" and pii.permuted_date("1980-03-07", b"o") != pii.permuted_date("1980-03-07", key)
    text = "Born on 1980-03-07, seen 2025-01-01; geboren am 07.03.1980; nata il 7/3/1980."
    assert [text[a:b] for _, a, b in pii.birth_dates(text)] == ["1980-03-07", "07.03.1980", "7/3/1980"]


def test_pii_of_the_test_data(spark, sf):
    """No two finds overlap, and what is marked looks like its kind."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    rows = queries.p9_found(spark, sf).collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {r["pii_kind"] for r in rows} == set(pii.KINDS)
    last = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start_pos"])):
        assert last.get(r["doc_id"], 0) <= r["start_pos"] < r["end_pos"] <= len(texts[r["doc_id"]])
        last[r["doc_id"]] = r["end_pos"]
        part = texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]
        assert part == part.strip() and (r["pii_kind"] != "email" or re.search("@|at", part))


def test_llm_queries_take_empty_tables(spark, sf, tmp_path):
    for name in ("postings", "documents", "mix_targets", "pack_sizes", "name_parts"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name
