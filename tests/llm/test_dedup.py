"""Exact copies, near copies and repeated strings against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from casewright.llm import common, exact_dedup, simhash, suffix_dedup

SPACE = re.compile("[\x20\x09-\x0d]+")


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(lowered) if w]


def test_exact_against_sql(spark, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    expected = c.execute(exact_dedup.OP2_SQL).fetchall()
    got = [tuple(r) for r in exact_dedup.op2_exact_dedup(spark, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got) == sorted(expected)


def test_exact_when_tables_are_full(spark, docs):
    whole = sorted(map(str, exact_dedup.groups(docs).collect()))
    found = exact_dedup.Table(10)
    assert found.put(1, b"a" * 20, 20, 1, 1, 1) and not found.put(2, b"b", 1, 2, 1, 1) and found.put(1, b"a" * 20, 20, 0, 1, 1)
    assert [r[2:] for r in found.records()] == [(0, 2, 1)]
    assert sorted(map(str, exact_dedup.groups(docs, table_bytes=4000).collect())) == whole


def test_blank_texts_that_find_no_room(spark):
    # one small table for all: empty contents are left over last, and still make up a class
    rows = [(i, "a" * 150) for i in range(3)] + [(10, ""), (11, None), (12, " \n")] + [(20 + i, chr(98 + i) * 40) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for table_bytes in (1, 300, 1000):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df, table_bytes=table_bytes).collect()}
        assert {i: got[i] for i in (10, 11, 12)} == {10: (12, 3, False), 11: (12, 3, False), 12: (12, 3, True)} and got[0] == (0, 3, True)


def test_hash_collisions_are_told_apart():
    table = exact_dedup.Table(1 << 20)
    for k in range(3000):
        assert table.put(k % 7, b"%d" % k, 1, k, 1, 1)
    assert len(list(table.records())) == 3000


def test_exact_awkward(awkward, empty):
    rows = exact_dedup.groups(awkward).collect()
    assert [r.group_size for r in rows if r.doc_id == 1 and r["text"].startswith("w0")] == [2, 2] and set(rows[0].asDict()) == {"doc_id", "text", "lang", "_doc", "keep_id", "group_size", "kept", "text_sha256"}
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == 4
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def fingerprint(text, n=3):
    words = split(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, folder, texts):
    fps = {i: fingerprint(t) for i, t, _ in texts}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = roots(fps, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, folder).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}


@pytest.mark.parametrize("dense", [500, 3])
def test_links_of_close_fingerprints(spark, dense):
    r = random.Random(3)
    made = set()
    for _ in range(12):
        base = r.getrandbits(64)
        made |= {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(15)}
    made = sorted(x - (1 << 64) if x >> 63 else x for x in made)
    expected = {(a, b) for a in made for b in made if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(x,) for x in made], "fp bigint"), dense=dense).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a bigint, b bigint")
    got = dict(tuple(x) for x in simhash.components(edges).collect())
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def agreement(a, b, n=5):
    sets = [{" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)} for w in (split(a), split(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_against_brute_force(spark):
    r = random.Random(11)
    rows = []
    for k in range(25):
        base = [f"v{r.randrange(3000)}" for _ in range(r.randrange(60, 300))]
        rows.append(" ".join(base))
        for edits in (1, 2, len(base) // 60, len(base) // 4):
            words = list(base)
            for _ in range(edits):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(words))
    expected = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if agreement(rows[i], rows[j]) >= 0.8])
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id bigint, text string, node string")
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    must_stay, must_go = {i for i in expected if expected[i] == i}, {i for i in expected if expected[i] != i}
    assert must_go and kept == must_stay


@pytest.mark.parametrize(("small", "block"), [(16, 16384), (2, 16384), (1000, 16384), (2, 7)])
def test_near_links_of_a_large_group(spark, small, block):
    r = random.Random(5)
    base = r.getrandbits(64)
    made = sorted({base ^ sum(1 << b for b in {r.randrange(64) for _ in range(2)}) for _ in range(120)} | {r.getrandbits(64) for _ in range(40)})
    fps = [x - (1 << 64) if x >> 63 else x for x in made]
    df = spark.createDataFrame(list(enumerate(fps)), "node bigint, fp bigint")
    got = [tuple(x) for x in simhash.near_links(df, 3, block, small).distinct().collect()]
    every = [(i, j) for i in range(len(made)) for j in range(i + 1, len(made)) if (made[i] ^ made[j]).bit_count() <= 3]
    assert set(got) <= set(every) and roots(range(len(made)), got) == roots(range(len(made)), every)
    assert small > 2 or len(got) < len(every)


@pytest.mark.parametrize("edits", [(2, 4), (1, 8)])
def test_near_copies_of_one_text(spark, edits):
    r = random.Random(17)
    base = [f"v{r.randrange(3000)}" for _ in range(120)]
    rows = []
    for _ in range(300):
        words = list(base)
        for _ in range(r.randint(*edits)):
            words[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    expected = roots(range(300), [(i, j) for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert len(set(expected.values())) < 270 and kept == set(expected.values())


@pytest.mark.parametrize(("hot_rows", "counted_hot", "cell_rows", "held"), [(64, 200, 2048, 500_000), (3, 200, 10, 500_000), (3, 4, 10, 40), (1000, 10**6, 10, 500_000)])
def test_exact_links_alone(spark, monkeypatch, hot_rows, counted_hot, cell_rows, held):
    monkeypatch.setattr(simhash, "HELD_ROWS", held)
    r = random.Random(18)
    rows = []
    for k in range(12):
        base = [f"v{k % 4}x{i}" for i in range(90)] + [f"b{k}x{i}" for i in range(20)]
        for _ in range(12):
            words = list(base)
            for _ in range(r.randrange(6)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(words))
    rows += ["", None, " \n"]
    every = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (not rows[i] or not rows[i].strip()) == (not rows[j] or not rows[j].strip()) and agreement(rows[i], rows[j]) >= 0.8]
    texts = spark.createDataFrame(list(enumerate(rows)), "_doc bigint, text string")
    own = texts.filter("trim(text) != ''").selectExpr("_doc as node", "_doc - if(_doc % 12 < 3, _doc % 12, 0) as root")
    before = [(i - i % 12, i) for i in range(144) if i % 12 in (1, 2)]
    got = [tuple(x) for x in simhash.exact_links(texts, own, 5, 0.8, hot_rows, cell_rows, 10**6, counted_hot).collect()]
    assert set(got) <= set(every) and roots(range(144), got + before) == roots(range(144), [p for p in every if p[1] < 144] + before)


def test_near_pairs_of_a_templated_group(spark):
    r = random.Random(6)
    template = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(300):
        own = template + [f"o{i}x{k}" for k in range(r.randrange(30, 55))]  # 0.6 to 0.77 across
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-3], f"e{i}", *own[-2:]]))]
    assert all(agreement(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(0, 600, 2))
    assert all(agreement(rows[i][1], rows[j][1]) < 0.8 for i, j in (sorted(r.sample(range(600), 2)) for _ in range(2000)) if i // 2 != j // 2)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(range(0, 600, 2))


def test_near_copies_that_fingerprints_keep_apart(spark):
    r = random.Random(12)
    rows, expected = [], set()
    for k in range(30):
        # one half many times over in one copy, once in the other
        half, rest = ([f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(10 * k, " ".join(half + rest)), (10 * k + 1, " ".join(half * 20 + rest))]
        # long texts that agree to just over or under 0.8: each change takes five shingles
        base = [f"u{r.randrange(10**7)}" for _ in range(1500)]
        changed = list(base)
        for i in range(32 + k % 3):
            changed[20 + 40 * i] = f"c{k}x{i}"
        rows += [(10 * k + 2, " ".join(base)), (10 * k + 3, " ".join(changed))]
        expected |= {10 * k, 10 * k + 2} | ({10 * k + 3} if agreement(rows[-1][1], rows[-2][1]) < 0.8 else set())
    assert {agreement(rows[4 * k + 2][1], rows[4 * k + 3][1]) >= 0.8 for k in range(30)} == {True, False}
    assert all(agreement(rows[4 * k][1], rows[4 * k + 1][1]) >= 0.8 for k in range(30))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == expected


def test_equal_sketches_of_different_texts(spark):
    r = random.Random(13)
    rows = [(i, "| " * 600 + " ".join(f"w{r.randrange(10**7)}" for _ in range(500))) for i in range(4)]
    rows += [(4, rows[0][1]), (5, rows[1][1] + " end")]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {0, 1, 2, 3}


def test_spanning_connects_like_all_pairs():
    import numpy as np

    r = random.Random(2)
    for _ in range(20):
        rows = []
        for _ in range(6):
            base = r.getrandbits(64)
            rows += [base ^ sum(1 << b for b in {r.randrange(64) for _ in range(4)}) for _ in range(r.randrange(1, 30))]
        words = np.array(rows, dtype=np.uint64)
        every = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (rows[i] ^ rows[j]).bit_count() <= 6]
        found = simhash.spanning(words, 6)
        assert roots(range(len(rows)), every) == roots(range(len(rows)), [(min(p), max(p)) for p in found]) and len(found) < len(rows)


def test_near_awkward(awkward, empty):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(map(str, (r.text for r in kept.collect()))) == sorted(["None", " ".join(f"w{i}" for i in range(80)) + " more", "other words here"])
    assert simhash.keep_one(empty).count() == 0 and simhash.groups(empty).count() == 0
    assert simhash.groups(awkward).count() == 5


def cut(rows, length=100):
    """(doc, bytes) in order: spans by definition."""
    seen, out = set(), {}
    for doc, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got_cut(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize(("collection", "crowd"), [(4096, 512), (5, 512), (4096, 3), (4, 1)])
def test_repeated_strings_against_brute_force(spark, docs, texts, collection, crowd):
    expected = cut([(i, (t or "").encode()) for i, t, _ in sorted(texts)])
    assert any(v[2] for v in expected.values())
    assert got_cut(suffix_dedup.digests(suffix_dedup.cut_out(docs, collection=collection, crowd=crowd))) == expected


@pytest.mark.parametrize(("collection", "crowd"), [(4096, 512), (3, 2)])
def test_repeats_that_overlap(spark, collection, crowd):
    r = random.Random(9)
    parts = ["".join(r.choices("ab é", k=r.randrange(60, 160))) for _ in range(12)]
    rows = [(i, "".join(r.choices(parts, k=r.randrange(1, 6)))) for i in range(60)] + [(70, "a" * 450), (71, "a" * 120), (72, "ab" * 300), (73, "é" * 49), (74, "é" * 50), (75, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got_cut(suffix_dedup.digests(suffix_dedup.cut_out(df, collection=collection, crowd=crowd))) == cut([(i, t.encode()) for i, t in rows])


def test_op9(spark, folder, texts):
    assert got_cut(suffix_dedup.op9_suffix_dedup(spark, folder)) == cut([(i, (t or "").encode()) for i, t, _ in sorted(texts)])


def test_long_texts_in_pieces(spark):
    r = random.Random(4)
    a = "".join(r.choices("abcdef ", k=3000))
    rows = [(0, a), (1, "z" * 50 + a[700:2100] + "y" * 30), (2, a[::-1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got_cut(suffix_dedup.digests(suffix_dedup.cut_out(df, block_bytes=64))) == cut([(i, t.encode()) for i, t in rows])


def test_column_wise_order():
    import numpy as np

    r = random.Random(8)
    texts = [bytes(r.choices(b"ab", k=r.randrange(100, 170))) for _ in range(30)]
    counts = np.array([len(t) - 99 for t in texts])
    text, start, equal = suffix_dedup.sorted_windows(texts, counts)
    windows = [texts[t][s : s + 100] for t, s in zip(text, start, strict=True)]
    assert windows == sorted(windows) and len(windows) == counts.sum()
    assert [bool(x) for x in equal[1:]] == [a == b for a, b in zip(windows, windows[1:], strict=False)]


def test_equal_hashes_of_different_contents(spark, docs, texts, monkeypatch):
    # hashes only propose: with one that tells hardly anything apart, the result is the same
    class Poor:
        xxh3_64_intdigest = staticmethod(lambda data: len(data) % 3)

    monkeypatch.setattr(suffix_dedup, "xxhash", Poor)
    cut_here = list(suffix_dedup._cut(iter([suffix_dedup.pa.RecordBatch.from_arrays([[i for i, _, _ in texts], [t for _, t, _ in texts]], names=["doc", "text"])]), 1 << 19))
    data = {i: (t or "").encode() for i, t, _ in texts}
    seen = set()
    for row in sorted((r for b in cut_here for r in b.to_pylist()), key=lambda r: (r["doc"], r["start"])):
        own = data[row["doc"]][row["start"] : row["start"] + row["n"] + 99]
        assert not row["repeats"] or own in seen
        seen.add(own)
    rows = [(7, h, 10 * k, 0, 1, x * 100) for h, k, x in ((1, 0, b"a"), (1, 1, b"b"), (1, 2, b"a"), (1, 3, b"b"), (2, 4, b"c"))]
    for mixed in (True, False):
        batch = suffix_dedup.pa.RecordBatch.from_arrays([*map(list, zip(*rows, strict=True)), [mixed] * 5], names=["anchor", "content", "doc", "start", "n", "data", "mixed"])
        assert sorted(r["doc"] for b in suffix_dedup._collect(iter([batch]), 10) for r in b.to_pylist()) == [20, 30]


def test_zero_bytes(spark):
    r = random.Random(10)
    texts = [bytes(r.choices(b"\0ab", k=r.randrange(100, 170))) for _ in range(30)]
    text, start, _ = suffix_dedup.sorted_windows(texts, suffix_dedup.np.array([len(t) - 99 for t in texts]))
    windows = [texts[t][s : s + 100] for t, s in zip(text, start, strict=True)]
    assert windows == sorted(windows) and len(windows) == sum(len(t) - 99 for t in texts)
    part = "".join(r.choices("abcdef \0", k=300))
    rows = [(i, f"{i}" * 40 + part[: 140 + 9 * i] + "\0" + f"{i}x" * 30) for i in range(9)] + [(20, "\0" * 250)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got_cut(suffix_dedup.digests(suffix_dedup.cut_out(df))) == cut([(i, t.encode()) for i, t in rows])


def test_cut_awkward(awkward, empty):
    found = suffix_dedup.without_repeats(awkward)
    assert found.columns == [c for c in awkward.columns]
    # null ids come first, so the longer text stays whole and the copies go
    assert sorted(str(r.text) for r in found.collect()) == sorted(["None", "other words here", " ".join(f"w{i}" for i in range(80)) + " more"])
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert suffix_dedup.cut_out(empty).count() == 0


def test_hot_keys_are_attached(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "id bigint, key string")
    right = spark.createDataFrame([("hot", 2000, "h"), ("k0", 1, "z")], "key string, n bigint, v string")
    got = common.attach(left, right, "key", "n", 3000, "id")
    assert {r.v for r in got.filter("key = 'hot'").collect()} == {"h"} and got.count() == 3000 and got.filter("v = 'z'").count() == 1
