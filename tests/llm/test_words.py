"""Alignment of two tokenizers, spelling variants, toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.llm import alignment, bpe, common, spelling, tokens, toxicity
from tests.llm.conftest import DOCS, prose

# alignment

ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b \n\nc  d", "x▁y", "<|endoftext|> hi <s> <0x41>", "\t\ta\xa0b c", "日本語 テキスト 🙂🙂 x", "ñ ½ ① ﬁ", "a\x00b", "a" * 3000, "ab cd  e \n f " * 700, "word ö. " * 1500, "it's we'll 123 4567 ...!!", "a\x1c b\x85 c"]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))


def plainly_aligned(sides, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, from the offsets of both sides' whole encodings."""
    a_side, b_side = sides
    alphabet, names = bpe.byte_alphabet(), {i: t for t, i in a_side.get_vocab().items()}
    a_bytes = lambda i: bytes(alphabet[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append(None)
            continue
        ends_a = np.cumsum([len(a_bytes(i)) for i in a]).tolist()
        ends_b = np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        links = [(x, y) for x, p in zip(a, ends_a, strict=True) for y, q in zip(b, ends_b, strict=True) if p == q] if len(a) < 400 else None
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = links or [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    show = lambda ids: ",".join(map(str, ids))
    told = lambda d: (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(f"{show(x)}|{show(y)}" for x, y in d[2]).encode()).hexdigest())
    return [told(d) if d else (0, 0, 0, 0, 0, 0, "") for d in docs]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_against_offsets(spark, sides, texts, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(alignment.agreement, "__defaults__", (hot,))
    rows = [(i, t) for i, t, _ in texts if i != 105] + [(1000 + k, t) for k, t in enumerate(ODD)]
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op11_alignment(spark, str(tmp_path)).collect()}
    want = dict(zip([i for i, _ in rows], plainly_aligned(sides, [t for _, t in rows]), strict=True))
    assert got == want


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"", b"abc"], [b"a", b"bc", b"abd"])
    assert t.ends([0, 1], [0, 1]) == ([2], [2]) and t.ends([3, 0, 1], [0, 1, 0, 1]) == ([1, 3], [2, 4]) and t.ends([], []) == ([], [])
    assert t.ends([0], [0]) is None and t.ends([0, 1], [2]) is None and t.ends([2], [0]) is None and t.ends([0, 1], [0, 1, 0]) is None
    assert t.kept > 0


def test_alignment_awkward(awkward, empty):
    path = tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model")
    named = awkward.withColumn("groups", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("times", F.lit(2)).withColumn("rest", F.lit(3))
    found = alignment.align(named, *path)
    scored = alignment.agreement(found, alignment.link_counts(found)).collect()
    assert len(scored) == 5 and {r["a.b"] for r in scored} == {1} and {r["rest"] for r in scored} == {3}
    assert [r.n_a for r in scored if r.kept is None] == [0] and len({(r.n_a, r.count_sum) for r in scored if r.kept in (5, 6)}) == 1
    nothing = alignment.align(empty, *path)
    assert alignment.agreement(nothing, alignment.link_counts(nothing)).count() == 0


# spelling


def plainly_varied(texts):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {}
    for w, n in words.items():
        close = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        found[w] = (best if best and words[best] >= 5 * n else None, n, len(close))

    def root(w):
        while found[w][0]:
            w = found[w][0]
        return w

    return {w: (form, root(w), n, k, words[form] if form else None) for w, (form, n, k) in found.items()}


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(5)
    base = ["walking", "wälking", "talking", "balking", "aaaaaaa", "aaaaaaaa", "aaaaaa", "Bananas", "bandanas", "mississippi", "éèêëìíî", "×÷×÷×÷×"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(60):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abkln") + w[k:], w[:k] + r.choice("abkln") + w[k + 1 :]])
            words.append(w)
        rows.append((i, r.choice([" ", ", ", "1"]).join(words)))
    long = "".join(r.choice("abcdefgh") for _ in range(300))
    twins = [long, long[:150] + "z" + long[151:], long[1:], "q" * 64, "q" * 65, "q" * 63, "q" * 20 + "r" + "q" * 43]
    rows += [(1000 + k, " ".join(w for w in twins for _ in range(1 if w == long else 6)) + (" " + long) * 40) for k in range(2)]
    rows += [(1500, "chainsaw " * 300 + "chainsaq " * 40 + "chainqaq " * 6)]
    return [*rows, (2000, None), (2001, ""), (2002, "a 1 _")]


@pytest.mark.parametrize("long", [spelling.LONG, 8])
def test_variants_against_brute_force(spark, misspelt, monkeypatch, tmp_path, long):
    monkeypatch.setattr(spelling, "LONG", long)
    spark.createDataFrame([(i, t, None, "s", 0) for i, t in misspelt], DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_spelling(spark, str(tmp_path)).collect()}
    want = plainly_varied(misspelt)
    assert got == want and any(v[0] for v in want.values()) and any(v[1] not in (w, v[0]) for w, v in want.items())
    assert any(len(w) > 200 and v[3] >= 2 for w, v in want.items())


def test_hash_collisions_are_settled_on_strings():
    rows = pa.table({"key": [7, 7, 7, 9], "place": pa.array([-1, 0, 0, 1], pa.int32()), "fresh": [True] * 4, "id": [1, 2, 3, 4], "n": [5, 6, 7, 8], "word": ["other", "xabc", "yabc", "none"]})
    assert spelling._near(rows).to_pydict() == {"word": ["xabc", "yabc"], "n_near": [1, 1], "near_n": [7, 6], "near": ["yabc", "xabc"]}


def test_deletion_hashes_are_those_of_the_shorter_words():
    words = ["abc", "bc", "ac", "ab", "aab", "x" * 70, "é"]
    hashes = spelling.Hashes(words)
    word, place, key = hashes.part(0, len(hashes))
    by = {(int(w), int(p)): int(k) for w, p, k in zip(word, place, key, strict=True)}
    assert [by[0, k] for k in range(3)] == [by[k, -1] for k in (1, 2, 3)] and by[4, 0] == by[4, 1] == by[3, -1] and len({by[k, -1] for k in range(7)}) == 7
    assert len(hashes.part(3, 5)[0]) == 2 and int(hashes.part(3, 4)[2][0]) == int(key[3])


def test_variants_awkward(spark, awkward, empty):
    assert spelling.variants(empty).count() == 0
    many = awkward
    for _ in range(2):
        many = many.unionAll(awkward)
    found = spelling.variants(many.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("a.b", F.lit(1)), least_length=5).collect()
    assert {(r.word, r.n) for r in found} == {("other", 3), ("words", 3)} - ({("other", 3), ("words", 3)} if spelling.LEAST_COUNT > 3 else set())


# toxicity


def by_definition(spellings, n0, n1):
    """log p(toxic) - log p(ordinary) of a spelling of ORDER characters, by recursion over dictionaries."""
    order = toxicity.ORDER
    shared = {order: set(spellings)}
    counts = {}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in shared[k + 1])
        shared[k] = set(counts[k])
    discount = lambda c: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(sum(v == 1 for v in c), sum(v == 2 for v in c))

    def p(table, d, gram, below):
        mine = [v for g, v in table.items() if g[:-1] == gram[:-1]]
        total = sum(mine)
        if not total:
            return below
        return max(table.get(gram, 0) - d, 0) / total + d * sum(v > 0 for v in mine) / total * below

    def log_ratio(gram):
        below = 1 / (len(shared[1]) + 1)
        for k in range(1, order):
            below = p(counts[k], discount(counts[k].values()), gram[-k:], below)
        return math.log(p(n1, discount(n1.values()), gram, below)) - math.log(p(n0, discount(n0.values()), gram, below))

    return log_ratio


def test_models_by_definition():
    r = random.Random(2)
    grams, order = [Counter(), Counter()], toxicity.ORDER
    for y in (0, 1):
        for _ in range(60):
            w = "<" * (order - 1) + r.choice(["ab", "ba", "cab"]) + r.choice(["", "ba", "xx"]) * (y + 1) + ">"
            grams[y].update(w[k : k + order] for k in range(len(w) - order + 1))
    known = sorted(grams[0] | grams[1])
    n0, n1 = ({g: c[g] for g in known} for c in grams)
    ratio = toxicity.build(pa.array(known), np.array(list(n0.values())), np.array(list(n1.values())))
    plain = by_definition(known, n0, n1)
    asked = [*known, "<" * (order - 2) + "aq", "<" * (order - 3) + "bax", "q" * order]
    codes = np.frombuffer("".join(asked).encode("utf-32-le"), dtype="<u4").reshape(-1, order)
    assert np.allclose(ratio.of(codes), [plain(g) for g in asked])
    word = "<" * (order - 1) + "cabxx>"
    assert np.isclose(ratio.words(["cabxx", "q"])[0], sum(plain(word[k : k + order]) for k in range(len(word) - order + 1)))


INSULTS = ["stupid", "worthless", "lowei", "scum"]


@pytest.fixture(scope="module")
def marked(spark, tmp_path_factory):
    r, rows, labels = random.Random(4), [], []
    for i in range(1200):
        toxic = i % 8 == 0
        words = prose(r, r.choice(["en", "de", "fr"]), r.randrange(4, 200)).split()
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = r.choice(INSULTS) + r.choice(["", "en", "ung", "t"])
        rows.append((i, " ".join(words), None, "s", 0))
        if i % 4 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, "s", 0), (5001, "", None, "s", 0), (5002, "12 ..", None, "s", 0)]
    path = str(tmp_path_factory.mktemp("marked"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_toxic_texts_held_out(spark, marked):
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, marked).collect()}
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i % 8 == 0, r.predicted) for i, r in got.items() if r.held_out and i < 1200]
    assert sum(t == bool(p) for t, p in held) >= 0.97 * len(held) and sum(p for t, p in held if t) >= 0.85 * sum(t for t, _ in held)
    assert {got[i].predicted for i in (5000, 5001, 5002)} == {0} and len({got[i].score for i in (5000, 5001, 5002)}) == 1


def test_toxicity_awkward(spark, marked, awkward, empty):
    docs, labels = (spark.read.parquet(f"{marked}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, train_rows=60)
    named = awkward.withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("rest", F.lit(2)).withColumn("worst", F.lit(3)).withColumn("mixed", F.lit(4))
    found = toxicity.predict(named, model).collect()
    assert len(found) == 5 and {(r["a.b"], r["rest"], r["worst"], r["mixed"]) for r in found} == {(1, 2, 3, 4)} and len({r.score for r in found if r.kept in (5, 6)}) == 1
    long = spark.createDataFrame([("nice words " * 50_000 + "you worthless scum",), ("x" * 500_000,)], "text string")
    assert toxicity.predict(long, model).count() == 2 and toxicity.predict(empty, model).count() == 0
    # without rows of both classes the score is the share of toxic ones
    for toxic, score in ((None, 0.0), (0, 0.0), (1, 1.0)):
        some = labels.filter(F.lit(False)) if toxic is None else labels.filter(F.col("toxic") == toxic)
        assert abs(toxicity.predict(docs, toxicity.fit(docs, some)).agg(F.max("score")).first()[0] - score) < 1e-9
    twice = labels.unionAll(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert len(toxicity.fit(docs.unionAll(docs), twice, train_rows=60).ratio.grams) > 0
    assert common.fold("doc_id", 5) is not None


@pytest.mark.parametrize("name", ["_dealt", "_hot_key", "_cold_key", "_runs", "alike", "a.b", "rest", "row", "id", "key", "word"])
def test_names_that_operators_use_themselves(spark, name):
    from casewright.llm import exact_dedup

    text = "one two three four five six seven"
    rows = spark.createDataFrame([(1, text, "x", 7), (2, text + " ", "y", 7), (3, None, "z", 7)], ["doc_id", "text", "lang", name])
    found = exact_dedup.groups(rows).collect()
    assert {(r.doc_id, r.keep_id, r[name]) for r in found} == {(1, 2, 7), (2, 2, 7), (3, 3, 7)} and len(exact_dedup.keep_one(rows).columns) == 4
    aligned = alignment.align(rows, tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model")).collect()
    assert {(r.doc_id, r[name]) for r in aligned} == {(1, 7), (2, 7), (3, 7)} and spelling.variants(rows, least_length=3, least=1).count() > 0


def test_a_small_share_still_teaches(spark):
    from casewright.llm import language

    rows = spark.createDataFrame([(k, "some words of a text", "en") for k in range(4000)], "doc_id bigint, text string, lang string")
    # one row of a language of ten thousand million must do, so the share is compared with 62 bits of a hash
    assert len(language.fit(rows, train_rows=40).words) > 0
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2).cast("double")
    least = rows.select(F.min(h)).first()[0]
    assert 0 < least < 0.01 * 2**62 and len(language.fit(rows, train_rows=4000 * least / 2**62 * 1.0001).words) > 0
    assert len(language.fit(rows, train_rows=4000 * least / 2**62 * 0.9999).words) == 0
