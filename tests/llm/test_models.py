"""Language identification, language-model scores and quality rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import language, lm_scoring, quality
from tests.llm.conftest import DOCS, prose

SPACE = re.compile("[\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def test_language_held_out(spark, folder, texts):
    got = {r.doc_id: r for r in language.op3_language(spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].lang_pred, lang) for i, t, lang in texts if got[i].held_out and i < 90]
    assert len(held) > 8 and all(a == b for a, b in held)
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und"] * 4 and got[104].lang_pred != "und" and got[105].lang_pred == "de"


def plain_language(rows):
    """The back-off by definition, from (lang, text) rows: a function from a text to its languages' log scores."""
    languages = sorted({lang for lang, _ in rows})
    words, grams = Counter(), Counter()
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[w, lang] += 1
    for (w, lang), n in words.items():
        padded = f"<{w}>"
        for order in (4, 3, 2, 1):
            for at in range(len(padded) - order + 1):
                grams[padded[at : at + order], lang] += n

    def table(counts, smooth):
        names = {x for x, _ in counts}
        totals = {lang: sum(n for (_, x), n in counts.items() if x == lang) + smooth * (len(names) + 1) for lang in languages}
        return {x: [math.log((counts[x, lang] + smooth) / totals[lang]) for lang in languages] for x in names}, [math.log(smooth / totals[lang]) for lang in languages]

    known, _ = table(words, 0.1)
    by_order = {order: table(Counter({k: n for k, n in grams.items() if len(k[0]) == order}), 0.5) for order in (4, 3, 2, 1)}

    def of_word(w):
        if w in known:
            return known[w]
        padded = f"<{w}>"
        places = max(1, len(padded) - 3)
        sums = [0.0] * len(languages)
        for at in range(places):
            own = next((t[padded[at : at + order]] for order, (t, _) in by_order.items() if padded[at : at + order] in t), by_order[1][1])
            sums = [a + b for a, b in zip(sums, own, strict=True)]
        return [s / places for s in sums]

    def scores(text):
        found = [of_word(w) for w in re.findall(r"[^\W\d_]+", text.lower())]
        sums = [sum(x) for x in zip(*found, strict=True)]
        best = max(sums)
        odds = [math.exp((s - best) / math.sqrt(len(found))) for s in sums]
        return languages[sums.index(best)], 1 / sum(odds)

    return scores


def test_backoff_by_definition(spark):
    r = random.Random(4)
    rows = [("en", prose(r, "en", 40)) for _ in range(30)] + [("fr", prose(r, "fr", 40)) for _ in range(30)] + [("xx", "zugu zagu gezu " + "uz" * 100)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    plain = plain_language(rows)
    asked = ["talking rivers", "manger la rivière", "zugu gazu", "uz" * 100, "uzuz" * 70, "漢字", "stone zagu", "w" * 3000, *[t for _, t in rows[::9]]]
    got = language.predict(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), language.fit(df)).collect()
    for x in got:
        lang, score = plain(asked[x.k])
        assert (x.lang_pred, round(x.score, 6)) == (lang, round(score, 6)), asked[x.k]
    # a rare language is learned, and words are looked at whole
    assert {x.k: x.lang_pred for x in got}[3] == "xx"


def test_rare_language_beside_a_large_one(spark):
    r = random.Random(5)
    rows = [(i, prose(r, "en", 50) + f" w{i}".replace("0", "o"), "en") for i in range(400)] + [(1000 + i, prose(r, "de", 30), "de") for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_rows=40)
    assert model.languages == ["de", "en"] and language.Scorer(model).predict("der fluss und die brücke")[0] == "de"
    scorer = language.Scorer(model)
    assert scorer.predict("2 ²")[0] == "und" and scorer.predict(None) == ("und", 0.0)


def test_language_only_looks_at_texts(spark, docs):
    model = language.fit(docs)
    a = language.predict(docs, model).select("doc_id", "lang_pred", "score")
    b = language.predict(docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1)), model).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).isEmpty()
    sampled = language.fit(docs, train_rows=30)
    assert set(sampled.languages) == {"en", "fr", "de"}


def test_language_stage(spark, docs, awkward, empty):
    kept = language.recognised(docs.withColumn("score", F.lit("own")))
    assert kept.columns == [*docs.columns, "score"] and {r.score for r in kept.collect()} == {"own"}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert {100, 101, 102, 103} <= gone and not {i for i in range(90)} & gone
    assert language.recognised(empty).count() == 0
    assert language.recognised(awkward).columns == awkward.columns


def test_base_scores_by_hand(spark, folder, texts):
    train = [t or "" for i, t, _ in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in words_of(lower(t)))
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    got = {r.doc_id: r for r in lm_scoring.op7_lm_scoring(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, t, _ in texts:
        words, r = words_of(lower(t or "")), got[i]
        below = math.log10(total + kinds + 1)
        base = sum(math.log10(counts[w] + 1) - below for w in words) + math.log10(len(train) + 1) - below
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(words) + 1 and r.n_known == sum(w in counts for w in words) + 1 and r.train_tokens == total
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score <= 1e-9
    held = [r for r in got.values() if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def context_tree(data, depth):
    """Log10 probabilities by definition: what a bit does to the weighted probability of the root, with KT estimates of all contexts mixed by halves, each
    binary decision on its own. A context that was never seen has no counts and no children, so its probability is one."""
    from functools import lru_cache

    counts = Counter()
    for t in data:
        padded = b"\n" * depth + t + b"\n"
        for at in range(depth, len(padded)):
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = padded[at] >> k & 1
                    counts[padded[at - d : at], node, bit] += 1
                    node = 2 * node + bit
    contexts = {c for c, _, _ in counts}
    children = {}
    for c in contexts:
        if c:
            children.setdefault(c[1:], []).append(c)

    @lru_cache(maxsize=None)
    def kt(c, node):
        a, b = counts[c, node, 0], counts[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(maxsize=None)
    def weighted(c, node):
        own = kt(c, node)
        if len(c) == depth:
            return own
        below = sum(weighted(x, node) for x in children.get(c, ()))
        top = max(own, below)
        return top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)

    def half(own, below):
        top = max(own, below)
        return top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)

    def after(history, node, bit, d):
        """Log weighted probability of the context of ``d`` bytes once the bit has been added to it and all longer ones of this history."""
        c = history[len(history) - d :] if d else b""
        a, b = counts[c, node, 0] + (bit == 0), counts[c, node, 1] + bit
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if d == depth:
            return own
        child = history[len(history) - d - 1 :]
        below = sum(weighted(x, node) for x in children.get(c, ()) if x != child)
        return half(own, below + after(history, node, bit, d + 1))

    def predicted(history, node):
        return math.exp(after(history, node, 1, 0) - weighted(b"", node))

    def score(t):
        total, padded = 0.0, b"\n" * depth + t + b"\n"
        for at in range(depth, len(padded)):
            node = 1
            for k in range(7, -1, -1):
                bit, p = padded[at] >> k & 1, predicted(padded[at - depth : at], node)
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        return total

    return score


def by_definition(train, asked, spark):
    """(got, expected) scores of texts, from the operator and by definition."""
    rows = [(i, t, False) for i, t in enumerate(train)] + [(1000 + i, t, True) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    score = context_tree([b" ".join(t.encode().lower().split()) for t in train], lm_scoring.DEPTH)
    lines = {i: b" ".join(t.encode().lower().split()) for i, t, _ in rows}
    assert all(abs(got[i].bits_per_byte + got[i].score * math.log2(10) / (len(lines[i]) + 1)) < 1e-9 for i in lines)
    return {i: (got[i].score, score(t)) for i, t in lines.items()}


@pytest.mark.parametrize(("batch", "chunk"), [(150_000, 16_000_000), (40, 60)])
def test_context_tree_by_definition(spark, monkeypatch, batch, chunk):
    monkeypatch.setattr(lm_scoring, "BATCH_GRAMS", batch)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    r = random.Random(2)
    train = ["abracadabra", "abc  abc", "banana band", "".join(r.choices("abn ", k=30)), "", "née"]
    asked = ["abra", "banana", "nab a", "bad band", "", "漢字 zzz", "QUITE other w0rds!"]
    for got, expected in by_definition(train, asked, spark).values():
        assert abs(got - expected) < 1e-4 * max(1, abs(expected)), (got, expected)


@pytest.mark.parametrize("n", [1, 10**6, 10**9])
def test_rare_bytes_after_frequent_contexts(n):
    """However often a context was followed by one byte, another one's probability is that of the bit in which they part, and halves after it."""
    context = int.from_bytes(b"abcde", "big") << 8
    keys = np.array([context + b for b in range(256)], dtype=np.uint64)
    counts = np.where(np.arange(256) == ord("~"), n, 0)
    tree = lm_scoring.Subtrees(keys, counts)
    node, slot, value = tree.above()
    node, slot = np.concatenate([node, np.full(256, context >> 32)]), np.concatenate([slot, 256 + np.arange(256)])
    which, value = lm_scoring._summed(node << 9 | slot, np.concatenate([value, counts]))
    logs = tree.log10(lm_scoring._top(which >> 9, which & 511, value))
    parts = [(b ^ ord("~")).bit_length() for b in range(256)]
    expected = [(8 - max(1, k)) * math.log10((n + 0.5) / (n + 1)) + (math.log10(0.5 / (n + 1)) + (k - 1) * math.log10(0.5) if k else math.log10((n + 0.5) / (n + 1))) for k in parts]
    assert np.allclose(logs, expected, rtol=0, atol=1e-5) and abs((10**logs).sum() - 1) < 1e-6


def test_many_contexts(spark):
    r = random.Random(3)
    train = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1800)) for _ in range(40)]
    contexts = {("\n" * 5 + t)[k : k + 5] for t in train for k in range(len(t) + 1)}
    assert len(contexts) > 65_536
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(train)] + [(99, train[0][:40], True)], "doc_id bigint, text string, held_out boolean")
    got = {x.doc_id: x.score for x in lm_scoring.score(df).collect()}
    score = context_tree([t.encode() for t in train], lm_scoring.DEPTH)
    assert abs(got[99] - score(train[0][:40].encode())) < 1e-4 * abs(got[99])


def test_training_order_and_cutting_change_nothing(spark, docs, monkeypatch):
    marked = docs.withColumn("held_out", F.col("doc_id") % 3 == 0)
    whole = {r.doc_id: r for r in lm_scoring.score(marked).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 50)
    monkeypatch.setattr(lm_scoring, "BATCH_GRAMS", 500)
    cut = {r.doc_id: r for r in lm_scoring.score(marked.repartition(7)).collect()}
    assert whole.keys() == cut.keys()
    for i, r in whole.items():
        assert abs(r.score - cut[i].score) < 1e-4 * max(1, abs(r.score)) and abs(r.base_score - cut[i].base_score) < 1e-6 * max(1, abs(r.base_score)) and r[2:5] == cut[i][2:5]


def test_scores_awkward(awkward, empty):
    marked = awkward.withColumn("held_out", F.col("doc_id").isNull())
    got = sorted((r.n_tokens, r.held_out, r.n_known > 1) for r in lm_scoring.score(marked).collect())
    assert got == [(1, True, False), (4, False, True), (81, False, True), (81, False, True), (82, True, True)]
    assert lm_scoring.score(empty.withColumn("held_out", F.lit(False))).count() == 0
    all_held = lm_scoring.score(awkward.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in all_held)


def quality_base(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_base_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    texts = [None, "", "a b", "x " * 50, "one\ntwo\none\n \n \none", "#$ *a* <b> \U0001f389 é\xa0z q", "a b c d e a b c d e f", "\n".join(prose(r, "en", 6) for _ in range(5))]
    texts += [" ".join(r.choices("ab", k=r.randrange(30))) for _ in range(30)] + [prose(r, "en", 400) + "\n" + prose(r, "en", 3)]
    texts += [prose(r, "en", 30) for _ in range(20)]
    spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for row in quality.op10_quality(spark, str(tmp_path)).collect():
        expected = quality_base(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and not (row.base_failed and row.kept)


def js(p, q):
    p, q = np.array(p, dtype=float) / sum(p), np.array(q, dtype=float) / sum(q)
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return math.sqrt((kl(p) + kl(q)) / 2)


@pytest.mark.parametrize(("p", "q"), [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 1]), ([5, 5], [1, 1])])
def test_divergence(spark, p, q):
    df = spark.createDataFrame([([float(x) for x in p], [float(x) for x in q])], "p array<double>, q array<double>")
    assert abs(df.select(quality.divergence(F.col("p"), F.col("q"))).first()[0] - js(p, q)) < 1e-12


def test_odd_texts_are_told_from_clean_ones(spark):
    r = random.Random(1)
    rows = [(i, prose(r, "en", 80), "en") for i in range(40)] + [(100, "0101 2323 " * 60, "en"), (101, prose(r, "en", 80).upper(), None), (102, prose(r, "en", 80), "zz")]
    # numbers that repeat fail the base rule; make them differ
    rows[40] = (100, " ".join(str(r.random()) for _ in range(80)), "en")
    got = {x.doc_id: x for x in quality.rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and not got[101].kept and got[102].kept
    assert "Python" not in quality.rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))._jdf.queryExecution().toString()


def against_sql(spark, path, rows):
    import duckdb

    spark.createDataFrame([(*r, None, None) for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    df = quality.op10_quality(spark, str(path))
    found = c.execute(quality.OP10_SQL)
    assert [x[0] for x in found.description] == df.columns
    return sorted(map(tuple, df.collect())), sorted(found.fetchall())


def test_quality_against_sql(spark, texts, tmp_path):
    r = random.Random(8)
    rows = list(texts)
    # a language without a list of its own, words of one language under another's name, texts without a language
    invented = ["zor", "mab", "kel", "tiv", "ruo", "pex", "lam", "dut"]
    rows += [(1000 + i, " ".join(r.choices(invented, k=90)), "xx") for i in range(12)]
    rows += [(1100 + i, prose(r, "de", 90), "en") for i in range(2)] + [(1200 + i, prose(r, "fr", 90), None) for i in range(3)]
    rows += [(1300, " ".join(f"q{r.randrange(10**6)}z" for _ in range(100)), "en"), (1301, prose(r, "en", 70).upper(), None)]
    got, expected = against_sql(spark, tmp_path, rows)
    assert got == expected
    kept, distance = {x[0]: x[7] for x in got}, {x[0]: x[9] for x in got}
    assert all(distance[1000 + i] is not None and distance[1000 + i] < 0.2 for i in range(12))
    # gibberish has no common words, and another language's words are not the named one's
    assert not kept[1300] and distance[1300] > 0.6 and distance[1100] > 0.5


def test_quality_awkward(spark, awkward, empty, tmp_path):
    rows = quality.rules(awkward).collect()
    assert sorted(str(x.n_words) for x in rows) == sorted(["80", "80", "3", "0", "81"]) and all(x.base_failed == (x.n_words < 10) for x in rows)
    assert quality.rules(empty).count() == 0
    got, expected = against_sql(spark, tmp_path, [(0, "one two", None), (1, None, None)])
    assert got == expected
