"""Stems, word search, vector search, nearest examples, names within names."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.functions import stemming
from casewright.operators import names, nearest, retrieval, search, vectors

# Words and their stems as the published rules have them.
STEMS = dict(
    pair.split(":")
    for pair in """consign:consign consigned:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori consolidate:consolid consolingly:consol
    conspicuously:conspicu conspiracy:conspiraci constables:constabl constancy:constanc knackeries:knackeri knavish:knavish kneeled:kneel knitted:knit knives:knive knocker:knocker
    generate:generat generous:generous generically:generic communism:communism arsenic:arsenic skies:sky dying:die news:news succeed:succeed proceeding:proceed ties:tie cries:cri by:by say:say happy:happi
    enjoy:enjoy hopping:hop hoping:hope hopeful:hope relational:relat conditional:condit rationally:ration sensibility:sensibl agreed:agre feed:feed sized:size falling:fall fizzed:fizz bed:bed youth:youth
    flying:fli theft:theft stealing:steal gas:gas this:this kiwis:kiwi national:nation adjustment:adjust replacement:replac adoption:adopt controlled:control rate:rate goodness:good usefulness:use""".split()
)


def test_stems(spark):
    rows = spark.createDataFrame([(w, 1) for w in STEMS] + [(None, 2)], "word string, `a.b` int")
    found = {r.word: r.stem for r in stemming.with_stem(rows).collect()}
    assert found == STEMS | {None: None}
    c = duckdb.connect()
    c.execute("CREATE TABLE w AS SELECT unnest(?) AS word", [list(STEMS)])
    assert dict(c.execute(stemming.stem_sql("w")).fetchall()) == STEMS


TEXTS = ["The thieves were stealing cars", "a car was stolen, stealing is theft", "steal steals stealing steal", "nothing here", None, "", "cars cars cars and thefts and thefts", "the the the and and", "Steal! theft? car;", "stealing", "x" * 50 + " car theft"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    return docs, search.build(docs, str(tmp_path_factory.mktemp("index") / "words"), buckets=8, shares=2)


@pytest.mark.parametrize("query", ["stealing cars", "theft", "the and", "", "steal steal theft", "zebra cars", "the theft of cars and stealing"])
@pytest.mark.parametrize("eager", [search.EAGER, 0])
def test_search_is_a_scan(spark, index, monkeypatch, query, eager):
    monkeypatch.setattr(search, "EAGER", eager)
    docs, made = index
    got = [(r.id, round(r.score, 9)) for r in search.search(spark, made, query, 4).collect()]
    if not retrieval._split(query) or query == "the and":
        assert got == []
        return
    c = duckdb.connect()
    c.register("docs", docs.toPandas())
    assert got == [(i, s) for i, s in c.execute(search.search_sql(query, 4, "docs", "text", "id")).fetchall()]


def test_search_reads_the_asked_words_only(spark, index):
    _, made = index
    stems = search.asked_stems(spark, ["stealing", "the"])
    assert stems == ["steal"]
    forms = made.dictionary(spark).filter(F.col("stem").isin(stems))
    plan = search._of_words(made, spark, forms)._jdf.queryExecution().executedPlan().toString()
    assert "In(word" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket")


def test_words_beyond_those_named_meet_in_a_join(spark, index, monkeypatch):
    _, made = index
    want = search.search(spark, made, "stealing cars", 4).collect()
    monkeypatch.setattr(search, "NAMED", 0)
    assert search.search(spark, made, "stealing cars", 4).collect() == want


@pytest.mark.parametrize("block_bytes", [1, 40, search.BLOCK_BYTES])
def test_postings_lie_in_blocks(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
    odd = ["", None, "ab", "Abc", "abc", "...", "d\u00e9j\u00e0vu abcd", "\u212aelvin \u0130stanbul", "abc\x00abc\tab\u2003abc_12 123", "\u00e9", "x" * 100, ""]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(odd + ["Theft of the cars, theft"] * 400)], "`a.b` string, `t.t` string").coalesce(1)
    made = search.build(docs, str(tmp_path / "words"), "t.t", "a.b", buckets=4, shares=2)
    each = docs.select(F.col("`a.b`").alias("id"), F.explode(retrieval.words(F.col("`t.t`"))).alias("word")).groupBy("word", "id").count()
    want = {(r.word, r.id, r["count"]) for r in each.collect()}
    got = [(r.word, r.id, r.n) for r in made.postings(spark).collect()]
    assert len(got) == len(want) and set(got) == want
    texts = {(r.word, r.texts, r.most) for r in made.dictionary(spark).collect()}
    assert texts == {(w, len(x), max(x)) for w in {w for w, _, _ in want} for x in [[n for v, _, n in want if v == w]]}
    if block_bytes == search.BLOCK_BYTES and block_bytes > 1000:
        # 400 texts with three words are three rows, not 1,200
        assert spark.read.parquet(f"{made.path}/postings").count() == len({w for w, _, _ in want})


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + 0.15 * r.normal(size=16)).tolist()) for k in range(2000)] + [(2000, None), (2001, [0.0] * 16)] + [(3000 + k, (centres[0] * 2).tolist()) for k in range(3)]
    return rows, spark.createDataFrame(rows, "id bigint, embedding array<double>")


@pytest.mark.parametrize("probes", [1, 3])
def test_vectors_by_bounds_are_exact(spark, points, tmp_path, probes):
    rows, df = points
    made = vectors.build(df, str(tmp_path / "cells"), cells=20, sample=600)
    asked = df.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    there = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and any(v)]
    want = {}
    for q, v in there:
        if q % 100 == 0:
            want[q] = [i for i, _ in sorted(((i, round(float(v @ u), 9)) for i, u in there), key=lambda x: (-x[1], x[0]))[:8]]
    exact, quick = ({}, {})
    for found, how in ((exact, True), (quick, False)):
        for r in vectors.search(spark, made, asked, 8, probes, how).orderBy("query", "place").collect():
            found.setdefault(r["query"], []).append(r.id)
    assert exact == want and set(want) == {*range(0, 2000, 100), 3000}
    # one cell of twenty holds nine in ten of the nearest
    hits = sum(len({*quick[q]} & {*want[q]}) for q in want) / sum(map(len, want.values()))
    read = vectors.probed(spark, made, asked).filter(F.col("place") < probes).join(made.cells(spark), "cell").agg(F.sum("n")).first()[0] / (len(want) * len(there))
    assert hits >= 0.9 and read <= 0.09 * probes


def test_vectors_awkward(spark, points, tmp_path):
    _, df = points
    none = vectors.build(df.limit(0), str(tmp_path / "none"))
    asked = df.select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    assert vectors.search(spark, none, asked).count() == 0
    few = vectors.build(df.filter("id < 3"), str(tmp_path / "few"))
    assert vectors.search(spark, few, asked.filter("query >= 2000 AND query < 2002")).count() == 0
    assert vectors.search(spark, few, asked.filter("query < 2"), 5).count() == 6


@pytest.mark.parametrize("hold_out", [True, False])
def test_nearest_examples_against_all_pairs(spark, hold_out):
    r = random.Random(1)
    vocabulary = ["the", "and", "was", *[f"word{k}" for k in range(30)]]
    rows = [(k, " ".join(r.choice(vocabulary[: r.choice([3, 8, 33])]) for _ in range(r.randrange(0, 9)))) for k in range(70)] + [(70, None), (71, "unseen words only"), (72, "the and was the")]
    df = spark.createDataFrame(rows, "idx bigint, question string")
    asked = df.filter("idx % 3 = 0 OR idx >= 70").withColumnRenamed("idx", "query")
    sets = {k: {w for w in (t or "").split() if len(w) >= 3} for k, t in rows}
    want = {}
    for q in [k for k in sets if k % 3 == 0 or k >= 70]:
        scores = [(-(len(sets[q] & s) / len(sets[q] | s) if sets[q] | s else 0.0), k) for k, s in sets.items() if not (hold_out and k == q)]
        want[q] = [(k, round(-s, 9)) for s, k in sorted(scores)[:4]]
    got = {}
    for x in nearest.nearest_examples(df, asked, 4, hold_out=hold_out).orderBy("query", "place").collect():
        got.setdefault(x["query"], []).append((x.idx, round(x.score, 9)))
    assert got == want


def test_names_within_names(spark):
    r = random.Random(2)
    draw = lambda n: ["".join(r.choice("abAB c") for _ in range(r.randrange(0, n))) for _ in range(60)]
    inner, outer = [*draw(6), None, "a", "ab"], [*draw(14), None, "", "ab"]
    a, b = spark.createDataFrame([(x,) for x in inner], "x string"), spark.createDataFrame([(x,) for x in outer], "y string")
    low = lambda names: {n.lower() for n in names if n}
    want = {(i, o) for i in low(inner) for o in low(outer) if i in o}
    assert {tuple(x) for x in names.holding(a, b, "x", "y").collect()} == want
    assert {tuple(x) for x in names.either(a, b, "x", "y").collect()} == want | {(i, o) for i in low(inner) for o in low(outer) if o in i}
    plan = names.holding(a, b, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert names.holding(a.limit(0), b, "x", "y").count() == 0


def test_names_are_not_broadcast(spark):
    """Parts are many times what the names' size tells, so no join of them waits for the driver."""
    a, b = spark.range(20).selectExpr("lpad(CAST(id AS STRING), 5, '0') AS x"), spark.range(0, 4000, 7).selectExpr("concat('No', lpad(CAST(id AS STRING), 7, '0')) AS y")
    found = names.holding(a, b, "x", "y")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(f"{i:05d}", f"no{k:07d}") for i in range(20) for k in range(0, 4000, 7) if f"{i:05d}" in f"no{k:07d}"}
