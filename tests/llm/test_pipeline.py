"""The pipeline's stages, each on its own input, and the whole against a plain version."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casewright.llm import language, tokens
from tests.llm.test_dedup import SPACE, agreement, roots


def blank_free(text):
    return SPACE.sub("", text or "")


def plain_exact(rows):
    best = {}
    for i, t in rows.items():
        key = blank_free(t)
        order = (-len(t or ""), i)
        if key not in best or order < best[key][0]:
            best[key] = (order, i)
    return {i: rows[i] for _, i in best.values()}


def plain_near(rows):
    ids = sorted(rows)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if agreement(rows[a], rows[b]) >= 0.8]
    found = roots(ids, linked)
    return {i: rows[i] for i in ids if found[i] == i}


def plain_cut(rows, length=100):
    seen, out = set(), {}
    for i in sorted(rows):
        data = (rows[i] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(data[k : k + length])
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone]).decode("utf-8", "ignore")
        if kept or not gone.any():
            out[i] = kept
    return out


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def result(spark, folder):
    return corpus_pipeline.run(spark, folder).collect()


def test_stages_match_plain_versions(spark, docs, folder):
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, docs, folder)
    assert known.columns == docs.columns
    rows = as_dict(known)
    model = language.Scorer(language.fit(docs))
    expected = {r.doc_id for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= language.MIN_SCORE}
    assert set(rows) == expected
    once = stage["exact_copies"](spark, known, folder)
    assert once.columns == docs.columns and as_dict(once) == plain_exact(rows)
    near = stage["near_copies"](spark, once, folder)
    assert near.columns == docs.columns and as_dict(near) == plain_near(as_dict(once))
    cut = stage["repeated_passages"](spark, near, folder)
    assert cut.columns == docs.columns and as_dict(cut) == plain_cut(as_dict(near))
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_run(spark, docs, result):
    known = as_dict(corpus_pipeline.language_id(spark, docs, ""))
    expected = plain_cut(plain_near(plain_exact(known)))
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    pieces = {}
    for r in result:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()))
    assert {i: sum((p for _, p in sorted(parts)), []) for i, parts in pieces.items()} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in expected.items()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_inputs(spark, awkward, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = awkward.withColumn("n_chars", F.lit(None).cast("bigint")) if name == "repeated_passages" else awkward
    got = stage(spark, df, "")
    rows = got.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, None} and all(r.length > 0 for r in rows)
    else:
        assert got.columns == df.columns
        before = sorted(str(r.text) for r in df.collect())
        assert len(rows) == {"language_id": len(rows), "exact_copies": 4, "near_copies": 3, "repeated_passages": 3}[name] and all(str(r.text) in before or name == "repeated_passages" for r in rows)
    assert stage(spark, empty, "").count() == 0


def test_fixed_values():
    assert [re.sub(r"_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "repeated", "packing"] and zlib.crc32(b"1") % 5 >= 0
