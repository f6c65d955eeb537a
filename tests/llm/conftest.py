"""Small documents with the cases that operators must bear."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the of and river stone walked under morning light while seven birds sang over an old wooden bridge near town people".split(),
    "fr": "le la des rivière pierre marchait sous lumière matin pendant oiseaux chantaient vieux pont bois près ville gens était où".split(),
    "de": "der die das fluss stein ging unter licht morgen während vögel sangen über alte hölzerne brücke nahe stadt leute schön".split(),
}


def prose(r, lang="en", n=60):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang): prose in three languages, copies, near copies, shared passages, blanks, nulls, one very long text."""
    r = random.Random(7)
    rows = [(i, prose(r, lang, r.randrange(5, 120)), lang) for i, lang in enumerate(r.choices(list(WORDS), k=90))]
    shared = prose(r, "en", 40)
    for i in range(90, 100):
        base = rows[r.randrange(90)][1]
        words = base.split()
        words[r.randrange(len(words))] = "changed"
        rows.append((i, {0: base, 1: base.replace(" ", "  \n"), 2: " ".join(words), 3: prose(r, "fr", 20) + shared, 4: shared + prose(r, "en", 9)}[i % 5], "en"))
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t", "fr"), (103, "1234 ²", None), (104, "née à Zürich — 漢字 🎉", None), (105, prose(r, "de", 9000), "de"), (106, "x", "en"), (107, "x", "en"), (108, "<|endoftext|> a  b\nc", "en")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in texts], DOCS).repartition(3)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def awkward(spark):
    """Repeated and missing ids, null columns, and further columns named like what operators add."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None, 5, "k", "h"), (1, text, None, 6, "k", "h"), (1, "other words here", "en", 7, None, None), (None, None, None, None, None, None), (None, text + " more", "fr", 8, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int, keep_id string, _doc string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
