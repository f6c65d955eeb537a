"""Language identification by words first, then shorter and shorter character n-grams.

A word that the training texts hold is scored by its log frequency in each language. An unseen word is scored by its
n-grams, of the longest order first: where the longest n-gram at a place is unknown, a shorter one stands in, down to single
characters. Languages are those of the training rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of each language that the model is fitted on, at most about; a bound of the fit, not of what is predicted.
TRAIN_ROWS = 8_000
ORDERS = (4, 3, 2, 1)
#: What is added to each count of a word, and of an n-gram.
SMOOTH_WORDS, SMOOTH_GRAMS = 0.1, 0.5
KEPT_WORDS = 200_000
UNKNOWN = "und"
MIN_SCORE = 0.5
_WORD = re.compile(r"[^\W\d_]+")


class Model:
    """Log frequencies by language of words and n-grams: rows of ``table`` at the places of a word's hash among ``words``, and
    then at those that ``grams`` names."""

    def __init__(self, languages: list[str], words: np.ndarray, grams: dict[str, int], table: np.ndarray, floor: np.ndarray):
        self.languages, self.words, self.grams, self.table, self.floor = languages, words, grams, table, floor

    def word(self, word: str) -> np.ndarray:
        """Log score of one word in each language."""
        h = np.uint64(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))
        at = int(np.searchsorted(self.words, h))
        if at < len(self.words) and self.words[at] == h:
            return self.table[at]
        padded, scores = f"<{word}>", np.zeros(len(self.languages))
        longest = ORDERS[0]
        places = max(1, len(padded) - longest + 1)
        for at in range(places):
            for order in ORDERS:
                if (known := self.grams.get(padded[at : at + order])) is not None:
                    scores += self.table[known]
                    break
            else:
                scores += self.floor
        return scores / places


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows, or on about ``train_rows`` of each language, chosen by a hash of their id and text.

    All their words and all n-grams of whole words count. Rows without a language or text teach nothing; without any row the
    model has no languages. Counts are aggregated on the executors; what the driver gets is bounded by the sampled rows.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    shares = {r.lang: min(1.0, train_rows / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not shares:
        return Model([], np.zeros(0, dtype=np.uint64), {}, np.zeros((0, 0)), np.zeros(0))
    below = F.create_map(*[x for lang, share in shares.items() for x in (F.lit(lang), F.lit(share * float(1 << 62)))])
    chosen = labelled.filter(F.shiftrightunsigned("h", 2).cast("double") < F.element_at(below, F.col("lang")))
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counted = common.materialise(chosen.select("lang", words).filter("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    cut = F.expr("transform(filter(array({}), k -> length(w) >= k), k -> transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k)))".format(", ".join(map(str, ORDERS))))
    grams = counted.select("lang", "n", F.concat(F.lit("<"), "word", F.lit(">")).alias("w")).select("lang", "n", F.explode(F.flatten(cut)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build(sorted(shares), counted.toArrow(), grams.toArrow())


def build(languages: list[str], words: pa.Table, grams: pa.Table) -> Model:
    """The model, from counts (lang, word, n) and (lang, gram, n)."""

    def counts(table: pa.Table, unit: str) -> tuple[list[str], np.ndarray]:
        units = pa.compute.unique(table[unit])
        found = np.zeros((len(units), len(languages)))
        rows = pa.compute.index_in(table[unit], units).to_numpy()
        columns = pa.compute.index_in(table["lang"], pa.array(languages, pa.string())).to_numpy()
        np.add.at(found, (rows, columns), table["n"].to_numpy())
        return units.to_pylist(), found

    def logs(found: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
        totals = found.sum(axis=0) + smooth * (len(found) + 1)
        return np.log((found + smooth) / totals), np.log(smooth / totals)

    names, found = counts(words, "word")
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in names], dtype=np.uint64)
    order = np.argsort(hashes)
    tables = [logs(found, SMOOTH_WORDS)[0][order]]
    names, found = counts(grams, "gram")
    lengths = np.array([len(g) for g in names], dtype=np.int64)
    places = {g: len(hashes) + k for k, g in enumerate(names)}
    scored, floor = np.zeros_like(found), np.zeros(len(languages))
    for k in ORDERS:
        scored[lengths == k], floor = logs(found[lengths == k], SMOOTH_GRAMS)
    return Model(languages, hashes[order], places, np.concatenate([*tables, scored]), floor)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((1024, max(1, len(model.languages))))

    def _row(self, word: str) -> int:
        k = len(self.known)
        if k == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[k] = self.model.word(word)
        self.known[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text and self.model.languages else []
        if not any(map(str.isalpha, words)):
            # the pattern takes signs like a raised two along with letters; alone they say nothing
            words = [w for w in words if any(map(str.isalpha, w))]
            if not words:
                return UNKNOWN, 0.0
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        get, row = self.known.get, self._row
        rows = [k if (k := get(w)) is not None else row(w) for w in words]
        scores = self.matrix[rows].sum(axis=0)
        best = int(scores.argmax())
        # evidence grows less than in proportion with a text's length, as its words aren't independent
        odds = np.exp((scores - scores[best]) / math.sqrt(len(words)))
        return self.model.languages[best], float(1 / odds.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred (a learned language, or ``und``) and score (0 to 1) to every row; columns of these names are replaced.

    Only the text is looked at, all of it. Null texts and texts without a letter are ``und`` with score 0; so are all
    texts if nothing was learned. Languages that tie: the first by name. Repeated rows get equal results, an empty
    table stays empty, other columns pass through whatever their names.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shipped = spark.sparkContext.broadcast((model.languages, model.words, model.grams, model.table, model.floor))
    key = uuid.uuid4().hex
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score") or c == text_col])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("language")
        scorer = _scorer(key, shipped)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


_SCORERS: dict[str, Scorer] = {}
common.kept_by("language", _SCORERS.clear)


def _scorer(key: str, shipped) -> Scorer:
    """One for each worker process and model, the latest only."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(Model(*shipped.value))
    return _SCORERS[key]


def recognised(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text is in a language learned from the labelled rows with a score of ``min_score`` or more, columns as they were."""
    # other columns travel as one struct, so that none meets a name that is added
    packed = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    marked = predict(packed, fit(docs, text_col, lang_col, id_col)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return marked.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the four folds that aren't held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", common.fold("doc_id", 5) == 0)
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
