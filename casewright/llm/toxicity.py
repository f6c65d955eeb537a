"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both models spell words: a character is told by the nine before it in its word, counted in the model's own texts. Below that
they share their counts: a shorter history counts in how many ways it is continued in the texts of either class (Kneser-Ney
continuation counts). So a rare spelling weighs only as far as the classes' own counts differ, and a form of a word never
seen is judged by the stem that was.

The two log-likelihoods are compared word by word, and per character of the worst word. Of a text, the likelihood that a
small share of its words is toxic is compared with that of none, by its length. These and the length go into a logistic
regression, fitted on texts that the models they are measured with haven't seen.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows of each class that are fitted on, at most about; a bound of the fit, not of what is scored.
TRAIN_ROWS = 3_000
#: Characters of a spelling that are looked at together; the share of toxic words of a text that its likelihood supposes.
ORDER, SHARE = 10, 0.02
KEPT_WORDS = 200_000
#: Words counted in a task before their counts are handed on.
HELD_WORDS = 400_000
RIDGE, ROUNDS = 1e-3, 60
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "<", ">"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_counts(docs: DataFrame) -> DataFrame:
    """half, toxic, word, n over rows of half, toxic and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("toxicity")
        held: dict[tuple[int, int], Counter[str]] = defaultdict(Counter)

        def handed() -> pa.RecordBatch:
            rows = [(half, toxic, word, n) for (half, toxic), counts in held.items() for word, n in counts.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["half", "toxic", "word", "n"])

        for batch in batches:
            for half, toxic, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held[half, toxic].update(_WORD.findall((text or "").lower()))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield handed()
        yield handed()

    return docs.select("half", "toxic", "text").mapInArrow(run, "half int, toxic int, word string, n bigint").groupBy("half", "toxic", "word").agg(F.sum("n").alias("n"))


def spellings(counted: DataFrame) -> DataFrame:
    """gram, n0, n1: how often each ORDER characters on end are in the words of each class, words starting with ORDER - 1 marks
    and ending with one."""
    marked = F.concat(F.lit(_START * (ORDER - 1)), "word", F.lit(_END))
    cut = F.expr(f"transform(sequence(1, length(w) - {ORDER - 1}), i -> substring(w, i, {ORDER}))")
    each = counted.select("toxic", "n", marked.alias("w")).select("toxic", "n", F.explode(cut).alias("gram"))
    of = lambda toxic: F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0)).alias(f"n{toxic}")
    return each.groupBy("gram").agg(of(0), of(1))


def _hash(codes: np.ndarray) -> np.ndarray:
    """One number for each row of characters."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h ^= codes[:, k]
            h *= _BASE
            h ^= h >> np.uint64(29)
        h *= _MIX
    return h


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of characters, the place of the first of each kind, and each row's kind."""
    _, first, back = np.unique(_hash(rows), return_index=True, return_inverse=True)
    return first.astype(np.int32), back.astype(np.int32)


def _discount(counts: np.ndarray) -> float:
    """From how many are counted once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _interpolated(counts: np.ndarray, contexts: np.ndarray, below: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Each spelling's probability, given its context's number and its probability with the context's first character left out; and
    each context's weight of that. A context without counts has weight 1."""
    n = contexts.max(initial=-1) + 1
    total, kinds = np.bincount(contexts, counts, n), np.bincount(contexts, counts > 0, n)
    weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    own = np.where(total[contexts] > 0, np.maximum(counts - discount, 0) / np.maximum(total[contexts], 1), 0.0)
    return own + weight[contexts] * below, weight


class Ratio(NamedTuple):
    """By how much the toxic log-likelihood of a spelling is over the ordinary one: of spellings that are known, by sorted hash, and
    of unknown ones with a known history. Otherwise both classes say the same."""

    grams: np.ndarray
    by_gram: np.ndarray
    histories: np.ndarray
    by_history: np.ndarray

    def of(self, codes: np.ndarray) -> np.ndarray:
        def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
            if not len(keys):
                return np.broadcast_to(rest, asked.shape).astype(np.float64)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[at] == asked, values[at], rest)

        return found(self.grams, self.by_gram, _hash(codes), found(self.histories, self.by_history, _hash(codes[:, :-1]), 0.0))

    def words(self, words: list[str]) -> np.ndarray:
        """For each word, the ratio of the whole word with its end."""
        text = "".join([_START * (ORDER - 1) + w + _END for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        return np.add.reduceat(self.of(codes[places[:, None] + np.arange(ORDER)]), np.cumsum(sizes) - sizes)


def build(grams: pa.Array | pa.ChunkedArray, n0: np.ndarray, n1: np.ndarray) -> Ratio:
    """Both models and their ratio, from the counts of distinct spellings in ordinary (n0) and toxic (n1) texts."""
    if not len(grams):
        return Ratio(*[np.zeros(0, t) for t in (np.uint64, np.float64, np.uint64, np.float64)])
    codes = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)
    # the shared orders: of each shorter spelling, one place that it is at, and in how many ways it is preceded
    places = [np.arange(len(codes), dtype=np.int32)]
    up, ways = [], []
    for k in range(1, ORDER):
        first, back = _kinds(codes[places[-1], k:])
        up.append(back)
        ways.append(np.bincount(back).astype(np.float32))
        places.append(places[-1][first])
    below = np.full(len(places[-1]), 1.0 / (len(places[-1]) + 1))
    for k in range(ORDER - 2, -1, -1):
        contexts = _kinds(codes[places[k + 1], k + 1 : -1])[1]
        below = _interpolated(ways[k], contexts, below, _discount(ways[k]))[0][up[k]]
    first, contexts = _kinds(codes[:, :-1])
    histories = codes[first, :-1]
    (p0, w0), (p1, w1) = (_interpolated(n.astype(np.float64), contexts, below, _discount(n)) for n in (n0, n1))
    keys, held = _hash(codes), _hash(histories)
    a, b = np.argsort(keys), np.argsort(held)
    return Ratio(keys[a], (np.log(p1) - np.log(p0))[a], held[b], (np.log(w1) - np.log(w0))[b])


#: Of a text: the greatest ratio per character of a word; the greatest of a word; the ratio of the text with and without a share of
#: toxic words, by the root of how many words it has; the logarithm of one more than these.
MEASURES = ("worst", "word", "mixed", "size")
#: A word's ratio, beyond which more says nothing.
MOST = 20.0


class Measurer:
    """The measures of whole texts; words seen before are looked up."""

    def __init__(self, ratio: Ratio):
        self.ratio = ratio
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, 3))

    def measure(self, text: str | None) -> tuple[float, float, float, float]:
        """MEASURES; zeros for a text without words."""
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        if missing := list({w for w in words if w not in known}):
            first, end = len(known), len(known) + len(missing)
            if end > len(self.values):
                self.values = np.concatenate([self.values, np.zeros((max(len(self.values), end), 3))])
            ratio = np.minimum(self.ratio.words(missing), MOST)
            self.values[first:end] = np.column_stack([ratio / [len(w) + 1 for w in missing], ratio, np.log(1 - SHARE + SHARE * np.exp(ratio))])
            known.update(zip(missing, range(first, end), strict=True))
        found = self.values[list(map(known.__getitem__, words))]
        worst, word, _ = found.max(axis=0)
        return float(worst), float(word), float(found[:, 2].sum() / math.sqrt(len(words))), math.log1p(len(words))


class Model(NamedTuple):
    """The ratio, and the regression's weights (measures and one constant)."""

    ratio: Ratio
    weights: np.ndarray

    def score(self, measures: tuple[float, ...]) -> float:
        z = float(np.dot(self.weights, [*measures, 1.0]))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def regression(measures: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with a small ridge; the last is the constant."""
    mean, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-9
    x = np.column_stack([(measures - mean) / spread, np.ones(len(measures))])
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - RIDGE * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + RIDGE * np.eye(len(w)), slope)
        w = w + step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - scaled @ mean)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` (id and label) marks 0 or 1, or on about ``train_rows`` of each class, chosen by a
    hash of the id; whole texts.

    Rows without an id, label or text teach nothing; if labels of an id differ, the greatest counts. If a class has no rows, the
    score is the share of toxic ones (0 without any). The classes' shares among all labelled rows hold for the scores, however
    many of each were chosen. What the driver gets is bounded by the chosen rows: their spellings, and a few measures of each.
    """
    common.prepare(docs.sparkSession)
    marked = labels.filter(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("toxic"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    # labels may cover other documents too, so that counts are of those that are here
    there = common.materialise(marked.join(texts.select("doc_id").distinct(), "doc_id"), "toxicity-labels")
    n = {r.toxic: r["count"] for r in there.groupBy("toxic").count().collect()}
    if len(n) < 2:
        odds = 30.0 if n.get(1) else -500.0
        return Model(build(pa.array([], pa.string()), np.zeros(0), np.zeros(0)), np.array([*[0.0] * len(MEASURES), odds]))
    below = F.when(F.col("toxic") == 1, F.lit(min(1.0, train_rows / n[1]))).otherwise(F.lit(min(1.0, train_rows / n[0])))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    # the chosen labels are 2 * train_rows at most, about, so sending them to all is safe
    chosen = there.filter(F.shiftrightunsigned(h, 2).cast("double") < below * F.lit(float(1 << 62))).withColumn("half", h.bitwiseAND(F.lit(1)).cast("int"))
    rows = common.materialise(texts.join(F.broadcast(chosen), "doc_id").select("half", "toxic", "text"), "toxicity-rows")
    counted = common.materialise(word_counts(rows), "toxicity-words")

    def learned(words: DataFrame) -> Ratio:
        table = spellings(words).toArrow()
        return build(table["gram"], table["n0"].to_numpy(), table["n1"].to_numpy())

    # texts are measured with the half that doesn't hold them
    measured = [measures(rows.filter(F.col("half") == 1 - k).drop("half"), learned(counted.filter(F.col("half") == k))).drop("text").toArrow() for k in (0, 1)]
    seen = pa.concat_tables(measured)
    if len(seen) == 0 or len(set(seen["toxic"].to_pylist())) < 2:
        return Model(learned(counted), np.array([*[0.0] * len(MEASURES), math.log(n[1] / n[0])]))
    toxic = seen["toxic"].to_numpy().astype(np.float64)
    weight = np.where(toxic == 1, n[1] / toxic.sum(), n[0] / (1 - toxic).sum())
    return Model(learned(counted), regression(np.column_stack([seen[c].to_numpy() for c in MEASURES]), toxic, weight))


_KEPT: dict[str, Measurer] = {}
common.kept_by("toxicity", _KEPT.clear)


def measures(docs: DataFrame, ratio: Ratio, text_col: str = "text") -> DataFrame:
    """Add the measures of every whole text as columns MEASURES, in place of columns of these names."""
    spark = docs.sparkSession
    common.prepare(spark)
    shipped = spark.sparkContext.broadcast(tuple(ratio))
    key = uuid.uuid4().hex
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES or c == text_col])
    at = kept.columns.index(text_col)
    places = [k for k, c in enumerate(kept.columns) if c not in MEASURES]
    schema = T.StructType([kept.schema[k] for k in places] + [T.StructField(c, T.DoubleType()) for c in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("toxicity")
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Measurer(Ratio(*shipped.value))
        measurer = _KEPT[key]
        for batch in batches:
            found = np.array([measurer.measure(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], *[pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(MEASURES))]], names=schema.names)

    return kept.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1, higher: toxic likelier) and predicted (1 if score is 0.5 or more) to every row, in place of columns of these names.

    Only the text is looked at, all of it. Null texts and texts without letters get the score of a text of no words. Repeated
    rows get equal scores, an empty table stays empty, all other columns pass through whatever their names.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    packed = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    z = sum((F.col(c) * float(w) for c, w in zip(MEASURES, model.weights[:-1], strict=True)), F.lit(float(model.weights[-1])))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    scored = measures(packed, model.ratio).withColumn("score", score)
    return scored.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the four folds that aren't held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", common.fold("doc_id", 5) == 0)
    model = fit(docs.filter(~F.col("held_out")), common.read(spark, sf_dir, "labels"))
    return predict(docs, model).select("doc_id", "held_out", "score", "predicted")
