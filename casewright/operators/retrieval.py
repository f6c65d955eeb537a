"""Retrieval: by words, by vectors, and of examples by common words."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C

LEAST_OVERLAP, OVERFETCH = 2, 4


def words(text: Column) -> Column:
    """Words of three and more ASCII letters or digits, in lower case; all other signs part words."""
    cleaned = F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", " ")
    return F.filter(F.split(cleaned, "\\s+"), lambda w: F.length(w) > 2)


def question_words(text: Column, least: int = 3) -> Column:
    """The set of words (letters, digits, underscore) of ``least`` characters or more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: F.length(w) >= least))


def _split(query: str) -> list[str]:
    cleaned = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in query.lower())
    return [w for w in cleaned.split() if len(w) > 2]


def by_words(rows: DataFrame, query: str, k: int = 5, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """The ``k`` best rows for the query's words, with a score: occurrences of the query's words, n / (n + 1).

    Of the 4k best scores, rows with fewer than two of the query's words (one, if it has but one) are left out; a word
    that the query repeats counts each time. Words match exactly, without stemming. Ties: the least id. A query without
    words finds nothing; null texts are never found.
    """
    asked = _split(query)
    if not asked:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    listed = F.array(*[F.lit(w) for w in asked])
    found = F.filter(words(F.col(text_col)), lambda w: w.isin(sorted(set(asked))))
    # most rows hold none of the words, which is cheaper to see than what words they have
    lowered = F.lower(F.col(text_col))
    held = rows.filter(reduce(lambda a, b: a | b, [lowered.contains(w) for w in sorted(set(asked))]))
    scored = held.withColumn("_found", found).filter(F.size("_found") > 0).withColumn("score", F.size("_found") / (F.size("_found") + 1))
    best = scored.orderBy(F.desc("score"), id_col).limit(OVERFETCH * k)
    gated = best.filter(F.size(F.filter(listed, lambda w: F.array_contains("_found", w))) >= min(LEAST_OVERLAP, len(asked)))
    return gated.drop("_found").orderBy(F.desc("score"), id_col).limit(k)


def by_vector(rows: DataFrame, query: Sequence[float], k: int = 5, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The ``k`` rows of greatest cosine similarity to the query, exactly, over all rows that have a vector; with a score.

    Each task keeps its ``k`` best, so little travels whatever the table's size."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(F.col(vector_col).isNotNull()).withColumn("score", C.cosine(F.col(vector_col), asked)).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def similar(rows: DataFrame, query: str, k: int = 5, embed: Callable[[str], Sequence[float] | None] | None = None, text_col: str = "text", vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """By vector where ``embed`` gives one and something is found, else by words; an empty query finds nothing."""
    if embed is not None and query.strip():
        try:
            vector = embed(query)
        except Exception:  # an embedding service that is down: words are the way out
            vector = None
        if vector is not None and not (found := by_vector(rows, vector, k, vector_col, id_col)).isEmpty():
            return found
    return by_words(rows, query, k, text_col, id_col)


def similar_examples(examples: DataFrame, question: str, k: int = 3, text_col: str = "question", order: str = "idx", exclude: int | None = None) -> DataFrame:
    """The ``k`` examples with the most common words in proportion to all, of equal ones the first; one may be held out."""
    rows = examples if exclude is None else examples.filter(F.col(order) != exclude)
    scored = rows.withColumn("score", C.jaccard(question_words(F.col(text_col)), question_words(F.lit(question))))
    return scored.orderBy(F.desc("score"), order).limit(k)


def similar_examples_by_vector(examples: DataFrame, vectors: DataFrame, query: Sequence[float], k: int = 3, order: str = "idx", exclude: int | None = None) -> DataFrame:
    """The ``k`` examples of nearest vectors; those without a vector are left out. ``vectors``: the order column and embedding."""
    rows = examples.join(vectors.select(order, "embedding"), order)
    return by_vector(rows if exclude is None else rows.filter(F.col(order) != exclude), query, k, id_col=order)


def routed_examples(examples: DataFrame, vectors: DataFrame | None, question: str, k: int = 3, embed: Callable[[str], Sequence[float] | None] | None = None, order: str = "idx", exclude: int | None = None) -> DataFrame:
    """Examples by vector where ``embed`` gives one and something is found, by common words on any failure; idx and score."""
    if embed is not None and vectors is not None:
        try:
            vector = embed(question)
            if vector is not None and not (found := similar_examples_by_vector(examples, vectors, vector, k, order, exclude)).isEmpty():
                return found.select(order, "score")
        except Exception:  # whatever the service does, there are still the words
            pass
    return similar_examples(examples, question, k, order=order, exclude=exclude).select(order, "score")


def by_listed_places(examples: DataFrame, answer: str | None, k: int = 3, order: str = "idx") -> DataFrame:
    """The examples at the places that an answer lists as a JSON array of numbers, in its order, scored 1 less 0.01 for each
    place before; places out of range or listed twice are passed over. Without such a list, the first ``k``."""
    listed = F.from_json(F.regexp_extract(F.lit(answer or ""), r"\[[\d\s,]*\]", 0), "array<int>")
    wanted = examples.select(F.array_distinct(F.coalesce(listed, F.array().cast("array<int>"))).alias("_w"), "*")
    found = wanted.withColumn("_at", F.array_position("_w", F.col(order).cast("int"))).filter(F.col("_at") > 0)
    if found.isEmpty():
        return examples.orderBy(order).limit(k).withColumn("score", F.lit(1.0) - F.col(order) * 0.01)
    from pyspark.sql import Window

    ranked = found.withColumn("_rank", F.row_number().over(Window.orderBy("_at")))  # at most as many rows as the answer lists
    return ranked.withColumn("score", F.lit(1.0) - (F.col("_rank") - 1) * 0.01).orderBy("_rank").limit(k).drop("_w", "_at", "_rank")
