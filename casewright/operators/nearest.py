"""The nearest examples of many questions in one go, by the words they have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators.retrieval import question_words
from casewright.sources import store


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that rounds don't repeat what was done before."""
    path = store.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _first(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "idx"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def nearest_examples(examples: DataFrame, questions: DataFrame, k: int = 3, text_col: str = "question", order: str = "idx", query_col: str = "query", hold_out: bool = False) -> DataFrame:
    """query, idx, score, place: for every question the ``k`` examples with the most common words in proportion to all, of equal ones the first.

    ``questions``: a key ``query_col`` and ``text_col``; keys are distinct, as are the examples'. With ``hold_out`` a question's own example
    (of equal key) is left out. Examples with no common word follow with score 0, in their order. Null texts have no words.

    A question's rarest words are looked up first. What they don't find has at most the other words in common, which bounds its score;
    a question is done once its ``k``-th best is above that bound. So common words are looked up only for those that need them, and only among
    examples whose number of words leaves them a chance.
    """
    sets = _kept(examples.select(F.col(order).alias("idx"), question_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).withColumn("size", F.size("words")), "sets")
    asked = questions.select(F.col(query_col).alias("query"), question_words(F.coalesce(F.col(text_col), F.lit(""))).alias("asked")).withColumn("n", F.size("asked"))
    asked = _kept(asked, "asked")
    places = sets.select("idx", "size", F.explode("words").alias("word"))
    held = places.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    # words that no example has stand first and find nothing
    rarity = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("texts", F.lit(0)), "word"))
    ranked = _kept(asked.select("query", "n", F.explode("asked").alias("word")).join(held, "word", "left").withColumn("rank", rarity), "ranked")
    best = asked.limit(0).select("query", F.lit(None).cast(sets.schema["idx"].dataType).alias("idx"), F.lit(0.0).alias("score"), F.lit(1).alias("place"))
    active = asked.select("query", "n", F.lit(0.0).alias("kth")).filter("n > 0")
    done, upto = 0, 2
    while not active.isEmpty():
        # an example found by none of the first `done` words has at most n - done words in common
        chance = (F.col("n") - done) / (F.col("size") + done)
        found = ranked.filter((F.col("rank") > done) & (F.col("rank") <= upto)).drop("n").join(active, "query").join(places, "word").filter(chance >= F.col("kth"))
        pairs = found.filter(F.col("query") != F.col("idx")) if hold_out else found
        scored = pairs.select("query", "idx").distinct().join(sets.select("idx", "words"), "idx").join(asked.select("query", "asked"), "query").select("query", "idx", C.jaccard(F.col("words"), F.col("asked")).alias("score"))
        # an example may be found again by a later word
        best = _kept(_first(best.select("query", "idx", "score").unionByName(scored).distinct(), k), "best")
        kth = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        bound = (F.col("n") - upto) / F.col("n")
        active = active.drop("kth").join(kth, "query", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0))).filter((F.col("n") > upto) & (F.col("kth") <= bound))
        active = _kept(active.select("query", "n", "kth"), "active")
        done, upto = upto, upto * 2
    # fewer than k: the first examples of all, of which k - 1 at most are among the found ones, and one may be held out
    short = asked.select("query").join(best.groupBy("query").agg(F.count(F.lit(1)).alias("found")), "query", "left").filter(F.coalesce("found", F.lit(0)) < k)
    heads = sets.select("idx").orderBy("idx").limit(2 * k + 1).agg(F.collect_list("idx").alias("heads"))
    filled = short.select("query").join(F.broadcast(heads)).select("query", F.explode("heads").alias("idx"))
    filled = filled.filter(F.col("query") != F.col("idx")) if hold_out else filled
    zeros = filled.join(best.select("query", "idx"), ["query", "idx"], "left_anti").withColumn("score", F.lit(0.0))
    return _first(best.select("query", "idx", "score").unionByName(zeros), k)
