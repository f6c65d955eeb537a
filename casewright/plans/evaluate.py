"""How well a generator of SQL does on example questions: do its statements pass the gate and run, and how near do they come."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import nearest, retrieval
from casewright.plans import sqlgate
from casewright.sources import store

RESULT = "idx bigint, generated_sql string, passed boolean, error string"


def _ran(spark: SparkSession, statements: dict[int, DataFrame]) -> dict[int, str]:
    """Run all statements in one job; what goes wrong is looked for by halves. Errors by key."""
    if not statements:
        return {}
    try:
        counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in statements.values()]
        reduce(DataFrame.unionAll, counts).collect()
        return {}
    except Exception as x:  # what fails is the result
        if len(statements) == 1:
            return {k: f"{type(x).__name__}: {x}"[:500] for k in statements}
    keys = list(statements)
    halves = (keys[: len(keys) // 2], keys[len(keys) // 2 :])
    return _ran(spark, {k: statements[k] for k in halves[0]}) | _ran(spark, {k: statements[k] for k in halves[1]})


def evaluate(spark: SparkSession, examples: DataFrame, generate: Callable[[str, list[dict]], str], k: int = 3, hold_out: bool = False, questions: DataFrame | None = None) -> DataFrame:
    """For each example (idx, question, sql; idx distinct), or each of those that ``questions`` lists: question, generated_sql, passed, error,
    top_score, token_overlap.

    The ``k`` nearest examples of all questions are found in one go, without a question's own if held out. ``generate`` is any picklable
    function of a question and its examples (with score); it is called on the executors. A statement passes if the gate lets it through and it
    runs; those that are let through run in one job. The driver gets the statements, one for each question. token_overlap: words in
    common with the example's own SQL.
    """
    examples = examples.select("idx", "question", "sql")
    listed = examples if questions is None else examples.join(questions.select("idx"), "idx", "left_semi")
    near = nearest.nearest_examples(examples, listed.select(F.col("idx").alias("query"), "question"), k, hold_out=hold_out)
    shown = near.join(examples, "idx").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "question", "sql", "score"))).alias("examples"), F.max("score").alias("top_score"))
    prompts = listed.select(F.col("idx").alias("query"), "question").join(shown, "query", "left").select("query", F.to_json(F.struct("question", "examples")).alias("prompt"))
    asked = store.enriched(prompts, "prompt", "generated_sql", "string", _Prompts(generate))
    found, ready = {}, {}
    for r in asked.select("query", "generated_sql").collect():
        text, error = None, None
        try:
            said = json.loads(r.generated_sql)
            if said["error"]:
                raise RuntimeError(said["error"])
            text = sqlgate.sanitize(said["text"] or "")
            ready[r["query"]] = sqlgate.run(spark, text)  # planned only
        except Exception as x:  # what fails is the result
            error = f"{type(x).__name__}: {x}"[:500]
        found[r["query"]] = (text, error)
    failed = _ran(spark, ready)
    rows = [(q, text, (error or failed.get(q)) is None, error or failed.get(q)) for q, (text, error) in found.items()]
    made = spark.createDataFrame(rows, RESULT).join(examples, "idx").join(shown.select(F.col("query").alias("idx"), "top_score"), "idx", "left")
    overlap = C.jaccard(retrieval.question_words(F.coalesce("generated_sql", F.lit("")), 1), retrieval.question_words(F.col("sql"), 1))
    return made.withColumn("token_overlap", overlap).drop("sql")


class _Prompts:
    """A generator of statements as a service over prompts in JSON; a prompt that it fails on says so, and the others go on."""

    def __init__(self, generate: Callable[[str, list[dict]], str]):
        self.generate = generate

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._one(json.loads(p)) for p in prompts]

    def _one(self, prompt: dict) -> str:
        try:
            return json.dumps({"text": self.generate(prompt["question"], prompt.get("examples") or []), "error": None})
        except Exception as x:  # the generator's failures are results too
            return json.dumps({"text": None, "error": f"{type(x).__name__}: {x}"})


def summary(results: DataFrame) -> DataFrame:
    """One row: questions, passed percent, mean top score, mean overlap."""
    return results.agg(F.count(F.lit(1)).alias("questions"), C.percent(F.col("passed")).alias("passed_percent"), F.avg("top_score").alias("top_score"), F.avg("token_overlap").alias("token_overlap"))
