"""A fitted classifier of rows: features from numbers, names and texts, a logistic regression, and how well it does on rows held out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed words of a text; rows that are fitted on at most, about, a bound of the fit only.
HASHED, SAMPLE = 1 << 12, 200_000


def fit(rows: DataFrame, label: str, numbers: Sequence[str] = (), names: Sequence[str] = (), texts: Sequence[str] = (), ridge: float = 0.01, sample: int = SAMPLE, seed: int = 1) -> PipelineModel:
    """A pipeline from the columns to the probabilities of the label's values, 0 and 1.

    Rows without a label teach nothing; of more than ``sample`` labelled rows about as many are taken, by a hash of the columns. Null
    numbers count as 0, null names as a value of their own, null texts as empty. Names not seen in the fit count as none.
    """
    used = rows.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *[c for c in dict.fromkeys([*numbers, *names, *texts])])
    labelled = prepared(used, numbers, names, texts)
    n = labelled.count()
    if n > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64(*numbers, *names, *texts, F.lit(seed)), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    stages: list = [StringIndexer(inputCol=c, outputCol=f"{c}_at", handleInvalid="keep") for c in names]
    stages += [OneHotEncoder(inputCol=f"{c}_at", outputCol=f"{c}_one", handleInvalid="keep") for c in names]
    for c in texts:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"{c}_words", pattern="\\W+"), HashingTF(inputCol=f"{c}_words", outputCol=f"{c}_hashed", numFeatures=HASHED, binary=True)]
    if numbers:
        stages += [VectorAssembler(inputCols=list(numbers), outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    parts = [*(["scaled"] if numbers else []), *[f"{c}_one" for c in names], *[f"{c}_hashed" for c in texts]]
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), LogisticRegression(regParam=ridge, maxIter=50)]
    return Pipeline(stages=stages).fit(labelled)


def prepared(rows: DataFrame, numbers: Sequence[str], names: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Nulls in the stead of which the features have values."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in names} | {c: F.coalesce(c, F.lit("")) for c in texts})


def scored(rows: DataFrame, model: PipelineModel, numbers: Sequence[str] = (), names: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Add score, the probability of 1, and predicted, which is 1 from 0.5 on."""
    others = [c for c in rows.columns if c not in ("score", "predicted")]
    packed = rows.select(*[F.col(c) for c in {*numbers, *names, *texts}], F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    found = model.transform(prepared(packed, numbers, names, texts)).withColumn("score", vector_to_array("probability")[1])
    return found.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def measured(rows: DataFrame, label: str) -> DataFrame:
    """n, accuracy, auc of scored rows that have a label. auc is the share of pairs of a 1 and a 0 in which the 1 has the greater score, ties half.

    Scores are counted in a thousand steps first, so the pairs are counted by steps.
    """
    steps = rows.filter(F.col(label).isin(0, 1)).withColumn("step", F.floor(F.col("score") * 1000))
    by = steps.groupBy("step").agg(F.count(F.when(F.col(label) == 1, 1)).alias("ones"), F.count(F.when(F.col(label) == 0, 1)).alias("zeros"), F.count(F.when(F.col(label) == F.col("predicted"), 1)).alias("right"))
    listed = by.agg(F.array_sort(F.collect_list(F.struct("step", "ones", "zeros"))).alias("s"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum("right").alias("right"))
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("pairs"))
    won = F.aggregate("s", start, lambda a, x: F.struct((a["below"] + x["zeros"]).alias("below"), (a["pairs"] + x["ones"] * (a["below"] + x["zeros"] / 2)).alias("pairs")))
    n = F.col("ones") + F.col("zeros")
    return listed.select(n.alias("n"), F.try_divide("right", n).alias("accuracy"), F.try_divide(won["pairs"], F.col("ones") * F.col("zeros")).alias("auc"))
