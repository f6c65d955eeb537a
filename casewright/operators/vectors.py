"""Nearest vectors by cosine over an index of cells.

Vectors of length one lie around the centres of k-means cells. By the triangle inequality no vector of a cell is nearer to a query
than the query's distance to the centre less the vector's own, its residual. A search reads the cells of the nearest centres first; then, to
be exact, those cells and residuals whose bound is still below the k-th best distance. What is read is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import columns as C

#: Cells; shares into which a cell is dealt; rows from which the centres are found, at most about, a bound of the fit only.
CELLS, SHARES, SAMPLE = 64, 4, 50_000
#: Cells that an approximate search reads.
PROBES = 16
_SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """Where an index is."""

    path: str

    def vectors(self, spark: SparkSession) -> DataFrame:
        """cell, id, vector, residual; one folder for each cell, sorted by residual."""
        return spark.read.parquet(f"{self.path}/vectors")

    def cells(self, spark: SparkSession) -> DataFrame:
        """cell, centre, n, least, most: how many vectors each cell has, and its residuals' range."""
        return spark.read.parquet(f"{self.path}/cells")


def _unit(vector: Column) -> Column:
    """The vector in doubles, of length one; null without a length."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def build(rows: DataFrame, path: str, vector_col: str = "embedding", id_col: str = "id", cells: int = CELLS, sample: int = SAMPLE, seed: int = 1) -> Index:
    """Write an index of all rows that have a vector with a length; vectors have equally many numbers, ids are distinct.

    The centres come from about ``sample`` rows; every row is then put into the cell of its nearest centre, whatever its number.
    """
    spark = rows.sparkSession
    unit = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), _unit(F.col(f"`{vector_col}`")).alias("unit")).filter("unit is not null")
    points = unit.withColumn("point", array_to_vector("unit"))
    n = unit.count()
    if n == 0:
        spark.createDataFrame([], T.StructType([unit.schema["id"], unit.schema["vector"], T.StructField("residual", T.DoubleType()), T.StructField("cell", T.IntegerType())])).write.parquet(f"{path}/vectors")
        spark.createDataFrame([], "cell int, centre array<double>, n bigint, least double, most double").write.parquet(f"{path}/cells")
        return Index(path)
    chosen = points if n <= sample else points.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)) + 1)
    model = KMeans(k=max(2, min(cells, n)), seed=seed, maxIter=12, featuresCol="point", predictionCol="cell").fit(chosen.select("point"))
    # as many centres as cells, so they are sent to all
    centres = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    away = F.sqrt(F.aggregate(F.zip_with("unit", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    placed = model.transform(points).join(F.broadcast(centres), "cell").select("id", "vector", away.alias("residual"), "cell")
    dealt = placed.repartition("cell", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SHARES))).sortWithinPartitions("cell", "residual")
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    ranges = Index(path).vectors(spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("residual").alias("least"), F.max("residual").alias("most"))
    centres.join(ranges, "cell").coalesce(1).write.parquet(f"{path}/cells")
    return Index(path)


def probed(spark: SparkSession, index: Index, queries: DataFrame, query_col: str = "query", vector_col: str = "vector") -> DataFrame:
    """query, asked, cell, away, place, low: each query with each cell, its distance to the centre, the cell's place by that distance, and
    the least distance that a vector there can have. The cells' centres travel with the tasks; they are as many as there are cells."""
    cells = index.cells(spark).orderBy("cell").collect()
    number, centre = np.array([c.cell for c in cells], np.int32), np.array([c.centre for c in cells])
    least, most = np.array([c.least for c in cells]), np.array([c.most for c in cells])
    given = queries.select(F.col(f"`{query_col}`").alias("query"), F.col(f"`{vector_col}`").alias("asked"), _unit(F.col(f"`{vector_col}`")).alias("unit")).filter("unit is not null")
    schema = T.StructType([*given.schema.fields[:2], T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("place", T.IntegerType()), T.StructField("low", T.DoubleType())])
    if not cells:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            away = np.sqrt(np.maximum(0.0, (unit**2).sum(1)[:, None] + (centre**2).sum(1)[None, :] - 2 * unit @ centre.T))
            place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
            low = np.maximum(0.0, np.maximum(away - most, least - away))
            row = pa.array(np.repeat(np.arange(batch.num_rows), len(number)))
            tiled = pa.array(np.tile(number, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), tiled, pa.array(away.ravel()), pa.array(place.ravel().astype(np.int32)), pa.array(low.ravel())], names=schema.names)

    return given.mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; each task passes on ``k`` of a query at most."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = True, query_col: str = "query", vector_col: str = "vector") -> DataFrame:
    """query, id, score, place: the ``k`` nearest vectors of every query by cosine, ties by the least id; queries are distinct.

    The ``probes`` cells of the nearest centres are read, and, if ``exact``, all vectors whose bound leaves room among the best. Without
    that the result may miss some. Queries without a vector or a length find nothing; vectors of another length than theirs aren't found.
    """
    asked = probed(spark, index, queries, query_col, vector_col)
    vectors = index.vectors(spark)
    scored = lambda df: df.withColumn("score", C.cosine(F.col("vector"), F.col("asked"))).filter("score is not null").select("query", "id", "score")
    first = _best(scored(asked.filter(F.col("place") < probes).join(vectors, "cell")), k)
    if not exact:
        return first.select("query", "id", "score", "place")
    # the k-th best score so far as a distance between vectors of length one; unbounded while there are fewer
    kth = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).alias("kth"))
    reach = F.coalesce("kth", F.lit(4.0)) + _SLACK
    rest = asked.filter(F.col("place") >= probes).join(kth, "query", "left").withColumn("reach", reach).filter(F.col("low") <= F.col("reach"))
    near = rest.join(vectors, "cell").filter(F.abs(F.col("residual") - F.col("away")) <= F.col("reach"))
    return _best(first.select("query", "id", "score").unionByName(scored(near)), k)
