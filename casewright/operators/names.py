"""Names that hold one another, found by an index of their rarest parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the parts by which names are indexed; shorter names have parts as long as themselves.
PART = 5


def _parts(name: str, size: str) -> str:
    return f"array_distinct(transform(sequence(1, length({name}) - {size} + 1), i -> substring({name}, i, {size})))"


def holding(inner: DataFrame, outer: DataFrame, inner_col: str, outer_col: str) -> DataFrame:
    """inner, outer: the distinct values of both columns, in lower case, where the second holds the first.

    Each inner name is looked for under the rarest of its parts among the outer ones. Null and empty names hold nothing and are held by none.
    Parts are many times the names that they come from, which sizes of files don't tell; so they are never broadcast.
    """
    needles = inner.select(F.lower(F.col(inner_col)).alias("inner")).filter("inner <> ''").distinct().withColumn("size", F.least(F.length("inner"), F.lit(PART)))
    sizes = [r["size"] for r in needles.select("size").distinct().collect()]  # PART at most
    names = outer.select(F.lower(F.col(outer_col)).alias("outer")).filter("outer <> ''").distinct()
    places = None
    for size in sorted(sizes):
        found = names.filter(F.length("outer") >= size).select("outer", F.explode(F.expr(_parts("outer", str(size)))).alias("part"))
        places = found if places is None else places.unionByName(found)
    if places is None:
        return needles.select("inner", F.col("inner").alias("outer"))
    held = places.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a part that no outer name has rules the inner one out
    looked = needles.select("inner", F.explode(F.expr(_parts("inner", "size"))).alias("part")).join(held.hint("merge"), "part", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("rarest"))
    return looked.filter("rarest.n > 0").select("inner", F.col("rarest.part").alias("part")).join(places.hint("merge"), "part").filter(F.contains("outer", "inner")).select("inner", "outer")


def either(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """a, b: pairs of distinct lower-case names of which one holds the other."""
    forth = holding(a, b, a_col, b_col).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    back = holding(b, a, b_col, a_col).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    return forth.unionByName(back).distinct()
