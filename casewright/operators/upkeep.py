"""Changes to stored tables, as new tables: inserts, updates, deletes with their dependents, backfill selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import columns as C


def missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose keys ``target`` doesn't hold. A null key matches a null key."""
    marked = source.alias("s").join(target.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct(), [F.col(f"s.{k}").eqNullSafe(F.col(f"_t_{k}")) for k in keys], "left_anti")
    return marked


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those rows that don't conflict with it in ``keys``; of rows that agree in keys, one is inserted."""
    return target.unionByName(missing(target, rows.dropDuplicates(keys), keys).select(*target.columns))


def update_from(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the other columns of ``changes`` (one row for each key) where a key matches, nulls included."""
    columns = [c for c in changes.columns if c not in keys]
    new = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(new, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return insert_new(update_from(target, rows, keys), rows, keys)


def delete_with_dependents(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of ``gone`` (a table of the parent's key) and what hangs on them."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return parent.join(ids, F.col(key) == F.col("_gone"), "left_anti"), child.join(ids, F.col(child_key) == F.col("_gone"), "left_anti")


def with_ids(rows: DataFrame, id_col: str, order: list[str], start: int = 1, ranges: int = 64) -> DataFrame:
    """Dense ids in the order of ``order``, which must be the same each time (end in a key).

    Rows are numbered within ranges of the order, whose bounds come from a sample; a range's first number is the sum of the counts
    before it. So no task sees all rows, and the bounds change how even the ranges are, not the numbers.
    """
    total = rows.count()
    key = F.struct(*order)
    sampled = rows.select(*order).sample(min(1.0, 100.0 * ranges / max(total, 1)), seed=7).orderBy(*order).collect()
    bounds = [sampled[k * len(sampled) // ranges] for k in range(1, ranges)] if len(sampled) >= 2 * ranges else []
    of = F.lit(0)
    for bound in bounds:
        of = of + (key >= F.struct(*[F.lit(v).alias(c) for c, v in zip(order, bound, strict=True)])).cast("int")
    placed = rows.withColumn("_range", F.coalesce(of, F.lit(0)))
    counts = {r._range: r["count"] for r in placed.groupBy("_range").count().collect()}
    first, firsts = start, []
    for k in sorted(counts):
        firsts += [F.lit(k), F.lit(first).cast("bigint")]
        first += counts[k]
    base = F.element_at(F.create_map(*firsts), F.col("_range")) if firsts else F.lit(start).cast("bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn(id_col, base + place - 1).drop("_range")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side, the first with the first and so on, with their place from 0; as many as the shorter has."""
    return with_ids(left, "place", left_order, 0).join(with_ids(right, "place", right_order, 0), "place")


def merged_by_id(rows: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """Rows with what came back for their ids; rows without a result and results without a row are dropped. Of results that repeat
    an id, the least counts."""
    columns = [c for c in results.columns if c != id_col]
    one = results.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*columns)).alias("_r"))
    kept = [c for c in rows.columns if c not in columns]
    return rows.join(one, F.col(id_col) == F.col("_id")).select(*kept, *[F.col(f"_r.{c}").alias(c) for c in columns])


def truncated(tables: Mapping[str, DataFrame], names: list[str], references: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """The tables with the named ones empty, and all that refer to them, directly or through others (``references``: a table's name
    to those it refers to)."""
    gone = set(names)
    while more := {child for child, parents in references.items() if gone & set(parents)} - gone:
        gone |= more
    return {name: df.limit(0) if name in gone else df for name, df in tables.items()}


def to_backfill(rows: DataFrame, id_col: str, text_col: str, done_col: str, limit: int | None = None) -> DataFrame:
    """Rows with a text that lack ``done_col``, by id; the next batch of ``limit``."""
    waiting = rows.filter(F.col(done_col).isNull() & F.col(text_col).isNotNull()).orderBy(id_col)
    return waiting.limit(limit) if limit else waiting


def first_child(parent: DataFrame, child: DataFrame, key: str, child_key: str, order: str, columns: list[str]) -> DataFrame:
    """Each parent with the named columns of its first child row by ``order`` (then by the columns), null where it has none."""
    least = child.groupBy(F.col(child_key).alias("_key")).agg(F.min(F.struct(F.col(order).alias("_order"), *columns)).alias("_first"))
    return parent.join(least, F.col(key) == F.col("_key"), "left").select(*[parent[c] for c in parent.columns], *[F.col(f"_first.{c}").alias(c) for c in columns])


def with_children(parent: DataFrame, child: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Each parent with its child rows as an array sorted by ``order``, empty where it has none."""
    kids = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    joined = parent.join(kids, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))


def history(turns: DataFrame, last: int, conversation: str, order: list[str]) -> DataFrame:
    """The last turns of each conversation, which is what a planner is shown."""
    return C.top_per_group(turns, [conversation], [F.desc(c) for c in order], last)


BUCKET = "_bucket"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def stored(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write a table in folders by a hash of its keys, for ``update_stored``."""
    _bucketed(rows, keys, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def update_stored(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], buckets: int = 64) -> None:
    """``update_from`` on a table that ``stored`` wrote, in place: only the folders that a change falls in are read and written.

    ``buckets`` as it was stored with. The new files take the old ones' place when all of them are written; a job that fails
    before that leaves the table as it was.
    """
    marked = _bucketed(changes, keys, buckets)
    touched = [r[BUCKET] for r in marked.select(BUCKET).distinct().collect()]  # as many as there are folders, at most
    if not touched:
        return
    whole = spark.read.parquet(path)
    old = whole.filter(F.col(BUCKET).isin(touched))
    updated = update_from(old, changes, keys).select(*whole.columns)
    updated.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
