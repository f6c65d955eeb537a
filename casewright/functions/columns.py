"""Column builders that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A column of rows that stand for several.
WEIGHT = "_rows"


def weight_of(rows: DataFrame) -> Column | None:
    """How many rows each row stands for, if the table says so."""
    return F.col(WEIGHT) if WEIGHT in rows.columns else None


def count_if(condition: Column, weight: Column | None = None) -> Column:
    """How many rows fulfil the condition; with ``weight``, rows stand for so many each."""
    if weight is None:
        return F.count(F.when(condition, F.lit(1)))
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")


def percent(condition: Column) -> Column:
    """Rows that meet the condition, in percent of all rows of the group, rounded half away from zero."""
    return F.round(F.lit(100.0) * count_if(condition) / F.count(F.lit(1)))


def half_up(value: Column) -> Column:
    """Rounded with halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def change_percent(now: Column, before: Column) -> Column:
    """Change in whole percent; 0 where there was nothing before."""
    return F.when(before > 0, half_up((now - before) / before * 100)).otherwise(F.lit(0)).cast("bigint")


def listed(values: Column, separator: str = ", ") -> Column:
    """The distinct values of a group in order, in one string; null if there is none."""
    found = F.array_sort(F.collect_set(values))
    return F.when(F.size(found) > 0, F.array_join(found, separator))


def age_band(age: Column, dash: str = "–") -> Column:
    """The first band takes all ages below its end, the last all others, null among them."""
    return F.when(age < 26, f"18{dash}25").when(age < 36, f"26{dash}35").when(age < 46, f"36{dash}45").otherwise("46+")


def gender(code: Column, other: str = "Other") -> Column:
    return F.when(code == 1, "Male").when(code == 2, "Female").otherwise(other)


def chargesheet_type(code: Column) -> Column:
    """Labels of the types; an unknown code stays as it is."""
    return F.when(code == "A", "Chargesheet Filed").when(code == "B", "False Case").when(code == "C", "Undetected").otherwise(code)


def shortened(text: Column, longest: int = 14) -> Column:
    """Texts over ``longest`` characters end in an ellipsis after one fewer."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("…"))).otherwise(text)


def first_words(text: Column, n: int = 2) -> Column:
    return F.substring_index(text, " ", n)


def iso_day(dates: Column) -> Column:
    return F.date_format(dates, "yyyy-MM-dd")


def padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def thousands(number: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(number, 0)


def split_list(text: Column, separator: str = ",") -> Column:
    """Parts of a separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def contains_any_case(column: Column, term: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the term stand for themselves."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; the order must end in a unique key to be the same each time."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def mode_per_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group, of equally common ones the least; one row for each group.

    Counted on both sides of one shuffle, then reduced, so a group with most of the rows is no burden."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias(value)))[value].alias(value))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def jaccard(a: Column, b: Column) -> Column:
    """Common members in proportion to all; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: Rows that a task is given where nearly all of them are held, so that more of them make more tasks, not larger ones.
SHARE = 250_000


def shares(rows: DataFrame) -> int:
    """Into how many parts ``rows`` are dealt where a task holds nearly all of its own: as many as run at once, at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SHARE))
