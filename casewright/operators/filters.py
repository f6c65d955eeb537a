"""Reading with conditions given as data: nested filters, ordering, paging, aggregates, groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _test(column: Column, name: str, value: Any, insensitive: bool) -> Column:
    folded = (lambda c: F.lower(c)) if insensitive else (lambda c: c)
    literal = lambda v: folded(F.lit(v)) if insensitive and isinstance(v, str) else F.lit(v)
    own = folded(column)
    match name:
        case "equals":
            return column.isNull() if value is None else own == literal(value)
        case "not":
            if isinstance(value, Mapping):
                return ~_column(column, value)
            return column.isNotNull() if value is None else own != literal(value)
        case "in":
            return reduce(lambda a, b: a | b, [own == literal(v) for v in value], F.lit(False))
        case "notIn":
            return reduce(lambda a, b: a & b, [own != literal(v) for v in value], F.lit(True))
        case "lt":
            return column < value
        case "lte":
            return column <= value
        case "gt":
            return column > value
        case "gte":
            return column >= value
        case "contains" | "string_contains":
            return own.contains(literal(value))
        case "startsWith" | "string_starts_with":
            return own.startswith(literal(value))
        case "endsWith" | "string_ends_with":
            return own.endswith(literal(value))
        case "array_contains":
            return F.array_contains(F.from_json(column, "array<string>"), str(value))
        case "array_starts_with":
            return F.get(F.from_json(column, "array<string>"), F.lit(0)) == str(value)
        case "array_ends_with":
            return F.element_at(F.from_json(column, "array<string>"), -1) == str(value)
        case _:
            raise ValueError(f"unknown test {name}")


def _column(column: Column, tests: Any) -> Column:
    if not isinstance(tests, Mapping):
        tests = {"equals": tests}
    tests = dict(tests)
    insensitive = tests.pop("mode", "default") == "insensitive"
    if (path := tests.pop("path", None)) is not None:
        column = F.get_json_object(column, "$" + "".join(f"[{p}]" if str(p).isdigit() else f".{p}" for p in path))
    return reduce(lambda a, b: a & b, [_test(column, k, v, insensitive) for k, v in tests.items()], F.lit(True))


def condition(where: Mapping[str, Any] | None) -> Column:
    """A column from nested conditions: {field: value or {test: value}}, with AND, OR and NOT of further ones."""
    parts = []
    for key, value in (where or {}).items():
        several = value if isinstance(value, Sequence) and not isinstance(value, str) else [value]
        if key == "AND":
            parts += [condition(v) for v in several]
        elif key == "OR":
            parts.append(reduce(lambda a, b: a | b, [condition(v) for v in several], F.lit(False)))
        elif key == "NOT":
            parts += [~condition(v) for v in several]
        else:
            parts.append(_column(F.col(key), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def related(parent: DataFrame, child: DataFrame, key: str, child_key: str, some: Mapping | None = None, every: Mapping | None = None, none: Mapping | None = None) -> DataFrame:
    """Parents with some child that meets a condition, with no child that fails one, or with none that meets one."""

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(child_key).alias("_child"))

    if some is not None:
        parent = parent.join(keys(child.filter(condition(some))), F.col(key) == F.col("_child"), "left_semi")
    if every is not None:
        parent = parent.join(keys(child.filter(~F.coalesce(condition(every), F.lit(False)))), F.col(key) == F.col("_child"), "left_anti")
    if none is not None:
        parent = parent.join(keys(child.filter(condition(none))), F.col(key) == F.col("_child"), "left_anti")
    return parent


def _order(order_by: Sequence[Mapping[str, Any]]) -> list[Column]:
    found = []
    for item in order_by:
        for name, how in item.items():
            sort, nulls = (how["sort"], how.get("nulls")) if isinstance(how, Mapping) else (how, None)
            nulls = nulls or ("last" if sort == "asc" else "first")
            found.append(getattr(F.col(name), f"{sort}_nulls_{nulls}")())
    return found


def find_many(df: DataFrame, where: Mapping | None = None, order_by: Sequence[Mapping] = (), take: int | None = None, skip: int = 0, distinct: Sequence[str] = (), select: Sequence[str] = (), omit: Sequence[str] = (), cursor: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows that meet ``where``; the first of each ``distinct``, from the cursor on (its row included), ordered, paged, projected.

    A cursor names one column of the order with a value: reading goes on at that value in the order's direction.
    """
    rows = df.filter(condition(where)) if where else df
    for name, value in (cursor or {}).items():
        down = any(name in item and (item[name]["sort"] if isinstance(item[name], Mapping) else item[name]) == "desc" for item in order_by)
        rows = rows.filter(F.col(name) <= value if down else F.col(name) >= value)
    order = _order(order_by)
    if distinct:
        first = F.struct(*rows.columns)
        if order:
            from casewright.functions.columns import top_per_group

            rows = top_per_group(rows, list(distinct), order)
        else:
            rows = rows.groupBy(*[F.col(c).alias(f"_d_{c}") for c in distinct]).agg(F.min(first).alias("_r")).select("_r.*")
    if order:
        rows = rows.orderBy(*order)
    if skip:
        rows = rows.offset(skip)
    if take is not None:
        rows = rows.limit(take)
    return rows.select(*select) if select else rows.drop(*omit)


def find_first(df: DataFrame, where: Mapping | None = None, order_by: Sequence[Mapping] = ()) -> DataFrame:
    return find_many(df, where, order_by, take=1)


def find_unique(df: DataFrame, where: Mapping, or_throw: bool = False) -> DataFrame:
    found = find_many(df, where, take=1)
    if or_throw and found.isEmpty():
        raise LookupError("no such row")
    return found


_FUNCTIONS = {"_count": F.count, "_avg": F.avg, "_sum": F.sum, "_min": F.min, "_max": F.max}


def _aggregates(wanted: Mapping[str, Sequence[str] | bool]) -> list[Column]:
    found = []
    for kind, fields in wanted.items():
        if fields is True:
            found.append(F.count(F.lit(1)).alias("_count"))
            continue
        found += [(F.count(F.lit(1)) if f == "_all" else _FUNCTIONS[kind](f)).alias(f"{kind}_{f}") for f in fields]
    return found


def aggregate(df: DataFrame, where: Mapping | None = None, **wanted: Sequence[str] | bool) -> DataFrame:
    """One row of _count, _avg, _sum, _min, _max of the named fields, in columns such as ``_avg_age``; ``_count=True`` counts rows."""
    return df.filter(condition(where)).agg(*_aggregates(wanted))


def group_by(df: DataFrame, by: Sequence[str], where: Mapping | None = None, having: Mapping | None = None, order_by: Sequence[Mapping] = (), take: int | None = None, skip: int = 0, **wanted: Sequence[str] | bool) -> DataFrame:
    """As ``aggregate``, by group; ``having`` and ``order_by`` name keys or the aggregates' columns."""
    found = df.filter(condition(where)).groupBy(*by).agg(*_aggregates(wanted))
    return find_many(found, having, order_by, take, skip)


def count(df: DataFrame, where: Mapping | None = None) -> DataFrame:
    return df.filter(condition(where)).agg(F.count(F.lit(1)).alias("count"))


def with_count(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with how many children each has."""
    counted = child.groupBy(F.col(child_key).alias("_child")).agg(F.count(F.lit(1)).alias(name))
    return parent.join(counted, F.col(key) == F.col("_child"), "left").drop("_child").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
