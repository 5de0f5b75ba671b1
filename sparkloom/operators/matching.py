"""Matching of two catalogs by value, with the evidence for each match, and comparisons of what both sides hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_scalar_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, match): the right key with the same scalar; a value that either side holds more than once matches nothing.

    left, right: key, value. Values that nothing matches give no row.
    """
    alone = lambda rows, name: rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return alone(left, key).join(alone(right, "match"), value).select(key, "match")


def with_fallback(keys: DataFrame, key: str, strategies: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, match, evidence) for each row of `keys`: the first strategy that has a match and its name, nulls if none has."""
    out = keys.select(key).distinct()
    for i, (_, found) in enumerate(strategies):
        out = out.join(found.select(key, F.col("match").alias(f"__match{i}")), key, "left")
    named = [F.when(F.col(f"__match{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(strategies)]
    return out.select(key, F.coalesce(*(F.col(f"__match{i}") for i in range(len(strategies)))).alias("match"), F.coalesce(*named).alias("evidence"))


def grid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every pair of two short lists: what a complete catalog must hold."""
    return first.distinct().crossJoin(F.broadcast(second.distinct()))


def against_grid(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status ('ok', 'missing', 'unexpected', 'repeated') of all cells of either side."""
    a = expected.select(*keys).distinct().withColumn("__want", F.lit(True))
    b = found.groupBy(*keys).agg(F.count("*").alias("__n"))
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__want").isNull(), "unexpected").when(F.col("__n") > 1, "repeated").otherwise("ok")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def zipped(first: str | Column, second: str | Column) -> Column:
    """array<struct<position, a, b>> of two arrays by position; the shorter one gives nulls."""
    return F.transform(F.arrays_zip(F.col(first).alias("a") if isinstance(first, str) else first.alias("a"), F.col(second).alias("b") if isinstance(second, str) else second.alias("b")), lambda x, i: F.struct(i.cast("long").alias("position"), x["a"].alias("a"), x["b"].alias("b")))


def one_sided(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): 'left only' or 'right only' where one side alone holds a value, 'differs' where both do and differ.

    A value that is absent on both sides, as a null or as no row, is no problem.
    """
    a, b = left.select(key, F.col(value).alias("__a")), right.select(key, F.col(value).alias("__b"))
    both = a.join(b, key, "full")
    x, y = F.col("__a"), F.col("__b")
    problem = F.when(x.isNull() & y.isNotNull(), "right only").when(x.isNotNull() & y.isNull(), "left only").when(x != y, "differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def first_satisfying(rows: DataFrame, group: list[str], order: list[str], holds: Column) -> DataFrame:
    """group and the fields of the first row, in `order`, for which the predicate holds; groups without one are left out."""
    rest = [c for c in rows.columns if c not in group]
    ordered = [*order, *(c for c in rest if c not in order)]
    return rows.where(holds).groupBy(*group).agg(F.min(F.struct(*ordered)).alias("__first")).select(*group, "__first.*")


def complement(rows: DataFrame, *predicates: Column) -> DataFrame:
    """The rows for which no predicate holds; an unknown predicate does not hold."""
    return rows.where(~reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(False)) for p in predicates)))


def beyond(a: str, b: str, tolerance: float) -> Column:
    """Whether two numbers differ by more than the tolerance; NaN and null differ from everything but their like."""
    x, y = F.col(a), F.col(b)
    return F.when(x.eqNullSafe(y), False).otherwise(F.coalesce(F.isnan(x) | F.isnan(y) | (F.abs(x - y) > F.lit(tolerance)), F.lit(True)))


def unraveled(index: str | Column, rows: int, columns: int) -> list[Column]:
    """(member, row, column) of a flat index into members of rows x columns."""
    i = (F.col(index) if isinstance(index, str) else index).cast("long")
    at = lambda n, size: (F.floor(i / n) % size).cast("long")
    return [F.floor(i / (rows * columns)).cast("long").alias("member"), at(columns, rows).alias("row"), (i % columns).cast("long").alias("column")]


def chunks_along_rows(shape_rows: int, parts: int) -> list[tuple[int, int]]:
    """(first row, rows) of equal pieces of a tensor along its first axis; it must divide."""
    if parts < 1 or shape_rows % parts:
        raise ValueError(f"{shape_rows} rows do not divide into {parts} parts")
    size = shape_rows // parts
    return [(p * size, size) for p in range(parts)]


def consecutive(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, order and value of each row with those of the next one of its group as next_*; the last row of a group has none and is left out."""
    place = Window.partitionBy(*group).orderBy(*order)
    after = F.lead(F.struct(*order, value)).over(place)
    paired = rows.select(*group, *order, value, after.alias("__next")).where("__next is not null")
    return paired.select(*group, *order, value, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in (*order, value)))
