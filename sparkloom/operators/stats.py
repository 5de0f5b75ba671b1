"""Gate statistics: weighted means, entropy, percentiles, ranks, rank correlation, churn, staged acceptance.

Global ranks are computed from counts of distinct values, so no task holds all rows: a value's position is a running sum over
the distinct values' counts, taken first within ranges and then over the few range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranges import ranged_sums


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def entropy(rows: DataFrame, group: list[str], count: str) -> DataFrame:
    """Shannon entropy of each group's counts over ln(n); null where n < 2 or nothing is counted."""
    both = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(count).alias("total"), F.sum(F.when(F.col(count) > 0, F.col(count) * F.ln(count)).otherwise(F.lit(0.0))).alias("s"))
    h = F.ln("total") - F.col("s") / F.col("total")  # -sum p ln p with p = c / total
    return both.select(*group, "n", "total", F.when((F.col("n") > 1) & (F.col("total") > 0), h / F.ln("n")).alias("entropy"))


def value_positions(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, value, n, before): each distinct value, its rows and how many rows lie below it.

    Without a group the running sum runs over ranges: values are range-partitioned, summed in each range, and the
    totals of the ranges (as many as partitions) are summed on top.
    """
    group = group or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    if group:
        w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return ranged_sums(counts, [value], "n", -1).select(value, "n", F.col("__sum").alias("before"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with avg_rank (1-based, ties share the mean) and rank_norm = (avg_rank - 1) / (n - 1)."""
    at = value_positions(rows, value)
    total = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("__rows"))
    at = at.crossJoin(F.broadcast(total))  # one row
    at = at.select(value, (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"), "__rows")
    out = rows.join(at, value, "left")
    return out.withColumn("rank_norm", F.when(F.col("__rows") > 1, (F.col("avg_rank") - 1) / (F.col("__rows") - 1))).drop("__rows")


def spearman(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """(group, n, rho): rank correlation with average ranks; null where either side is constant."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for v, r in ((x, "rx"), (y, "ry")):
        at = value_positions(both, v, group).select(*group, v, (F.col("before") + (F.col("n") + 1) / 2.0).alias(r))
        both = both.join(at, [*group, v])
    found = both.groupBy(*group).agg(F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("c"))
    return found.select(*group, "n", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def lower_percentiles(rows: DataFrame, value: str, group: list[str], levels: dict[str, float]) -> DataFrame:
    """The value at index floor((n - 1) p) of each group's sorted values, for each named p."""
    at = value_positions(rows, value, group)
    sizes = at.groupBy(*group).agg(F.sum("n").alias("__n"))
    at = at.join(sizes, group)
    index = {name: F.floor((F.col("__n") - 1) * F.lit(p)) for name, p in levels.items()}
    return at.groupBy(*group).agg(*(F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value))).alias(name) for name, i in index.items()))


def load_distribution(counts: DataFrame, count: str, group: list[str] | None = None) -> DataFrame:
    """Extremes, median, p95 and p99 (linear), max over median (null if 0), coefficient of variation."""
    c = F.col(count)
    out = counts.groupBy(*(group or [])).agg(F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.95).alias("p95"), F.percentile(c, 0.99).alias("p99"), F.stddev_pop(c).alias("__s"), F.avg(c).alias("__m"))
    return out.withColumn("max_to_median", F.when(F.col("median") != 0, F.col("maximum") / F.col("median"))).withColumn("variation", F.when(F.col("__m") != 0, F.col("__s") / F.col("__m"))).drop("__s", "__m")


def zero_filled(counts: DataFrame, key: str, count: str, universe: DataFrame) -> DataFrame:
    """A row for each key of `universe`, 0 where `counts` has none."""
    return universe.select(key).distinct().join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def churn(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """floor(|symmetric difference| / 2) of two key sets, as one row."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    gone = a.join(b, key, "left_anti").agg(F.count("*").alias("gone"))
    new = b.join(a, key, "left_anti").agg(F.count("*").alias("new"))
    return gone.crossJoin(new).select("gone", "new", F.expr("(gone + new) div 2").alias("churn"))


def first_accepted(stages: DataFrame, order: str, gates: Column) -> DataFrame:
    """The smallest stage that meets all gates (a NaN meets none), as one row; null if none does."""
    return stages.agg(F.min(F.when(gates, F.col(order))).alias("accepted"), F.count("*").alias("stages"))


def at_least(value: str, gate: float) -> Column:
    """value >= gate, false for NaN and null (Spark itself takes NaN as the largest number)."""
    return F.coalesce(~F.isnan(value) & (F.col(value) >= F.lit(gate)), F.lit(False))
