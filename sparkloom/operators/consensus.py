"""Evidence consensus: tri-state votes, ranks with a total tie-break, top-K for each group, boundaries and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def membership(universe: DataFrame, members: DataFrame, keys: list[str], name: str, covered: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """`universe` with a nullable flag: true if `members` has the key, false if not, null where the group is not covered.

    Missing coverage is not a negative vote, so it stays null. Without `covered` every group is.
    """
    marked = universe.join(members.select(*keys).distinct().withColumn("__in", F.lit(True)), keys, "left")
    if covered is None:
        return marked.withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")
    marked = marked.join(covered.select(*group).distinct().withColumn("__covered", F.lit(True)), group, "left")
    return marked.withColumn(name, F.when(F.col("__covered"), F.coalesce("__in", F.lit(False)))).drop("__in", "__covered")


def vote(flag: str | Column) -> Column:
    """1 for true, 0 for false and for null."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)).cast("int")


def tiered_score(strong: str, weak: str, votes: list[str]) -> Column:
    """2 for the strong tier, 1 for the weak one, and one for each vote."""
    score = F.when(vote(strong) == 1, 2).when(vote(weak) == 1, 1).otherwise(0)
    for v in votes:
        score = score + vote(v)
    return score


def ranked(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """All rows with `rank` (1-based, by a total order) and `selected` (rank <= k)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("selected", F.col("rank") <= k)


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Only the first k of each group: Spark limits every task's groups before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def boundary(rows: DataFrame, group: list[str], k: int, value: str = "score") -> DataFrame:
    """For each group the value at ranks k and k + 1 and whether a tie crosses; null where a group has no more than k."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(value)))
    found = rows.where(F.col("rank").isin(k, k + 1)).groupBy(*group).agg(at(k).alias("last_selected"), at(k + 1).alias("first_deleted"))
    return found.withColumn("tie_crosses", F.col("last_selected") == F.col("first_deleted"))


def score_histogram(rows: DataFrame, value: str = "score") -> DataFrame:
    """Counts of rows for each (selected, value)."""
    return rows.groupBy("selected", value).agg(F.count("*").alias("n"))
