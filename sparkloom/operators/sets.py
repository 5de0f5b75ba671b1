"""Set operators on member tables: overlap, nesting, reconciliation, contracts, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(members: DataFrame, group: str, source: str, member: str) -> DataFrame:
    """For each group and pair of sources: sizes, intersection, union, Jaccard (8 places), whether the first is a subset.

    Members meet in an equi-join on (group, member); pairs of sources without a common member are not listed.
    """
    rows = members.select(group, source, member).distinct()
    size = rows.groupBy(group, source).agg(F.count("*").alias("n"))
    a = rows.select(group, member, F.col(source).alias("a"))
    b = rows.select(group, member, F.col(source).alias("b"))
    both = a.join(b, [group, member]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("common"))
    both = both.join(size.select(group, F.col(source).alias("a"), F.col("n").alias("n_a")), [group, "a"]).join(size.select(group, F.col(source).alias("b"), F.col("n").alias("n_b")), [group, "b"])
    both = both.withColumn("combined", F.col("n_a") + F.col("n_b") - F.col("common"))
    return both.withColumn("jaccard", F.round(F.col("common") / F.col("combined"), 8)).withColumn("a_in_b", F.col("common") == F.col("n_a"))


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `required` without a partner."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state) of keys that only one side has: 'missing' from the right, or 'extra' there."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full")
    return both.where("__l is null or __r is null").select(key, F.when(F.col("__r").isNull(), "missing").otherwise("extra").alias("state"))


def contiguity(rows: DataFrame, group: list[str], number: str, start: int = 0) -> DataFrame:
    """For each group whether its numbers are start..start+n-1, each once."""
    found = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min(number).cast("long").alias("least"), F.max(number).cast("long").alias("most"), F.countDistinct(number).alias("distinct_numbers"))
    return found.withColumn("contiguous", (F.col("least") == start) & (F.col("most") == F.col("n") - 1 + start) & (F.col("distinct_numbers") == F.col("n")))


def dense_ids(rows: DataFrame, group: list[str], old: str, new: str = "new_id") -> DataFrame:
    """Old ids in ascending order as 0, 1, 2, ... within each group."""
    return rows.withColumn(new, F.row_number().over(Window.partitionBy(*group).orderBy(old)) - 1)


def unique_content_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, content: str) -> DataFrame:
    """Pairs of rows with equal content, joined on its digest and verified, where the match is unique on the right."""
    a = left.select(F.col(left_id).alias("left_id"), F.col(content).alias("x"), F.sha2(F.col(content), 256).alias("digest"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(content).alias("y"), F.sha2(F.col(content), 256).alias("digest"))
    once = b.groupBy("digest").agg(F.count("*").alias("copies"), F.min("right_id").alias("right_id"), F.min("y").alias("y")).where("copies = 1")
    return a.join(once, "digest").where("x = y").select("left_id", "right_id", "digest")
