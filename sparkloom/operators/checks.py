"""Contracts as check tables: one row for each check and key, folded to a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, name: str, key: str | Column, ok: Column, detail: Column | None = None) -> DataFrame:
    """(check, key, ok, detail): a null condition is a failure."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(name).alias("check"), k.cast("string").alias("key"), F.coalesce(ok, F.lit(False)).alias("ok"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def all_checks(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def summary(checks: DataFrame) -> DataFrame:
    """(check, rows, failures, status) for each check."""
    out = checks.groupBy("check").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("failures"))
    return out.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: whether all checks hold, and how many rows fail."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.count_if(~F.col("ok")).alias("failures"))


def failures(checks: DataFrame, limit: int) -> DataFrame:
    """The first failures in a stated order, for a report."""
    return checks.where(~F.col("ok")).orderBy("check", "key").limit(limit)
