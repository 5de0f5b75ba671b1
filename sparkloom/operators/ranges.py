"""Ranges of totally ordered rows, made once, so that all that reads them sees the same ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows in the folder of spark.checkpoint.dir; where it is unset one of our own, but only if all runs on one machine."""
    spark: SparkSession = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file:///tmp/checkpoints/sparkloom-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def ranged_sums(rows: DataFrame, order: list[str], value: str, frame_end: int) -> DataFrame:
    """`rows` with __sum: the sum of `value` over all rows up to the one `frame_end` rows ahead (0 or -1), in `order`.

    Sums are taken in ranges and then over the ranges' totals, as many as partitions. Which row is in which range depends on a
    sample that Spark may draw again for each reader, so the ranges are checkpointed before two plans read them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    inner = placed.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    totals = placed.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    base = totals.withColumn("__base", F.coalesce(before, F.lit(0))).select("__part", "__base")
    return inner.join(F.broadcast(base), "__part").withColumn("__sum", F.col("__within") + F.col("__base")).drop("__part", "__within", "__base")
