"""Shard packing of ordered items and byte positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.corpus import running_total


def aligned(x: str | Column, to: int) -> Column:
    """The next multiple of `to`."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.floor((c + (to - 1)) / to) * to).cast("long")


def byte_cursor(rows: DataFrame, order: list[str], size: str, align: int = 1) -> DataFrame:
    """`rows` with start and end offsets of items laid end to end, each start aligned."""
    padded = rows.withColumn("__padded", aligned(size, align))
    return running_total(padded, order, "__padded", "__end").withColumn("start", F.col("__end") - F.col("__padded")).withColumn("end", F.col("start") + F.col(size)).drop("__end", "__padded")


def sizes_from_offsets(rows: DataFrame, group: list[str], offset: str, end: str) -> DataFrame:
    """`rows` with size: the distance to the next offset of the group, for the last to its `end`."""
    following = F.lead(offset).over(Window.partitionBy(*group).orderBy(offset))
    return rows.withColumn("size", F.coalesce(following, end) - F.col(offset))


def next_fit(rows: DataFrame, group: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """(group, order, size, shard): an item opens a new shard of its group when it would pass `limit`; a larger item is alone.

    Sequential within a group by definition; only keys and sizes of one group (a catalog's entries) meet in a task.
    """
    rows = rows.select(*group, *order, F.col(size).cast("long").alias(size))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def fold(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(order, kind="stable")
        fill, shard, out = 0, 0, []
        for s in items[size]:
            if fill and fill + s > limit:
                shard, fill = shard + 1, 0
            fill += s
            out.append(shard)
        return items.assign(shard=out)

    return rows.groupBy(*group).applyInPandas(fold, ", ".join(fields) + ", shard long")
