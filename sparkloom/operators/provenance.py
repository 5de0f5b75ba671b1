"""Catalog comparison: ownership, payload equality, digests, content-addressed row maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """`catalog` rows with state: 'owned' by the index, 'orphan' (no entry, or another shard), 'missing' from the files."""
    both = catalog.join(index.withColumnRenamed("shard", "__shard"), "name", "full")
    state = F.when(F.col("file").isNull(), "missing").when(F.col("__shard") == F.col("file"), "owned").otherwise("orphan")
    return both.withColumn("state", state).drop("__shard")


def catalog_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, difference) of tensors that differ in presence, dtype or shape."""
    a = left.select("name", F.col("dtype").alias("ld"), F.col("shape").alias("ls"), F.lit(1).alias("l"))
    b = right.select("name", F.col("dtype").alias("rd"), F.col("shape").alias("rs"), F.lit(1).alias("r"))
    both = a.join(b, "name", "full")
    kind = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("ld") != F.col("rd"), "dtype").when(F.col("ls") != F.col("rs"), "shape")
    return both.select("name", kind.alias("difference")).where("difference is not null")


def payload_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, offset) of payload pieces (name, offset, data) that are not byte-equal or lack a partner."""
    a = left.select("name", "offset", F.col("data").alias("x"))
    b = right.select("name", "offset", F.col("data").alias("y"))
    return a.join(b, ["name", "offset"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("name", "offset")


def tensor_digests(payload: DataFrame) -> DataFrame:
    """(name, size, sha256) of whole tensors from their pieces: one pass over the sorted pieces of each partition."""
    import hashlib

    parts = payload.repartition("name").sortWithinPartitions("name", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, digest = None, 0, None
        for batch in batches:
            out = []
            for name, data in zip(batch["name"], batch["data"], strict=True):
                if name != now:
                    if digest is not None:
                        out.append((now, size, digest.hexdigest()))
                    now, size, digest = name, 0, hashlib.sha256()
                size += len(data)
                digest.update(data)
            yield pd.DataFrame(out, columns=["name", "size", "sha256"])
        if digest is not None:
            yield pd.DataFrame([(now, size, digest.hexdigest())], columns=["name", "size", "sha256"])

    return parts.select("name", "offset", "data").mapInPandas(run, "name string, size bigint, sha256 string")


def merged_catalogs(base: DataFrame, supplement: DataFrame, key: str = "name") -> DataFrame:
    """Both catalogs' rows; `clash` marks keys that both have, which an add-only merge does not allow."""
    both = base.withColumn("origin", F.lit("base")).unionByName(supplement.withColumn("origin", F.lit("supplement")))
    twice = base.select(key).intersect(supplement.select(key)).withColumn("clash", F.lit(True))
    return both.join(twice, key, "left").withColumn("clash", F.coalesce("clash", F.lit(False)))


def remote_differences(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, problem) of local files (path, size, sha256, blob_sha1) against a listing (path, size, sha256, blob_sha1).

    A listed SHA-256 is compared where there is one, else the git blob digest.
    """
    a = local.select("path", F.col("size").alias("ls"), F.col("sha256").alias("lh"), F.col("blob_sha1").alias("lb"))
    b = remote.select("path", F.col("size").alias("rs"), F.col("sha256").alias("rh"), F.col("blob_sha1").alias("rb"))
    both = a.join(b, "path", "full")
    digest = F.when(F.col("rh").isNotNull(), F.col("rh") != F.col("lh")).otherwise(F.col("rb") != F.col("lb"))
    problem = F.when(F.col("ls").isNull(), "missing").when(F.col("rs").isNull(), "extra").when(F.col("ls") != F.col("rs"), "size").when(F.coalesce(digest, F.lit(True)), "digest")
    return both.select("path", problem.alias("problem")).where("problem is not null")
