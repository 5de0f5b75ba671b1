"""Shared plumbing of the training-data operators: scratch storage, caller columns, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids in a list of documents to drop that may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 100_000
#: Whether Spark removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in an Arrow batch handed to Python, so that a batch of long texts stays small.
ARROW_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"file:///tmp/checkpoints/sparkloom-{uuid.uuid4().hex}"
        _remove_at_exit(spark, base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    With drop_shuffles the files of its shuffles go once the table is written, not when the driver's collector happens to find their plan unused.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    if drop_shuffles:
        conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Remove what written() wrote, once nothing will read it again, and let Spark's cleaner remove the shuffles of plans that are done.

    The cleaner drops a shuffle when the driver's collector finds its plan unused, which by default Spark brings about every 30 minutes only.
    """
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for whole-text operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` less the rows whose id is in the one column of `ids`; a null there drops null ids."""
    gone = written(ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).distinct(), "dropped-ids")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Alternates large-star and small-star contraction. Minima are partial aggregates, so a hub that holds most edges
    is combined before the shuffle; the joins that spread a minimum are sort-merge joins that AQE can split, since a broadcast in each
    round would add up in the driver.
    Each round is checkpointed; only two numbers reach the driver. Null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    pair = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    pair = pair.where("u is not null and v is not null and u <> v")
    pair = pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        # large star: each neighbour above u goes to the smallest of u and its neighbours
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        pair = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours go to the smallest of them
        low = pair.groupBy("u").agg(F.min("v").alias("m"))
        spread = pair.join(low.hint("merge"), "u")
        pair = spread.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pair = pair.where("u <> v").distinct().checkpoint()
        state = tuple(pair.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if state == seen:
            break
        seen = state
    roots = pair.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
