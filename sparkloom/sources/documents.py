"""Evidence documents, manifests, logs and checksum files as DataFrames, and the sinks that mirror them."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "schema string, declared_k int, source struct<repo:string,revision_sha:string,path:string,sha256:string,lineage:string,original_id_proof:string>, layers map<string, struct<kept_experts:array<int>, ranked_experts:array<int>>>"
#: How each upstream layout names its keep lists: (path to the map of layers, keep field, ranking field). Fixed values.
LAYOUTS = {
    "mask": ("layers", "kept_experts", "ranked_experts"),
    "keep_maps": ("keep_maps.keep_by_layer", None, None),
    "kept_expert_ids": ("", "kept_expert_ids", None),
    "keep": ("layers", "keep", None),
    "keep_map": ("keep_map", None, None),
}
PARTIAL = r"\.(part|tmp|incomplete|aria2)$"


def masks(spark: SparkSession, path: str) -> DataFrame:
    """Mask documents with one schema; a document that does not parse fails the read."""
    return spark.read.schema(MASK).option("multiLine", True).option("mode", "FAILFAST").json(path)


def mask_rows(documents: DataFrame) -> DataFrame:
    """(repo, declared_k, layer, pos, expert): a row for each kept id; layer keys are numbers, not strings."""
    layers = documents.select("source.repo", "declared_k", F.explode("layers").alias("layer", "item"))
    return layers.select("repo", "declared_k", F.col("layer").cast("int").alias("layer"), F.posexplode("item.kept_experts").alias("pos", "expert"))


def layout_rows(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(layer, pos, expert) of a document in one of the upstream LAYOUTS, in ascending order of ids."""
    at, keep, _ = LAYOUTS[layout]
    text = spark.read.text(path, wholetext=True)
    inner = "array<int>" if keep is None else f"struct<{keep}:array<int>>"
    body = F.get_json_object("value", "$." + at) if at else F.col("value")
    layers = text.select(F.explode(F.from_json(body, f"map<string,{inner}>")).alias("layer", "item"))
    ids = F.col("item") if keep is None else F.col(f"item.{keep}")
    return layers.where(F.col("layer").rlike("^[0-9]+$")).select(F.col("layer").cast("int").alias("layer"), F.posexplode(F.sort_array(ids)).alias("pos", "expert"))


def weight_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, shard) of a checkpoint index."""
    index = spark.read.schema("weight_map map<string,string>").option("multiLine", True).json(path)
    return index.select(F.explode("weight_map").alias("name", "shard"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, file) of a checksum file."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("sha256"), F.regexp_replace(parts[1], r"^\*", "").alias("file"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below `path`; hidden folders and partial downloads are left out. Files up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("path").rlike(PARTIAL) & ~F.col("path").rlike(r"/\.[^/]+/"))


def dry_run(spark: SparkSession, path: str) -> DataFrame:
    """(position, count, name, type, size_mib, target) of a quantizer's log lines."""
    pattern = r"^\[\s*(\d+)/\s*(\d+)\]\s+(\S+)\s+-\s+\[[^\]]*\],\s+type\s+=\s+(\S+),\s+size\s+=\s+([0-9.]+)(?:\s+\S+)?(?:\s+->\s+([0-9.]+)\s+\S+\s+\((\S+)\))?"
    part: Any = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(part(1).cast("int").alias("position"), part(2).cast("int").alias("count"), part(3).alias("name"), part(4).alias("type"), part(5).cast("double").alias("size_mib"), F.nullif(part(7), F.lit("")).alias("target"))


def canonical_json(value: Any, ascii_only: bool = True, newline: bool = False) -> bytes:
    """Sorted keys, compact separators: the bytes that fingerprints are taken of."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only) + "\n" * newline).encode()


def rules_text(rows: DataFrame, order: str, pattern: Column, target: Column, path: str) -> None:
    """One `pattern=target` line for each row, in order, as a single text file."""
    rows.select(order, F.concat(pattern, F.lit("="), target).alias("value")).orderBy(order).coalesce(1).select("value").write.mode("overwrite").text(path)


def append_trace(rows: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def fragments(rows: DataFrame, key: str, path: str) -> None:
    """A folder for each key; writing a key again replaces only its folder."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def report(path: str, document: dict[str, Any]) -> None:
    """A small report, written beside its place and renamed into it."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, sort_keys=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
