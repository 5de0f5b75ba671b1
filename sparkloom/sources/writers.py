"""Writing containers: sharded safetensors with an index, byte-range replacement into a new file, stable reads."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.shards import next_fit

HEADER_ALIGN = 4096


def stable_read(read: Callable[[], bytes], tries: int = 5) -> tuple[bytes, int]:
    """(bytes, unstable reads): reads again until two reads in a row agree."""
    last, unstable = read(), 0
    for _ in range(tries - 1):
        now = read()
        if now == last:
            return now, unstable
        last, unstable = now, unstable + 1
    raise OSError(f"no two of {tries} reads agree")


def safetensors_head(entries: list[tuple[str, str, list[int], int]]) -> bytes:
    """The header of a file with tensors (name, dtype, shape, bytes) end to end, padded with spaces to HEADER_ALIGN."""
    head: dict[str, Any] = {}
    at = 0
    for name, dtype, shape, size in entries:
        head[name] = {"dtype": dtype, "shape": [int(d) for d in shape], "data_offsets": [at, at + int(size)]}
        at += int(size)
    raw = json.dumps(head, separators=(",", ":")).encode()
    raw += b" " * (-(8 + len(raw)) % HEADER_ALIGN)
    return struct.pack("<Q", len(raw)) + raw


def write_safetensors(tensors: DataFrame, path: str, limit: int) -> DataFrame:
    """Writes tensors (name, dtype, shape, data) as shards of at most `limit` bytes of payload; returns (name, shard, size).

    Shards are packed next-fit by name from a catalog without payloads; each is written by one task, under a temporary
    name that is renamed, so a task that runs twice leaves one whole file. `path` is a folder that all tasks share.
    """
    os.makedirs(path, exist_ok=True)
    catalog = next_fit(tensors.select(F.lit(0).alias("all"), "name", F.octet_length("data").cast("long").alias("size")), ["all"], ["name"], "size", limit).drop("all")
    catalog = catalog.cache()
    total = (catalog.agg(F.max("shard")).first()[0] or 0) + 1
    placed = tensors.join(catalog, "name").select("shard", "name", "dtype", "shape", "data", "size")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        name = f"model-{int(rows['shard'].iloc[0]) + 1:05d}-of-{total:05d}.safetensors"
        part = os.path.join(path, f".{name}.{os.getpid()}.tmp")
        with open(part, "wb") as f:
            f.write(safetensors_head(list(zip(rows["name"], rows["dtype"], rows["shape"], rows["size"], strict=True))))
            for data in rows["data"]:
                f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, os.path.join(path, name))
        return pd.DataFrame({"name": rows["name"], "shard": name, "size": rows["size"]})

    return placed.groupBy("shard").applyInPandas(write, "name string, shard string, size bigint")


def write_index(written: DataFrame, path: str) -> None:
    """The weight_map of what write_safetensors() returned, beside the shards."""
    rows = written.orderBy("name").collect()  # names of one checkpoint
    document = {"metadata": {"total_size": sum(r["size"] for r in rows)}, "weight_map": {r["name"]: r["shard"] for r in rows}}
    part = os.path.join(path, "model.safetensors.index.json.tmp")
    with open(part, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, sort_keys=True)
    os.replace(part, part.removesuffix(".tmp"))


def replaced_ranges(payload: DataFrame, patches: DataFrame) -> DataFrame:
    """Payload pieces (name, offset, data) with patches (name, start, bytes) laid over them: a merge by offset.

    A patch may cross pieces; each piece takes its part. Patches of one tensor do not overlap.
    """
    pieces = payload.withColumn("__end", F.col("offset") + F.octet_length("data"))
    p = patches.select("name", F.col("start").alias("__start"), F.col("bytes").alias("__bytes"), (F.col("start") + F.octet_length("bytes")).alias("__stop"))
    hit = pieces.join(p, ["name"], "left").where(F.col("__start").isNull() | ((F.col("__start") < F.col("__end")) & (F.col("__stop") > F.col("offset"))))
    laid = hit.groupBy("name", "offset").agg(F.sort_array(F.collect_list(F.when(F.col("__start").isNotNull(), F.struct("__start", "__bytes")))).alias("__p"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for offset, data, found in zip(batch["offset"], batch["data"], batch["__p"], strict=True):
                data = bytearray(data)
                for one in found if found is not None else []:
                    for_piece = int(one["__start"]) - int(offset)
                    a, b = max(for_piece, 0), min(for_piece + len(one["__bytes"]), len(data))
                    data[a:b] = one["__bytes"][a - for_piece : b - for_piece]
                out.append(bytes(data))
            yield pd.DataFrame({"name": batch["name"], "offset": batch["offset"], "data": out})

    return payload.join(laid, ["name", "offset"], "left").select("name", "offset", "data", "__p").mapInPandas(lay, "name string, offset bigint, data binary")


def missing_fragments(wanted: DataFrame, path: str, key: str) -> DataFrame:
    """Keys of `wanted` without a fragment under `path`: what a resumed run still has to do."""
    if not os.path.isdir(path):
        return wanted.select(key)
    done = wanted.sparkSession.createDataFrame([(d.partition("=")[2],) for d in os.listdir(path) if d.startswith(f"{key}=")], "k string")
    return wanted.select(key).join(done, F.col(key).cast("string") == F.col("k"), "left_anti")
