"""Writers and array functions."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.sources import containers, writers


def test_stable_read():
    reads = iter([b"a", b"b", b"b"])
    assert writers.stable_read(lambda: next(reads)) == (b"b", 1)
    n = iter(range(9))
    with pytest.raises(OSError):
        writers.stable_read(lambda: bytes([next(n)]))


def test_shards_read_back(spark, tmp_path):
    containers.register(spark)
    rows = [(f"t{i:02d}", "U8", [i], bytearray(range(i))) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, data binary")
    written = writers.write_safetensors(df, str(tmp_path / "c"), 40).cache()
    writers.write_index(written, str(tmp_path / "c"))
    shard = {r.name: r.shard for r in written.collect()}
    assert max(sum(len(d) for n, _, _, d in rows if shard[n] == s) for s in set(shard.values())) <= 40
    index = json.loads((tmp_path / "c" / "model.safetensors.index.json").read_text())
    assert index["weight_map"] == shard and index["metadata"]["total_size"] == sum(range(20))
    payload = spark.read.format("safetensors").option("table", "payload").load(str(tmp_path / "c"))
    assert {r.name: bytes(r.data) for r in payload.collect()} == {n: bytes(d) for n, _, _, d in rows if d}
    assert all(r.start % 1 == 0 and r.file == shard[r.name] for r in spark.read.format("safetensors").load(str(tmp_path / "c")).collect())


def test_ranges_are_replaced(spark):
    pieces = spark.createDataFrame([("a", 0, bytearray(b"01234")), ("a", 5, bytearray(b"56789")), ("b", 0, bytearray(b"xyz"))], "name string, offset bigint, data binary")
    patches = spark.createDataFrame([("a", 3, bytearray(b"ABCD")), ("a", 9, bytearray(b"E")), ("c", 0, bytearray(b"F"))], "name string, start bigint, bytes binary")
    got = {(r.name, r.offset): bytes(r.data) for r in writers.replaced_ranges(pieces, patches).collect()}
    assert got == {("a", 0): b"012AB", ("a", 5): b"CD78E", ("b", 0): b"xyz"}


def test_missing_fragments(spark, tmp_path):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "layer int")
    assert writers.missing_fragments(wanted, str(tmp_path / "none"), "layer").count() == 3
    wanted.where("layer = 2").withColumn("v", F.lit(0)).write.partitionBy("layer").parquet(str(tmp_path / "f"))
    assert {r.layer for r in writers.missing_fragments(wanted, str(tmp_path / "f"), "layer").collect()} == {1, 3}


def test_arrays(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5], [4, 0, 9])], "a array<int>, p array<int>").select(X.first_middle_last("a").alias("s"), X.tiled("a", 7).alias("t"), X.gathered("a", "p").alias("g"), X.tiled(F.slice("a", 1, 0), 3).alias("e")).first()
    assert tuple(row) == ([1, 3, 5], [1, 2, 3, 4, 5, 1, 2], [5, 1, None], [])
    stats = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (-1.0,), (float("-inf"),)], "v double").agg(*X.number_statistics("v")).first()
    assert tuple(stats) == (1, 1, 1, -1.0, 2.0)
