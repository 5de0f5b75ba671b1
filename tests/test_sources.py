"""Containers and documents that the tests write themselves."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import codecs
from sparkloom.operators import provenance
from sparkloom.sources import containers, documents
from sparkloom.streaming.checks import run_available


def write_safetensors(path, tensors):
    header, at, payload = {"__metadata__": {"k": "v"}}, 0, b""
    for name, (dtype, shape, raw) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        payload += raw
    h = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(h)) + h + payload)


def write_gguf(path, values, tensors):
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(values))
    for key, kind, raw in values:
        out += text(key) + struct.pack("<I", kind) + raw
    at, payload = 0, b""
    for name, dims, kind, raw in tensors:
        out += text(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", kind, at)
        payload += raw + b"\0" * (-len(raw) % 32)
        at = len(payload)
    path.write_bytes(out + b"\0" * (-len(out) % 32) + payload)


@pytest.fixture
def tensors():
    draw = np.random.default_rng(7)
    return {"a.weight": ("U8", [3, 32], draw.integers(0, 256, 96, dtype=np.uint8).tobytes()), "b.scale": ("F32", [5], draw.random(5, dtype=np.float32).tobytes()), "empty": ("F32", [0], b"")}


def test_safetensors_catalog_and_payload(spark, tmp_path, tensors):
    containers.register(spark)
    write_safetensors(tmp_path / "x.safetensors", tensors)
    rows = {r.name: r for r in spark.read.format("safetensors").load(str(tmp_path)).collect()}
    assert {n: (r.dtype, list(r.shape), r.end - r.start) for n, r in rows.items()} == {n: (d, s, len(b)) for n, (d, s, b) in tensors.items()}
    payload = spark.read.format("safetensors").option("table", "payload").option("chunk", "50").load(str(tmp_path))
    got = {r.name: (r.size, r.sha256) for r in provenance.tensor_digests(payload).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, (_, _, b) in tensors.items() if b}
    changed = dict(tensors)
    changed["b.scale"] = ("F32", [5], b"\0" * 20)
    (tmp_path / "o").mkdir()
    write_safetensors(tmp_path / "o" / "x.safetensors", changed)
    other = spark.read.format("safetensors").option("table", "payload").option("chunk", "50").load(str(tmp_path / "o"))
    assert {r.name for r in provenance.payload_differences(payload, other).collect()} == {"b.scale"}


@pytest.mark.parametrize("break_it", ["length", "offsets"])
def test_broken_safetensors_fail(spark, tmp_path, tensors, break_it):
    containers.register(spark)
    write_safetensors(tmp_path / "x.safetensors", tensors)
    raw = (tmp_path / "x.safetensors").read_bytes()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", 1 << 40) + raw[8:] if break_it == "length" else raw[:-30])
    with pytest.raises(Exception, match="header of|do not fit"):
        spark.read.format("safetensors").load(str(tmp_path)).collect()


def test_gguf(spark, tmp_path):
    containers.register(spark)
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    values = [("general.name", 8, text("n")), ("general.alignment", 4, struct.pack("<I", 32)), ("xs", 9, struct.pack("<IQ", 5, 3) + struct.pack("<iii", -1, 0, 7)), ("f", 12, struct.pack("<d", 0.5)), ("b", 7, b"\1")]
    block = bytes([130]) + bytes(16)
    write_gguf(tmp_path / "m.gguf", values, [("t1", [32, 2], 39, block * 2), ("t2", [4], 0, b"\0" * 16)])
    got = {r.key: json.loads(r.value) for r in spark.read.format("gguf").option("table", "values").load(str(tmp_path)).collect()}
    assert got == {"general.name": "n", "general.alignment": 32, "xs": [-1, 0, 7], "f": 0.5, "b": True}
    rows = {r.name: r for r in spark.read.format("gguf").load(str(tmp_path)).collect()}
    assert rows["t1"].end - rows["t1"].start == 64 and rows["t1"].dtype == "39" and list(rows["t2"].shape) == [4]
    payload = spark.read.format("gguf").option("table", "payload").load(str(tmp_path)).where("name = 't1'")
    one = payload.select(codecs.mxfp4_exponents("data").alias("e")).first().e
    assert (one.blocks, one.high, one.most) == (3, 2, 130)  # the padding counts as a block of its own


def test_codecs(spark):
    table = codecs.e4m3_table()
    assert table[0x38] == 1.0 and table[0xB8] == -1.0 and table[1] == 2.0**-9 and table[0x7F] == table[0x7E] == 448.0
    assert codecs.bf16_to_f32(np.array([0x3F80, 0xC000], dtype="<u2").tobytes()).tolist() == [1.0, -2.0]
    x = np.linspace(-3, 3, 64, dtype=np.float32)
    raw = np.frombuffer(codecs.q8_0(x), dtype=np.uint8).reshape(-1, 34)
    back = raw[:, :2].copy().view("<f2").astype(np.float32) * raw[:, 2:].view(np.int8)
    assert np.abs(back.ravel() - x).max() < 0.02
    draw = np.random.default_rng(7)
    weights, scales = draw.integers(0, 256, (3, 32), dtype=np.uint8), draw.integers(0, 256, (3, 2), dtype=np.uint8)
    out = np.frombuffer(codecs.mxfp4_repacked(weights, scales), dtype=np.uint8).reshape(3, 2, 17)
    for row in range(3):
        for block in range(2):
            values = [v for b in weights[row, block * 16 : block * 16 + 16] for v in (b & 15, b >> 4)]
            assert out[row, block, 0] == scales[row, block] and out[row, block, 1:].tolist() == [values[i] | values[i + 16] << 4 for i in range(16)]
    blob = spark.createDataFrame([(bytearray(b"abc" * 100),), (None,)], "raw binary").select("raw", codecs.compressed_blob("raw").alias("z")).select("raw", "z", codecs.blob_bytes("z.data").alias("back")).collect()
    assert blob[0].back == blob[0].raw and blob[0].z.sha256 == hashlib.sha256(b"abc" * 100).hexdigest() and blob[1].back is None


def test_documents(spark, tmp_path):
    mask = {"schema": "m", "declared_k": 2, "source": {"repo": "r"}, "layers": {"10": {"kept_experts": [1, 5]}, "2": {"kept_experts": [0, 3]}}}
    (tmp_path / "m.json").write_text(json.dumps(mask))
    rows = documents.mask_rows(documents.masks(spark, str(tmp_path / "m.json"))).orderBy("layer", "pos").collect()
    assert [(r.layer, r.pos, r.expert) for r in rows] == [(2, 0, 0), (2, 1, 3), (10, 0, 1), (10, 1, 5)]
    layouts = {"keep_maps": {"keep_maps": {"keep_by_layer": {"3": [9, 1]}}}, "kept_expert_ids": {"3": {"kept_expert_ids": [9, 1]}}, "keep": {"layers": {"3": {"keep": [9, 1]}}}, "keep_map": {"keep_map": {"3": [9, 1]}}, "mask": {"layers": {"3": {"kept_experts": [9, 1]}}}}
    for name, doc in layouts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert [(r.layer, r.pos, r.expert) for r in documents.layout_rows(spark, str(tmp_path / f"{name}.json"), name).orderBy("pos").collect()] == [(3, 0, 1), (3, 1, 9)]
    (tmp_path / "SUMS").write_text("ab  one file\ncd *two\n\n")
    assert [tuple(r) for r in documents.checksums(spark, str(tmp_path / "SUMS")).collect()] == [("ab", "one file"), ("cd", "two")]
    (tmp_path / "log").write_text("build: 1\n[   2/  12]  blk.0.w - [ 4, 2], type =   f32, size =    1.50 MiB -> 0.50 MiB (q2_K)\n[   3/  12]  out - [ 4], type =   f16, size =    0.25 MiB\n")
    assert [(r.position, r["count"], r.name, r.type, r.size_mib, r.target) for r in documents.dry_run(spark, str(tmp_path / "log")).collect()] == [(2, 12, "blk.0.w", "f32", 1.5, "q2_K"), (3, 12, "out", "f16", 0.25, None)]
    assert documents.canonical_json({"b": 1e-05, "a": "é"}) == b'{"a":"\\u00e9","b":1e-05}' and documents.canonical_json("é", False, True) == '"é"\n'.encode()
    (tmp_path / "d" / ".cache").mkdir(parents=True)
    for name in ("d/x", "d/y.part", "d/.cache/z"):
        (tmp_path / name).write_bytes(b"12")
    assert [(r.path.rsplit("/", 1)[1], r.size) for r in documents.manifest(spark, str(tmp_path / "d")).collect()] == [("x", 2)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "layer int, v string")
    documents.fragments(df, "layer", str(tmp_path / "f"))
    documents.fragments(spark.createDataFrame([(2, "c")], "layer int, v string"), "layer", str(tmp_path / "f"))
    assert {(r.layer, r.v) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {(1, "a"), (2, "c")}
    documents.rules_text(df, "layer", F.col("v"), F.lit("q8"), str(tmp_path / "rules"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rules")).collect()] == ["a=q8", "b=q8"]


def test_available_files_are_checked_once(spark, tmp_path):
    check = lambda rows: rows.selectExpr("'positive' as check", "cast(k as string) as key", "k > 0 as ok")
    for k in (1, -1):
        spark.createDataFrame([(k,)], "k int").write.mode("append").parquet(str(tmp_path / "in"))
        run_available(spark, str(tmp_path / "in"), "k int", check, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.key, r.ok) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("-1", False), ("1", True)]
