"""Running sums beyond one range, with columns that one reader needs and another does not."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import codecs
from sparkloom.operators.corpus import interleaved, running_total
from sparkloom.operators.shards import byte_cursor
from sparkloom.operators.stats import average_ranks

ROOT = Path(__file__).resolve().parent.parent


def test_running_total_of_a_million_rows_with_more_columns(spark):
    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("at"), F.lit(1).cast("long").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = running_total(rows, ["at"], "v", "total").agg(F.max("total"), F.count_distinct("total"), F.count("*"), F.count_distinct("more")).first()
    assert tuple(got) == (1_000_000,) * 4


def test_cursors_and_ranks_meet_no_gap(spark):
    rows = spark.range(200_000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    laid = byte_cursor(rows, ["name"], "size", 8)
    gaps = laid.select("start", "end", F.expr("(size + 7) div 8 * 8").alias("padded")).agg(F.sum("padded"), F.max(F.col("start") + F.col("padded")), F.count_distinct(F.when(F.col("padded") > 0, F.col("start")))).first()
    assert gaps[0] == gaps[1] and gaps[2] == laid.where("size > 0").count()
    ranks = average_ranks(rows.select("size", "name"), "size").agg(F.sum("avg_rank")).first()[0]
    assert ranks == 200_000 * 200_001 / 2


def test_interleaving_keeps_all_rows_up_to_the_target(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("c"), "id", F.lit(1).cast("long").alias("tokens"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    got = interleaved(rows, "c", ["id"], "tokens", {"0": 1.0, "1": 1.0, "2": 1.0}, 60_000)
    assert got.agg(F.count("*"), F.max("total")).first()[:] == (60_000, 60_000)


def test_q8_rounds_halves_exactly():
    x = np.zeros(32, dtype=np.float32)
    near = [np.nextafter(np.float32(h), np.float32(d)) for h in (0.5, 1.5, 2.5) for d in (0, 9)] + [0.5, 1.5, 2.5, -0.5, -1.5]
    x[: len(near)], x[31] = near, 127
    q = np.frombuffer(codecs.q8_0(x), dtype=np.int8)[2:]
    assert q[: len(near)].tolist() == [0, 1, 1, 2, 2, 3, 1, 2, 3, -1, -2]


def test_mxfp4_blocks_by_value():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 16, size=(2, 64), dtype=np.uint8)
    scales = draw.integers(0, 256, size=(2, 2), dtype=np.uint8)
    got = np.frombuffer(codecs.mxfp4_repacked(values[:, 0::2] | values[:, 1::2] << 4, scales), dtype=np.uint8).reshape(2, 2, 17)
    for r in range(2):
        for b in range(2):
            v = values[r, 32 * b : 32 * b + 32]
            assert got[r, b].tolist() == [scales[r, b], *(int(v[i]) | int(v[i + 16]) << 4 for i in range(16))]


def test_fp8_codes():
    table = codecs.e4m3_table()
    assert table[0x38] == 1 and table[0x01] == 2.0**-9 and table[0x7E] == 448 and table[0xB8] == -1 and table[0x08] == 2.0**-6
    out = codecs.fp8_dequantized(np.full((130, 129), 0x38, dtype=np.uint8), np.array([[127, 128], [126, 127]], dtype=np.uint8))
    assert out[0, 0] == 1 and out[0, 128] == 2 and out[129, 0] == 0.5


@pytest.mark.parametrize("line, raises", [("from sparkloom.operators import nothing_here", True), ("import not_there_either", True)])
def test_a_broken_package_of_operators_is_not_swallowed(tmp_path, line, raises):
    (tmp_path / "corpus_pipeline.py").write_text(line + "\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]; import __spark_entry__"
    assert (subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=tmp_path).returncode != 0) == raises
