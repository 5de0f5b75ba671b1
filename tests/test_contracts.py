"""Contracts pass on sound inputs and name what a mutation breaks."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions.codecs import mxfp4_repacked
from sparkloom.operators import contracts as K
from sparkloom.operators.checks import failures, summary, verdict


def failed(checks):
    return {(r["check"], r.key) for r in checks.where(~F.col("ok")).collect()}


def test_masks(spark):
    good = [("a", 2, 0, [1, 5]), ("a", 2, 1, [0, 7])]
    frame = lambda rows: spark.createDataFrame(rows, "source_id string, declared_k int, layer int, experts array<int>")
    assert failed(K.mask_contract(frame(good), 2, 0, 7)) == set()
    bad = [("a", 2, 0, [5, 1]), ("a", 2, 1, [1, 1]), ("a", 2, 2, [1, 256]), ("a", 2, 3, [1])]
    assert failed(K.mask_contract(frame(bad), 5, 0, 7)) == {("canonical", "a:0"), ("canonical", "a:1"), ("range", "a:2"), ("size", "a:3"), ("layers", "a")}


def test_scores_and_plan(spark):
    rows = [(0, i, 3 - i // 2, i + 1, i < 3) for i in range(6)]
    scores = spark.createDataFrame(rows, "layer int, expert_id int, score int, rank int, selected boolean")
    assert verdict(K.score_contract(scores, 6, 3, 5)).first().all_ok
    moved = scores.withColumn("rank", F.when(F.col("rank") == 6, 5).otherwise(F.col("rank")))
    assert failed(K.score_contract(moved, 6, 3, 5)) == {("ranks", "0")}
    assert failed(K.score_contract(scores.withColumn("selected", F.col("rank") <= 4), 6, 3, 2)) == {("selected", "0"), ("score_range", "0")}
    plan = spark.createDataFrame([(0, 0), (0, 1), (0, 5)], "layer int, expert int")
    parent = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "layer int, expert int")
    assert failed(K.plan_contract(plan, scores, parent)) == {("within_parent", "0:5"), ("equals_selection", "0:5"), ("equals_selection", "0:2")}


def test_routing_and_inventory(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [1, 1]), (2, [9, 0]), (3, [1])], "token_id int, e array<int>")
    assert failed(K.routing_contract(rows, "e", 2, 4)) == {("distinct", "1"), ("range", "2"), ("width", "3")}
    names = spark.createDataFrame([(n,) for n in ("l.0.e.0.w", "l.0.e.1.w", "l.0.g", "mtp.l.0.e.1.w", "l.1.e.1.w")], "name string")
    kept = spark.createDataFrame([(0, 1)], "layer int, expert int")
    assert tuple(K.inventory(names, r"^l\.(\d+)\.e\.(\d+)\.w$", kept, "mtp.").first()) == (5, 2, 1, 2)


def test_dry_run_and_acceptance(spark):
    names = spark.createDataFrame([("a.exps",), ("b",)], "name string")
    log = spark.createDataFrame([(1, 2, "a.exps", "q2"), (2, 2, "b", "q8")], "position int, count int, name string, target string")
    assert failed(K.dry_run_contract(log, names, [(r"exps$", "q2")], "q8")) == set()
    assert failed(K.dry_run_contract(log.where("position = 2"), names, [(r"exps$", "q2")], "f16")) == {("planned_type", "a.exps"), ("planned_type", "b"), ("numbering", "log")}
    reports = spark.createDataFrame([("x", "PASS"), ("y", "FAIL")], "name string, status string")
    assert tuple(K.accepted(reports, ["x", "y", "z"]).first()) == (["y", "z"], "FAIL") and K.accepted(reports, ["x"]).first().status == "PASS"


def test_repacked_payloads(spark):
    draw = np.random.default_rng(7)
    w, s = draw.integers(0, 256, (3, 32), dtype=np.uint8), draw.integers(0, 256, (3, 2), dtype=np.uint8)
    source = spark.createDataFrame([("k", bytearray(w.tobytes()), bytearray(s.tobytes()), 3)], "key string, weights binary, scales binary, rows int")
    data = bytearray(mxfp4_repacked(w, s))
    target = lambda d: spark.createDataFrame([("k", d)], "key string, data binary")
    checks = K.repack_contract(source, target(data))
    assert failed(checks) == set() and {r.status for r in summary(checks).collect()} == {"PASS"}
    data[5] ^= 1
    assert [r["check"] for r in failures(K.repack_contract(source, target(data)), 5).collect()] == ["bytes"]
