"""Costs of all pairs in blocks: odd vectors, copies, several blocks, large query sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vectors as V


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>")


def plain(queries, rows):
    """As the expressions dot(), norm() and squared_l2() have it, pair by pair."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("x"))
    both = q.join(rows.select(F.col("id").alias("row_id"), F.col("v").alias("y")), F.col("query_id") != F.col("row_id"))
    return both.select("query_id", "row_id", V.cosine_cost("x", "y").alias("cosine"), V.squared_l2("x", "y").alias("l2"))


def listed(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture
def odd(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(7)]) for i in range(40)]
    rows += [(100 + i, rows[5][1]) for i in range(30)]  # copies
    rows += [(3, rows[9][1]), (None, rows[1][1]), (50, None), (51, [1.0, None] * 3 + [2.0]), (52, [1.0, 2.0]), (54, [float("nan")] * 7), (55, [float("inf")] * 7), (56, [0.0] * 7)]
    return rows_of(spark, rows).repartition(3)


def test_costs_are_those_of_the_expressions(spark, odd, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    queries = odd.where("id % 2 = 0 or id is null")
    want = listed(plain(queries, odd))
    assert listed(V.pair_costs(queries, odd, "id", "v")) == want
    assert listed(V.pair_costs(queries, odd, "id", "v", ("l2",))) == sorted(((a, b, d) for a, b, _, d in want), key=repr)
    monkeypatch.setattr(V, "BROADCAST_ROWS", 10)  # a larger query set is done as well
    assert listed(V.pair_costs(queries, odd, "id", "v")) == want


def test_nearest_reads_few_pairs_and_loses_none(spark, odd):
    queries = odd.where("id % 2 = 0")
    costs = V.pair_costs(queries, odd, "id", "v", least=12)
    n = queries.select("id").distinct().count()
    assert costs.count() < 20 * n < plain(queries, odd).count()
    want = {}
    for q, r, c, _ in plain(queries, odd).collect():
        key = (c is None, 0 if c is None else math.inf if math.isnan(c) else round(c, 12), not (c is not None and not math.isnan(c)), r)
        want[q] = min(want.get(q, key), key)
    assert {r.query_id: r.row_id for r in V.nearest(costs, "cosine").collect()} == {q: k[-1] for q, k in want.items()}


def test_no_rows(spark):
    none = rows_of(spark, [])
    assert V.pair_costs(none, none, "id", "v").collect() == []
    assert V.pair_costs(rows_of(spark, [(1, [1.0])]), none, "id", "v", least=12).collect() == []
