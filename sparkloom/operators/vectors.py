"""Vector costs, preference orders and collision-free remapping of identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranges import checkpointed

#: Below this a norm counts as this (the smallest normal double).
TINY = 2.2250738585072014e-308
#: Queries of all-pairs costs that may be broadcast; beyond, blocks meet in a Cartesian product.
BROADCAST_ROWS = 20_000
#: Rows in a block of vectors, and pairs whose costs are held at once.
BLOCK_ROWS, TILE = 1024, 16384


def dot(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: str | Column) -> Column:
    return F.greatest(F.sqrt(dot(x, x)), F.lit(TINY))


def cosine_cost(x: str, y: str) -> Column:
    return 1 - dot(x, y) / (norm(x) * norm(y))


def squared_l2(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(ids, dims, vectors): blocks of up to BLOCK_ROWS rows in order of their ids, vectors as bytes of doubles; dims -1: null or with a null entry."""
    kind = rows.schema[key].dataType.simpleString()
    some = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            whole = vectors.is_valid().to_numpy(zero_copy_only=False)
            if vectors.values.null_count:
                whole &= np.array([v.is_valid and not v.values.null_count for v in vectors], dtype=bool)
            dims = np.where(whole, pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), -1)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                at = at[np.argsort(ids.take(pa.array(at)).to_numpy(zero_copy_only=False), kind="stable")]
                for part in np.split(at, range(BLOCK_ROWS, len(at), BLOCK_ROWS)):
                    data = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False) if d > 0 else np.empty(0)
                    own = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([own, pa.array([d], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["ids", "dims", "vectors"])

    return some.mapInArrow(pack, f"ids array<{kind}>, dims int, vectors binary")


def _sums(x: np.ndarray, y: np.ndarray, square: bool) -> np.ndarray:
    """Dot products or squared distances of every x (by rows) and every y (by columns), summed in the order of their entries."""
    total, term = np.zeros((len(x), y.shape[1])), np.empty((len(x), y.shape[1]))
    for d in range(len(y)):
        if square:
            np.subtract(x[:, d, None], y[d], out=term)
            np.multiply(term, term, out=term)
        else:
            np.multiply(x[:, d, None], y[d], out=term)
        total += term
    return total


def _own_norm(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * x[:, d]
    return np.maximum(np.sqrt(total), TINY)


def _least(costs: np.ndarray, same: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of what may be the least rounded cost of an x: of equal costs the first y; if all are NaN the first of them."""
    costs = np.where(same, np.nan, costs)
    low = np.fmin.reduce(costs, axis=1)
    x, y = np.nonzero(costs <= (low + 2 * 10.0**-places)[:, None])
    value = costs[x, y]
    order = np.lexsort((y, value, x))
    x, y, value = x[order], y[order], value[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (value[1:] != value[:-1])
    none = np.flatnonzero(np.isnan(low) & ~same.all(axis=1))
    return np.concatenate((x[new], none)), np.concatenate((y[new], (~same[none]).argmax(axis=1) if len(none) else none))


def pair_costs(queries: DataFrame, rows: DataFrame, key: str, vector: str, measures: tuple[str, ...] = ("cosine", "l2"), least: int | None = None) -> DataFrame:
    """(query_id, row_id, *measures) of a stated query set against all rows but those of the same id; null ids give none.

    Both sides are packed into blocks, and every two blocks meet in one task, whose memory is bounded by TILE pairs; a query set of more
    than BROADCAST_ROWS is not broadcast. Sums run in the order of the entries, as in dot() and squared_l2(). A vector that is null, holds a null or has another length costs
    null. With `least`, only pairs that can be the least of their query in some measure rounded to so many places: a few for each two blocks.
    """
    kinds = [f.dataType.simpleString() for f in (queries.schema[key], rows.schema[key])]
    schema = f"query_id {kinds[0]}, row_id {kinds[1]}, " + ", ".join(f"{m} double" for m in measures)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    n = queries.count()
    q = _packed(queries, key, vector).toDF("x_ids", "x_dims", "x")
    q = F.broadcast(q) if n <= BROADCAST_ROWS else checkpointed(q.repartition(-(-n // BROADCAST_ROWS)))
    both = _packed(rows, key, vector).toDF("y_ids", "y_dims", "y").repartition(parts).crossJoin(q)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(xi: pa.Array, yi: pa.Array, values: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([xi, yi, *values], names=["query_id", "row_id", *measures])

        for batch in batches:
            for i in range(batch.num_rows):
                y_ids, y_dims, y, x_ids, x_dims, x = (batch.column(c)[i] for c in range(6))
                x_ids, y_ids = x_ids.values, y_ids.values
                own, others = x_ids.to_numpy(zero_copy_only=False), y_ids.to_numpy(zero_copy_only=False)
                d = x_dims.as_py()
                alike = d >= 0 and d == y_dims.as_py()
                if alike:
                    left = np.frombuffer(x.as_buffer(), np.float64).reshape(len(own), d)
                    right = np.ascontiguousarray(np.frombuffer(y.as_buffer(), np.float64).reshape(len(others), d).T)
                    norms = (_own_norm(left), _own_norm(right.T)) if "cosine" in measures else None
                step = max(TILE // len(others), 1)
                for a in range(0, len(own), step):
                    same = own[a : a + step, None] == others
                    if not alike:
                        at = np.nonzero(~same)
                        if least is not None:  # of each query the smallest id
                            at = tuple(c[np.unique(at[0], return_index=True)[1]] for c in at)
                        yield batch_of(x_ids.take(pa.array(at[0] + a)), y_ids.take(pa.array(at[1])), [pa.nulls(len(at[0]), pa.float64()) for _ in measures])
                        continue
                    found = []
                    with np.errstate(all="ignore"):
                        for m in measures:
                            sums = _sums(left[a : a + step], right, m == "l2")
                            found.append(sums if m == "l2" else 1 - sums / (norms[0][a : a + step, None] * norms[1]))
                        if least is None:
                            at = np.nonzero(~same)
                        else:
                            at = tuple(np.concatenate(c) for c in zip(*(_least(f, same, least) for f in found), strict=True))
                    yield batch_of(x_ids.take(pa.array(at[0] + a)), y_ids.take(pa.array(at[1])), [pa.array(f[at], pa.float64()) for f in found])

    return both.mapInArrow(costs, schema)


def nearest(costs: DataFrame, cost: str, places: int = 12) -> DataFrame:
    """For each query the row of least cost (rounded, so that both orders of summing agree), ties by id, null costs last: one partial aggregate."""
    return costs.groupBy("query_id").agg(least_row(cost, places).alias("best")).select("query_id", F.col("best.row_id").alias("row_id"), F.col("best.cost").alias("cost"))


def least_row(cost: str, places: int = 12) -> Column:
    """Aggregate: struct with the row_id and the rounded cost of the least cost."""
    rounded = F.round(cost, places)
    return F.min(F.struct(rounded.isNull().alias("none"), rounded.alias("cost"), F.col("row_id")))


def preference_orders(costs: DataFrame, old: str, new: str, cost: str) -> DataFrame:
    """(old, preferences): candidates by ascending cost, then id. Both sides are identifiers of a fixed, small universe."""
    one = F.struct(F.round(cost, 12).alias("c"), F.col(new).alias("i"))
    return costs.groupBy(old).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.i).alias("preferences"))


def greedy_remap(rows: DataFrame, slots: str, survivors: list[int], preferences: DataFrame, old: str) -> DataFrame:
    """`rows` with remapped slots and counts: survivors stay in place, then each other slot takes its best unused survivor.

    preferences: as from preference_orders(), bounded by the universe and so broadcast as one map. A slot without a free candidate
    becomes null.
    """
    table = preferences.agg(F.map_from_entries(F.collect_list(F.struct(old, "preferences"))).alias("__prefs"))
    kept = F.array(*(F.lit(s) for s in survivors)).cast("array<bigint>")
    rows = rows.withColumn("__used", F.array_intersect(F.col(slots).cast("array<bigint>"), kept)).join(F.broadcast(table))  # one row
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("out"), F.col("__used").alias("used"), F.lit(0).cast("long").alias("replaced"), F.lit(0).cast("long").alias("avoided"))

    def step(s: Column, x: Column) -> Column:
        prefs = F.coalesce(F.try_element_at("__prefs", x), F.expr("cast(array() as array<bigint>)"))
        free = F.try_element_at(F.array_except(prefs, s.used), F.lit(1))
        stays = F.array_contains(kept, x)
        put = F.when(stays, x).otherwise(free)
        used = F.when(stays | free.isNull(), s.used).otherwise(F.array_append(s.used, free))
        avoided = F.when(~stays & (free != F.try_element_at(prefs, F.lit(1))), 1).otherwise(0)
        return F.struct(F.array_append(s.out, put).alias("out"), used.alias("used"), (s.replaced + F.when(stays, 0).otherwise(1)).alias("replaced"), (s.avoided + avoided).alias("avoided"))

    done = F.aggregate(F.col(slots).cast("array<bigint>"), start, step)
    rows = rows.withColumn("__done", done)
    return rows.withColumn("remapped", F.col("__done.out")).withColumn("replaced", F.col("__done.replaced")).withColumn("avoided", F.col("__done.avoided")).drop("__done", "__used", "__prefs")


def least_total(costs: list[list[float]]) -> float:
    """The least total cost of giving each row its own column; rows are few (dynamic programming over columns taken)."""
    n = len(costs)
    if not n:
        return 0.0
    useful = sorted({c for row in costs for c in sorted(range(len(row)), key=lambda k: (row[k], k))[:n]})
    best = {0: 0.0}  # bits of rows served -> least cost, column by column
    for c in useful:
        after = dict(best)
        for done, total in best.items():
            for r in range(n):
                if not done >> r & 1:
                    key = done | 1 << r
                    value = total + costs[r][c]
                    if value < after.get(key, float("inf")):
                        after[key] = value
        best = after
    return best.get((1 << n) - 1, float("inf"))


def optimal_costs(rows: DataFrame, slots: str, survivors: list[int], costs: dict[tuple[int, int], float]) -> DataFrame:
    """(slots, optimal_cost) for each distinct row of slots: the least total cost of replacing its dropped ids without collision.

    costs: (dropped id, survivor) -> cost, bounded by the universe.
    """
    alive = set(survivors)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch[slots]:
                row = [int(x) for x in row]
                free = [s for s in survivors if s not in row]
                out.append(least_total([[costs[x, s] for s in free] for x in row if x not in alive]))
            yield pd.DataFrame({slots: batch[slots], "optimal_cost": out})

    return rows.select(F.col(slots).cast("array<bigint>").alias(slots)).distinct().mapInPandas(solve, f"{slots} array<bigint>, optimal_cost double")


def unequal_positions(x: str | Column, y: str | Column) -> Column:
    """How many positions of two arrays differ."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))


def top_components(vector: str | Column, k: int) -> Column:
    """The k largest entries of an array as structs (rank from 1, position from 0, value as double), ties by the smaller position; null entries do not count."""
    c = F.col(vector) if isinstance(vector, str) else vector
    placed = F.transform(c, lambda x, i: F.struct((-x.cast("double")).alias("less"), i.cast("long").alias("position")))
    best = F.slice(F.sort_array(F.filter(placed, lambda x: x["less"].isNotNull())), 1, k)
    return F.transform(best, lambda x, i: F.struct((i + 1).cast("long").alias("rank"), x["position"].alias("position"), (-x["less"]).alias("value")))
