"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets its row of the pivot table: its Hamming distances to PIVOTS reference fingerprints.
By the triangle inequality two fingerprints within `max_bits` differ by at most `max_bits` in every coordinate, so a
pair whose maximum coordinate difference is larger is discarded without looking at the fingerprints; survivors are
verified bit by bit.

Pivot coordinates of 64-bit hashes concentrate around 32, so on their own they cannot serve as an equi-join key. Pairs
therefore meet on blocks: the fingerprint is cut into max_bits + 2 blocks and a pair within `max_bits` agrees on two of
them at least. Rows are dealt by the values of every two blocks, which keeps buckets small. A bucket over TILE
rows is split into tiles of chunk pairs, so a group of near-copies of any size is spread over many tasks, and a tile
hands on a spanning forest, not its pairs.

A similarity of 0.8 in five-word shingles is about 9 to 10 bits, beyond what blocks can find, so one_of_each_group() can also
link by exact Jaccard similarity (alike_links()): such texts agree on a key of some band of min-wise hashes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import connected_components, small_batches, without_ids, written

SHINGLE_WORDS = 5
HASH_SEED = 42
MAX_BITS = 7
PIVOTS = 16
TILE = 1024
#: Texts at a Jaccard similarity of 0.8 agree on a key of one of 16 bands of 4 with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
BANDS, BAND_ROWS = 16, 4
FAR_BITS = 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the word shingles, one for each place; fewer words than a shingle make one of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1]
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half the XXH64 values of the word shingles; no words: 0."""
    return majority(shingle_hashes(text, shingle_words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    seen = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64)
    seen += np.arange(8, dtype=np.int64) * 256
    set_bits = (np.bincount(seen.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots(count: int = PIVOTS, seed: int = 7) -> list[int]:
    """Reference fingerprints: fixed by the seed, the same on every run and cluster."""
    draw = random.Random(seed)
    return [signed(draw.getrandbits(64)) for _ in range(count)]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) for every row."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x, shingle_words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(apply, "doc_id long, fp long")


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of max_bits + 2 blocks: a pair within max_bits agrees on two of them at least."""
    n = max_bits + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _forest(fps: np.ndarray, table: np.ndarray, side: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one tile; side 0 and 1: only links across, unless all are one side."""
    n = len(fps)
    left = np.ones(n, dtype=bool)
    across = side.min() != side.max()
    edges: list[tuple[int, int]] = []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(left & (side != side[i]) if across else left)
            for c in range(table.shape[1]):  # the pivot filter: every coordinate may differ by max_bits at most
                if len(near) < 64:
                    break
                near = near[np.abs(table[near, c] - table[i, c]) <= max_bits]
            near = near[np.abs(table[near] - table[i]).max(axis=1) <= max_bits] if len(near) else near
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits]
            left[near] = False
            edges += [(i, int(j)) for j in near]
            todo += near.tolist()
    ids = fps.view(np.int64)
    return [(int(ids[i]), int(ids[j])) for i, j in edges]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """(src, dst) fingerprints: links whose connected components are those of all pairs within max_bits.

    distinct: one row for each fingerprint (fp long).
    """
    spark = distinct.sparkSession
    cut = blocks(max_bits)
    refs = pivots(n_pivots)
    fp = F.col("fp")
    combos = list(combinations(range(len(cut)), 2))

    def block(i: int):
        start, bits = cut[i]
        return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))

    # the key: the combination's number above the two blocks' bits
    keys = [F.shiftleft(F.lit(n).cast("long"), 58).bitwiseOR(F.shiftleft(block(i), 29)).bitwiseOR(block(j)) for n, (i, j) in enumerate(combos)]
    table = F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in refs))
    keyed = distinct.select("fp", table.alias("pivot"), F.explode(F.array(*keys)).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key", F.ceil(F.col("n") / tile).cast("int").alias("chunks"))
    keyed = keyed.join(large.hint("merge"), "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = keyed.select("key", "fp", "pivot", "chunk", other.alias("other"))
    tiled = tiled.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("byte").alias("side"), "fp", "pivot")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tiled = tiled.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        rest: tuple[np.ndarray, ...] | None = None

        def solve(key: np.ndarray, side: np.ndarray, fps: np.ndarray, table: np.ndarray, final: bool):
            """Links of all whole tiles; what may go on in the next batch is kept."""
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], change, [len(key)])) if len(key) else np.array([0])
            last = len(bounds) - 1 if final else max(len(bounds) - 2, 0)
            out: list[tuple[int, int]] = []
            sizes = np.diff(bounds[: last + 1])
            two = bounds[:last][sizes == 2]  # most tiles hold one pair: all at once
            if len(two):
                near = np.abs(table[two] - table[two + 1]).max(axis=1) <= max_bits
                two = two[near]
                two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
                out += zip(fps[two].view(np.int64).tolist(), fps[two + 1].view(np.int64).tolist(), strict=True)
            for a, size in zip(bounds[:last][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += _forest(fps[a : a + size], table[a : a + size], side[a : a + size], max_bits)
            end = bounds[last]
            return out, (key[end:], side[end:], fps[end:], table[end:])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            side = batch.column(3).to_numpy(zero_copy_only=False)
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)  # bitwise_count takes the absolute value of signed ones
            table = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(fps), -1).astype(np.int16)
            if rest is not None:
                key, side, fps, table = (np.concatenate(x) for x in zip(rest, (key, side, fps, table), strict=True))
            out, rest = solve(key, side, fps, table, False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)
        if rest is not None and len(rest[0]):
            out, _ = solve(*rest, True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)

    return tiled.mapInArrow(tile_links, "src long, dst long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest doc_id in the connected group of fingerprints within max_bits of each other. Texts
    with the same fingerprint share a group; null, empty and blank texts have fingerprint zero and link like any
    other. Repeated rows each give a row, a null id takes its group's id and never names one; an empty table gives none.
    Other columns are not read. Its joins are by sort and merge: what they hold grows with the documents, and must not pass through the driver.
    """
    prints = written(fingerprints(docs, text, doc_id, shingle_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct, "distinct-fingerprints")
    groups = connected_components(links(distinct.select("fp"), max_bits))
    member = distinct.join(groups.hint("merge"), distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = member.join(named.hint("merge"), "component").select("fp", "component_id")
    return prints.join(of_print.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _multipliers() -> np.ndarray:
    draw = np.random.default_rng(HASH_SEED)
    return draw.integers(0, 1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: each mixes the least values of BAND_ROWS hash functions."""
    least = np.full(len(by), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 4096):
        x = hashes[a : a + 4096, None] * by[None, :]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _shingle_sets(docs: DataFrame, shingle_words: int, bands: bool) -> DataFrame:
    """(id, fp, set_id, n, hashes) of texts with words: the distinct shingles or, with `bands`, their keys. docs: id, text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every = shingle_hashes(text, shingle_words)
                own = np.unique(every)
                if len(own):
                    rows.append((i, signed(majority(every)), signed(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED)), len(own), band_keys(own, by) if bands else own.view(np.int64)))
            columns = [pa.array([r[c] for r in rows], schema.field(c).type) for c in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("id", "text").mapInArrow(apply, "id long, fp long, set_id long, n long, hashes array<long>")


def alike_links(docs: DataFrame, groups: DataFrame, similarity: float, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(src, dst): links of the groups that hold texts of at least this Jaccard similarity; docs: id, text; groups: fp, label.

    Texts meet on the keys of BANDS bands. Only pairs in different groups are verified, first against the smallest set of each key, then
    the rest. A pair whose fingerprints are FAR_BITS or more apart is not verified: at 0.8 the distance is about 10, with a deviation of 3.
    """
    sets = _shingle_sets(docs, shingle_words, True).join(groups, "fp").groupBy("set_id", "label", "fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    keyed = written(sets.select(F.struct("set_id", "id").alias("at"), "label", "n", "fp", F.explode("hashes").alias("key")), "band-keys")

    def mixed(rows: DataFrame, name: str) -> DataFrame:
        """The rows of keys that hold several groups."""
        several = rows.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
        return written(rows.join(several, "key"), name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(src, dst) labels of the pairs (a, la, b, lb) of sets that are similar enough; a, b: set_id and an id that has it."""
        pairs = written(pairs.distinct(), f"{name}-pairs")
        ends = written(pairs.select("a.id").union(pairs.select("b.id")).distinct(), f"{name}-ends")
        full = written(_shingle_sets(docs.join(ends, "id", "left_semi"), shingle_words, False).groupBy("set_id").agg(F.first("hashes").alias("hashes")), f"{name}-sets")
        both = pairs.join(full.select(F.col("set_id").alias("i"), F.col("hashes").alias("x")), F.col("a.set_id") == F.col("i")).join(full.select(F.col("set_id").alias("j"), F.col("hashes").alias("y")), F.col("b.set_id") == F.col("j"))
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
        good = F.col("shared") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("shared")) - 1e-9
        return written(both.where(good).select(F.col("la").alias("src"), F.col("lb").alias("dst")).distinct(), name)

    def near(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9) & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) < FAR_BITS)

    pair = [F.col(f"{s}.{c}").alias(n) for s, n in (("x", "a"), ("y", "b")) for c, n in (("at", n), ("label", f"l{n}"))]
    keyed = mixed(keyed, "shared-keys")
    low = keyed.groupBy("key").agg(F.min(F.struct("at", "label", "n", "fp")).alias("low")).select("key", "low.*").alias("x")
    y = keyed.alias("y")
    star = low.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & near("x", "y"))
    found = verified(star.select(*pair), "star-links")
    joined = connected_components(found).checkpoint()
    labelled = keyed.join(joined, keyed.label == joined.node, "left").drop("node").withColumn("label", F.coalesce("component", "label")).drop("component")
    rest = mixed(labelled, "apart-keys")
    x, y = rest.alias("x"), rest.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & near("x", "y"))
    return found.unionByName(verified(met.select(*pair), "later-links"))


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, jaccard: float | None = None) -> DataFrame:
    """`docs` less all documents of a near-duplicate group but the one with the smallest id.

    With `jaccard`, texts whose sets of shingles are at least so similar are in one group too, whatever their fingerprints. Rows that
    share an id are one document. Null ids stay unless their group has an id. Columns pass through.
    """
    groups = simhash_components(docs, text, doc_id, shingle_words, max_bits)
    groups = groups if jaccard is None else written(groups, "groups")
    if jaccard is None:
        return without_ids(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), doc_id)
    last = F.lit((1 << 63) - 1)  # a null id comes last
    label = F.coalesce("component_id", last).alias("label")
    own = groups.select(F.coalesce("doc_id", last).alias("id"), label).distinct()
    of_print = groups.select(F.conv("fingerprint", 16, -10).cast("long").alias("fp"), label).distinct()
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), last).alias("id"), F.col(text).cast("string").alias("text"))
    joined = connected_components(alike_links(texts, of_print, jaccard, shingle_words))
    kept = own.join(joined, own.label == joined.node, "left").select("id", F.coalesce("component", "label").alias("label"))
    gone = kept.where("id <> label").select(F.when(F.col("id") != last, F.col("id")).alias("id"))
    return without_ids(docs, gone, doc_id)
