"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK random walk writes 3n symbols for n words and moves on by a random bit of (step, word), so that few edits
leave most written symbols alike: edit distance becomes Hamming distance. Each of `tables` samples compares a few
written positions of a window with those of an item; a window that agrees in any sample is verified exactly. The
number of samples follows from `target_recall` and from the agreement that is measured on items with as many random
edits as the similarity allows.

Only windows that can match are embedded: n words with at most e edits hold a run of n // (e + 1) unchanged ones
(pigeonhole), so a window near no such run of its item cannot be within the distance. This drops no match.

The benchmark is a query set: it is read in blocks of BLOCK_ITEMS items, each a bounded table that goes to the tasks, and every
block is held against all documents in one scan without a shuffle.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches, without_ids

SIMILARITY = 0.8
TARGET_RECALL = 0.99
SAMPLE_POSITIONS = 2
RUN_WORDS = 4
BLOCK_ITEMS = 2000
_SPACED = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), ASCII signs as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Walk:
    """The random bits of one CGK embedding; symbols are 0 (beyond the item vocabulary) to n_symbols - 1, the last is the padding."""

    def __init__(self, n_symbols: int, n_words: int, seed: int) -> None:
        self.steps = 3 * n_words
        self.moves = np.random.default_rng(seed).integers(0, 2, size=(self.steps, n_symbols), dtype=np.int8)

    def embed(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: rows of words, padded; one more column of padding than words."""
        rows = np.arange(len(symbols))
        at = np.zeros(len(symbols), dtype=np.int64)
        out = np.empty((len(symbols), self.steps), dtype=symbols.dtype)
        last = symbols.shape[1] - 1
        for j in range(self.steps):
            out[:, j] = symbols[rows, np.minimum(at, last)]
            at += self.moves[j, out[:, j]]
        return out


def best_match(item: list[int], segment: list[int]) -> tuple[int, int]:
    """(edits, end): the least edit distance of `item` to any part of `segment`, and where that part ends (bit-parallel)."""
    m = len(item)
    where: dict[int, int] = {}
    for i, s in enumerate(item):
        if s:
            where[s] = where.get(s, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, (m, 0)
    for end, s in enumerate(segment, 1):
        eq = where.get(s, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & full
        hp, hn = (vn | ~(d0 | vp)) & full, vp & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best[0]:
            best = (score, end)
    return best


class Index:
    """One block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, target_recall: float, seed: int) -> None:
        texts = [(i, words_of(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        self.ids = [i for i, _ in texts]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in texts for x in ws}))}
        self.pad = len(self.vocabulary) + 1
        self.items = [[self.vocabulary[x] for x in ws] for _, ws in texts]
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.edits = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.widest = int(self.sizes.max(initial=0))
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (item, e) in enumerate(zip(self.items, self.edits.tolist(), strict=True)):
            q = max(1, min(RUN_WORDS, len(item) // (e + 1)))
            for p in range(len(item) - q + 1):
                found.setdefault(q, []).append((self._key(item[p : p + q]), k, p))
        for q, rows in found.items():
            rows.sort()
            self.runs[q] = tuple(np.array(c) for c in zip(*rows, strict=True))  # type: ignore[assignment]
        if not self.items:
            return
        self.walk = Walk(self.pad + 1, self.widest, seed)
        self.written = self.walk.embed(self._rows(self.items))
        draw = random.Random(seed)
        alike = self._agreement(draw)
        hit = max(alike**SAMPLE_POSITIONS, 1e-3)
        self.tables = max(8, math.ceil(math.log(1 - target_recall) / math.log(1 - min(hit, 0.999))))
        self.samples = np.array([[draw.random() for _ in range(SAMPLE_POSITIONS)] for _ in range(self.tables)])

    def _key(self, symbols: list[int]) -> int:
        """Mixed to 64 bits; a chance collision only embeds a window more."""
        h = 0
        for s in symbols:
            h = (h * 0x9E3779B97F4A7C15 + s + 1) & ((1 << 64) - 1)
        return h - (1 << 64) if h >> 63 else h

    def _rows(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full((len(rows), self.widest + 1), self.pad, dtype=np.int32)
        for i, r in enumerate(rows):
            out[i, : min(len(r), self.widest)] = r[: self.widest]
        return out

    def _agreement(self, draw: random.Random) -> float:
        """Share of written symbols that survive the most edits allowed, as a low quantile over all items."""
        changed = []
        for item, e in zip(self.items, self.edits.tolist(), strict=True):
            row = list(item)
            for _ in range(e):
                at = draw.randrange(len(row))
                kind = draw.randrange(3)
                if kind == 0:
                    row[at] = 0
                elif kind == 1 and len(row) > 1:
                    del row[at]
                else:
                    row.insert(at, 0)
            changed.append(row[: len(item)])
        same = self.walk.embed(self._rows(changed)) == self.written
        return float(np.quantile([same[i, : 3 * n].mean() for i, n in enumerate(self.sizes.tolist())], 0.1))

    def windows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows near an unchanged run, each once."""
        items, starts = [], []
        for q, (keys, item, at) in self.runs.items():
            if len(symbols) < q:
                continue
            known = symbols[: len(symbols) - q + 1] > 0
            for i in range(1, q):
                known = known & (symbols[i : len(symbols) - q + 1 + i] > 0)
            where = np.flatnonzero(known)
            h = np.zeros(len(where), dtype=np.uint64)
            for i in range(q):
                h = h * np.uint64(0x9E3779B97F4A7C15) + (symbols[where + i] + 1).astype(np.uint64)
            h = h.view(np.int64)
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            many = high - low
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            rows = np.repeat(low[hit] - np.cumsum(many[hit]) + many[hit], many[hit]) + np.arange(many[hit].sum())
            items.append(item[rows])
            starts.append(np.repeat(where[hit], many[hit]) - at[rows])
        if not items:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        item, start = np.concatenate(items), np.concatenate(starts)
        pairs = np.unique(np.stack([item, start], axis=1), axis=0)
        spread = 2 * self.edits[pairs[:, 0]] + 1
        shift = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) - np.repeat(self.edits[pairs[:, 0]], spread)
        pairs = np.stack([np.repeat(pairs[:, 0], spread), np.repeat(pairs[:, 1], spread) + shift], axis=1)
        pairs = np.unique(pairs[pairs[:, 1] > -self.widest], axis=0)
        return pairs[:, 0], pairs[:, 1]

    def survivors(self, symbols: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows agree with their item in all positions of at least one sample."""
        keep = np.zeros(len(item), dtype=bool)
        ahead = np.concatenate((np.zeros(self.widest, dtype=symbols.dtype), symbols, np.zeros(2 * self.widest + 1, dtype=symbols.dtype)))
        for a in range(0, len(item), 8192):
            it, st = item[a : a + 8192], np.minimum(start[a : a + 8192], len(symbols))
            rows = ahead[(st + self.widest)[:, None] + np.arange(self.widest + 1)]
            rows = np.where(np.arange(self.widest + 1) < self.sizes[it][:, None], rows, self.pad)
            same = self.walk.embed(rows.astype(np.int32)) == self.written[it]
            reach = 3 * self.sizes[it]
            for sample in self.samples:
                hit = np.ones(len(it), dtype=bool)
                for u in sample:
                    hit &= same[np.arange(len(it)), (u * reach).astype(np.int64)]
                keep[a : a + 8192] |= hit
        return keep

    def matches(self, docs: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
        """(document, item, first word, edits): for each document and item the best match within the item's edits."""
        get = self.vocabulary.get
        flat = np.array([get(w, 0) for d in docs for w in d], dtype=np.int64)
        ends = np.cumsum([len(d) for d in docs])
        item, start = self.windows(flat)
        keep = self.survivors(flat, item, start)
        item, start = item[keep], start[keep]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        done: dict[int, tuple[int, int]] = {}
        for k, s in zip(item.tolist(), start.tolist(), strict=True):  # by item, then start
            n, e = int(self.sizes[k]), int(self.edits[k])
            middle = min(max(s + n // 2, 0), len(flat) - 1)
            for doc in {int(np.searchsorted(ends, x, "right")) for x in (min(max(s, 0), len(flat) - 1), middle, min(s + n - 1, len(flat) - 1))}:
                first, last = (int(ends[doc - 1]) if doc else 0), int(ends[doc])
                a, b = max(first, s - e), min(last, s + n + e)
                if b <= a:
                    continue
                if done.get(k, (-1, -1)) == (a, b):
                    continue
                done[k] = (a, b)
                edits, end = best_match(self.items[k], flat[a:b].tolist())
                if edits <= e and (doc, k) not in found or edits < found.get((doc, k), (e + 1, 0))[0]:
                    found[doc, k] = (edits, max(0, a + end - n - first))
        return [(d, k, at, edits) for (d, k), (edits, at) in found.items()]


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[int, str], ...], similarity: float, target_recall: float, seed: int) -> Index:
    return Index(list(items), similarity, target_recall, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, seed: int = 5, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, item_words, edits): documents that hold an item with at least `similarity` of its words in place.

    Similarity is 1 - edits / words of the item, with word edits; first_word is about where the match begins. One row
    for each pair of a document row and an item; so repeated rows repeat theirs. Null and empty texts match nothing, and neither does an item
    without words; an empty table on either side gives no rows; a null id stays null. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("item_words", pa.int64()), ("edits", pa.int64())])
    kinds = "doc_id long, item_id long, first_word long, item_words long, edits long"

    def held_against(block: tuple[tuple[int, str], ...]) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(block, similarity, target_recall, seed)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [words_of(t) for t in batch.column(1).to_pylist()]
                if not index.items or not any(texts):
                    continue
                out = [(ids[d], index.ids[k], at, int(index.sizes[k]), e) for d, k, at, e in index.matches(texts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

        return rows.mapInArrow(scan, kinds)

    parts: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").orderBy("i").toLocalIterator():
        block.append((r.i, r.t))
        if len(block) == block_items:
            parts.append(held_against(tuple(block)))
            block = []
    if block or not parts:
        parts.append(held_against(tuple(block)))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """`docs` less the documents that contaminated() finds; columns pass through."""
    return without_ids(docs, contaminated(docs, benchmark, text, doc_id, **options).select("doc_id"), doc_id)
