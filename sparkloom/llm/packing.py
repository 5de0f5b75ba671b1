"""Hierarchical multi-length packing.

Documents become token ids with an end id. What fills whole windows of the longest context is cut off first; the rest
of each document is routed to the shortest context tier that holds it. Tiers are packed from the longest: a window takes its document, then the longest
pieces of shorter tiers that still fit its gap, and last a cut from the shortest tier, so windows of a tier end up
full. What is left when no filler remains is joined and cut into full windows and powers of two. Windows are dealt
to step groups by load, the longest first.

Every task packs its own rows, in shards of at most `shard_tokens`: nothing is shuffled, memory is bounded by a shard,
and a task that is run again on another executor gives the same rows. Ids of sequences and groups hold the task's
partition, so they do not meet.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches
from sparkloom.llm.tokens import byte_bpe

TIERS = (2048, 1024, 512, 256)
END_ID = 1
SHARD_TOKENS = 1 << 23
STEP_TOKENS = 1 << 17

Piece = tuple[int, int, int]  # document, first id, ids


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows as (length, pieces) that hold every id of documents of these lengths once; a window's pieces fill it."""
    top = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    waiting: list[list[Piece]] = [[] for _ in range(top + 1)]
    mask = 0  # bit n: some piece of n ids waits
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows += [(top, [(doc, at, top)]) for at in range(0, full, top)]
        if n > full:
            waiting[n - full].append((doc, full, n - full))
            mask |= 1 << (n - full)

    def take(most: int) -> Piece | None:
        """The longest waiting piece of at most so many ids."""
        nonlocal mask
        n = (mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        piece = waiting[n].pop()
        if not waiting[n]:
            mask &= ~(1 << n)
        return piece

    rest: list[Piece] = []
    for i, tier in enumerate(tiers):
        lower = tiers[i + 1] if i + 1 < len(tiers) else 0
        while (mask >> (lower + 1)) << (lower + 1) & ((1 << (tier + 1)) - 1):
            piece = take(tier)
            pieces, gap = [piece], tier - piece[2]
            while gap:
                piece = take(gap)
                if piece is None:
                    n = (mask & -mask).bit_length() - 1  # the shortest piece that waits gives what the gap needs
                    if n < 1 or (lower and n > tier):
                        break
                    doc, at, size = take(n)
                    waiting[size - gap].append((doc, at + gap, size - gap))
                    mask |= 1 << (size - gap)
                    piece = (doc, at, gap)
                pieces.append(piece)
                gap -= piece[2]
            if gap:
                rest += pieces
            else:
                windows.append((tier, pieces))
    # no filler was left for these: join them and cut full windows, then powers of two
    left = sum(p[2] for p in rest)
    size, room, pieces = 0, 0, []
    for doc, at, n in rest:
        while n:
            if not room:
                size = room = top if left >= top else 1 << (left.bit_length() - 1)
                pieces = []
                windows.append((size, pieces))
            part = min(n, room)
            pieces.append((doc, at, part))
            doc, at, n, room, left = doc, at + part, n - part, room - part, left - part
    return windows


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    load = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(load)
        out[i] = g
        heapq.heappush(load, (tokens + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group, ids.

    ids (little-endian unsigned 32-bit, null unless `with_ids`) are the piece's tokens. Every id of a document lies in
    one piece. window is the sequence's length: a tier, or a smaller power of two at a shard's end; there is no
    padding. Null and empty texts are the end id alone. Repeated rows are packed each; a null id stays null; an empty
    table gives no rows. Very long texts span many windows. Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        base = TaskContext.get().partitionId() << 36
        sequences = groups = 0
        names: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        last = np.array([end_id], dtype=np.uint16)

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups, held
            windows = plan([len(x) for x in tokens], tiers)
            step = step_groups([w for w, _ in windows])
            rows: list[tuple] = []
            for (size, pieces), g in zip(windows, step, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    raw = tokens[doc][start : start + n].astype("<u4").tobytes()
                    rows.append((names[doc], start, n, zlib.crc32(raw), len(tokens[doc]), base + sequences, offset, size, base + groups + g, raw if with_ids else None))
                    offset += n
                sequences += 1
            groups += max(step, default=-1) + 1
            names.clear()
            tokens.clear()
            held = 0
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            names += batch.column(0).to_pylist()
            new = [np.concatenate((x, last)) for x in bpe.encode(batch.column(1).to_pylist())]
            tokens += new
            held += sum(map(len, new))
            if held >= shard_tokens:
                yield from shard()
        if tokens:
            yield from shard()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pack, kinds)
