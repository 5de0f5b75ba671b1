"""Cross-entropy difference: a target and a background bigram model over one vocabulary.

The vocabulary is a public tokenizer's, the same for both models, and so are order and smoothing (Dirichlet-smoothed
bigrams over add-one unigrams); the models differ only in the documents counted. Background: all documents. Target:
the documents labelled good. The score is the mean over a document's tokens of target loss minus background loss, so
low scores are close to the target (Moore and Lewis, 2010). A document's own counts are taken out of the models that hold them
before it is scored, so no document vouches for itself.

Tokens are written once, in blocks (a task's run of at most BLOCK_TOKENS). Each block hands on its distinct bigrams
with their counts, so what is shuffled is combined first, and grows with the corpus; the sums by bigram are joined back
to the blocks that hold the bigram, never broadcast, and each block's documents are scored beside its own part of the
model. Unigram tables are bounded by the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches, written
from sparkloom.llm.tokens import byte_bpe

#: Weight of the unigram model in each context, in tokens.
DIRICHLET = 50.0
BLOCK_TOKENS = 1 << 22
#: Labelled ids are broadcast up to so many (8 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def _tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(block, doc_id, target, ids binary): uint16 token ids."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("target", pa.bool_()), ("ids", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = [x.tobytes() for x in bpe.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), batch.column(0), batch.column(2), pa.array(ids, pa.binary())], schema=schema)
            held += sum(map(len, ids)) // 2
            if held >= BLOCK_TOKENS:
                block, held = block + 1, 0

    return docs.select("doc_id", "text", "target").mapInArrow(apply, "block long, doc_id long, target boolean, ids binary")


def bigrams(ids: np.ndarray, start: int) -> np.ndarray:
    """Keys of (token before, token), the first with the start symbol."""
    before = np.concatenate((np.array([start], dtype=np.int64), ids[:-1].astype(np.int64)))[: len(ids)]
    return before << 17 | ids.astype(np.int64)


def _block_counts(tokens: DataFrame, start: int) -> DataFrame:
    """(block, key, n, n_target): a row for each distinct bigram of a block."""
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("n_target", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[np.ndarray] = []
        marked: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = np.concatenate(held)
            key, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            target = np.bincount(at, weights=np.concatenate(marked), minlength=len(key)).astype(np.int64)
            for a in range(0, len(key), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), now)), pa.array(key[part]), pa.array(n[part].astype(np.int64)), pa.array(target[part])], schema=schema)

        for batch in batches:
            for block, target, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if block != now:
                    yield from counted()
                    now, held, marked = block, [], []
                keys = bigrams(np.frombuffer(raw, dtype=np.uint16), start)
                held.append(keys)
                marked.append(np.full(len(keys), float(target)))
        yield from counted()

    return tokens.mapInArrow(apply, "block long, key long, n long, n_target long")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, dirichlet: float = DIRICHLET) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for every row; losses are nats a token.

    target_ids: one column, ids of the target documents (repeats and nulls count once and not at all). Null and empty
    texts have no tokens and null losses. Repeated rows are counted and scored each; a null id stays null and is never
    a target; without target documents the target model is uniform. An empty table gives no rows. Other columns are
    not read.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    small_batches(spark)
    size = byte_bpe(path).size
    start = size  # a context that no text holds
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("tid")).where("tid is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(ids, rows.doc_id == ids.tid, "left").select("doc_id", "text", F.col("tid").isNotNull().alias("target"))
    tokens = written(_tokenised(rows, path), "tokens")
    blocks = written(_block_counts(tokens, start), "block-bigrams")
    model = written(blocks.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "bigrams")

    # bounded by the vocabulary: counts of tokens and of contexts
    mass = np.zeros((2, 2, size + 1), dtype=np.float64)  # model, (token, context), id
    for role, column in enumerate((F.col("key").bitwiseAND(F.lit((1 << 17) - 1)), F.shiftright("key", 17))):
        for r in model.groupBy(column.alias("id")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("t")).collect():
            mass[0, role, r.id], mass[1, role, r.id] = r.n, r.t
    tables = spark.sparkContext.broadcast(mass)

    needed = blocks.select("block", "key").join(model, "key").select("block", "key", "n", "n_target")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("difference", pa.float64())])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        count = tables.value
        order = np.argsort(left.column("key").to_numpy())
        keys = left.column("key").to_numpy()[order]
        known = np.stack([left.column("n").to_numpy()[order], left.column("n_target").to_numpy()[order]]).astype(np.float64)
        out: list[tuple] = []
        for one, target, raw in zip(right.column("doc_id").to_pylist(), right.column("target").to_pylist(), right.column("ids").to_pylist(), strict=True):
            text_ids = np.frombuffer(raw, dtype=np.uint16).astype(np.int64)
            n = len(text_ids)
            if not n:
                out.append((one, 0, None, None, None))
                continue
            mine = bigrams(text_ids, start)
            context = mine >> 17
            both = known[:, np.searchsorted(keys, mine)]
            token, seen = count[:, 0, text_ids], count[:, 1, context]
            # leave this document out: it is counted in the background, and in the target if it is labelled
            out_of = np.array([[1.0], [float(target)]])
            _, at, own = np.unique(mine, return_inverse=True, return_counts=True)
            both = both - out_of * own[at]
            token = token - out_of * np.bincount(text_ids, minlength=size + 1)[text_ids]
            seen = seen - out_of * np.bincount(context, minlength=size + 1)[context]
            total = count[:, 0].sum(axis=1, keepdims=True) - out_of * n
            unigram = (token + 1) / (total + size)
            loss = -np.log((both + dirichlet * unigram) / (seen + dirichlet)).mean(axis=1)
            out.append((one, n, float(loss[1]), float(loss[0]), float(loss[1] - loss[0])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    left = needed.groupBy("block")
    right = tokens.groupBy("block")
    return left.cogroup(right).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
