"""op5 and the pipeline's line stage link every pair at the threshold, as a search of all pairs does."""

import random

import pytest

import corpus_pipeline
from sparkloom.llm.queries import QUERIES


def planted(size: int, count: int = 300):
    """Pairs of lines at exactly 0.8 by substitutions, insertions and deletions spread over the line."""
    draw = random.Random(size)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    rows = []
    for i in range(count):
        words = [word() for _ in range(size)]
        rows.append((i, " ".join(words)))
        edits = size // 5
        step = size / edits
        for k in range(edits):
            words[int(k * step + step / 2)] = word()  # evenly spread, so that the fewest runs stay
        rows.append((1000 + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lines")
    rows = [(10_000 * size + i, t) for size in (5, 10, 20, 40) for i, t in planted(size)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_finds_every_line_at_the_threshold(spark, folder):
    gone = {r.doc_id for r in QUERIES["op5_fuzzy_lines"](spark, folder).collect() if r.n_removed}
    assert gone == {10_000 * size + 1000 + i for size in (5, 10, 20, 40) for i in range(300)}


def test_stage_finds_every_line_at_the_threshold(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.lines(spark, docs, folder).collect() if r.text}
    assert left == {10_000 * size + i for size in (5, 10, 20, 40) for i in range(300)}
