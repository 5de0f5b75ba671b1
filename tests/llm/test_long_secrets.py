"""Secrets of any length."""

import random

import pytest

from sparkloom.llm.pii import _generators, located, personal_data


@pytest.mark.parametrize("n", [150, 201, 5000])
def test_long_secrets_are_found_whole(spark, n):
    draw = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    body = "".join(draw.choice(letters) for _ in range(n))
    texts = [f"see token={body} there", f"access key {body} there"]
    rows = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.kind, x.e) for x in r.added] for r in rows} == {i: [("secret", t.index(body) + n)] for i, t in enumerate(texts)}


def test_the_gate_lets_named_secrets_without_digits_through(spark):
    texts = ["my password: abcdefgh", "my password: abcdefgh and 1 more", "no such thing"]
    rows = located(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), _generators()).collect()
    assert {r.doc_id: [x.v for x in r.secret_0] for r in rows} == {0: ["password: abcdefgh"], 1: ["password: abcdefgh"], 2: []}
