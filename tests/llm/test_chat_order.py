"""Chat formatting: the order of ties, and long conversations in linear time."""

import time

from sparkloom.llm.chat_format import format_conversations, read_back


def test_ties_follow_the_raw_texts(spark):
    rows = [(1, 0, "user", "<a"), (1, 0, "user", "<|"), (1, 0, "a", "x"), (1, None, "user", None)]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = got.select(read_back(got.formatted).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("user", ""), ("a", "x"), ("user", "<a"), ("user", "<|")]


def test_a_long_conversation_is_merged_in_linear_time(spark):
    def took(n):
        rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 5 < 2, 'user', 'assistant') as role", "concat('text ', id) as text")
        began = time.perf_counter()
        size = format_conversations(rows).selectExpr("length(formatted) as n").first().n
        return time.perf_counter() - began, size

    took(1000)
    short, long = took(10_000), took(40_000)
    assert long[1] > 4 * short[1] and long[0] < 8 * short[0] + 2
