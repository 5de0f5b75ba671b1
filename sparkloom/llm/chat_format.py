"""Relational chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged by an array
aggregation; the merged turns are concatenated. The template marks every turn and escapes control strings inside
texts, so the output reads back exactly:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>...

<|next|> separates the texts of a merged turn. A backslash in a text is doubled, and one is put behind the first
character of each control string of this or another common template, so no text can open or close a turn. Only the
texts of assistant turns are under the loss mask.

A conversation is collected in two steps (CHUNK turns at a time, then the chunks), so one that holds a large share of all turns
is sorted and escaped by many tasks. Its merged turns then meet in one row, since its output is one string, of at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of common templates; fixed values.
CONTROLS = r"<\||\[/?INST\]|</?s>|<</?SYS>>"
CHUNK = 256
LOSS_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    """Reversible: afterwards no control string is left."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?=(?:{CONTROLS}))([<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merged(rows: DataFrame, turns: Column) -> DataFrame:
    """conv_id, the other columns but `turns`, and turns array<struct<role, body>>: runs of one role as one element, bodies joined by NEXT.

    Arrays are exploded as one element, so that each is made once and not for each turn that looks at it; the work is linear.
    """
    kept = [c for c in rows.columns if c != "turns"]
    rows = rows.select(*kept, F.explode(F.array(turns)).alias("all"))
    begins = lambda i: (i == 0) | (F.get("all", i).role != F.get("all", i - 1).role)
    rows = rows.select(*kept, "all", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("all") - 1), begins))).alias("starts"))

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("all"))
        bodies = F.transform(F.slice("all", start + 1, stop - start), lambda t: t.body)
        return F.struct(F.get("all", start).role.alias("role"), F.array_join(bodies, NEXT).alias("body"))

    return rows.select(*kept, F.transform("starts", run).alias("turns"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted) for each conversation.

    Turns are sorted by (turn, role, text) as they came, before escaping, so ties have one order; a null turn comes first, null role and text are
    empty, a null conv_id is a conversation of its own, repeated rows are turns each. An empty table gives no rows.
    Other columns are not read.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("t"), said(role).alias("role"), said(text).alias("text"))
    part = rows.groupBy("conv_id", F.floor(F.col("t") / chunk).alias("part")).agg(F.sort_array(F.collect_list(F.struct("t", "role", "text"))).alias("turns"))
    part = _merged(part, F.transform("turns", lambda t: F.struct(escaped(t.role).alias("role"), escaped(t.text).alias("body"))))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("turns"))
    merged = _merged(whole, F.flatten(F.transform("turns", lambda p: p.turns)))
    return merged.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t.role, F.lit(TEXT), t.body, F.lit(END))), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the original turns, from the formatted string alone."""
    blocks = F.split(F.substring(formatted, len(TURN) + 1, 2147483647), r"<\|turn\|>")

    def turns(block: Column) -> Column:
        role = unescaped(F.split_part(block, F.lit(TEXT), F.lit(1)))
        body = F.split_part(F.split_part(block, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))
        return F.transform(F.split(body, r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_spans(formatted: Column, roles: tuple[str, ...] = LOSS_ROLES) -> Column:
    """array<struct<b, e>>: code points of the formatted string under the loss mask, end exclusive, one span for each text."""
    pieces = F.split(formatted, rf"(?<=<\|turn\|>)|(?<=<\|text\|>)|(?<=<\|next\|>)|(?=<\|(?:turn|text|next|end)\|>)|(?<=<\|end\|>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("mark"), F.expr("cast(array() as array<struct<b:bigint,e:bigint>>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s.at + F.length(p)
        mark = p.isin(TURN, TEXT, NEXT, END)
        text = ~mark & s.mark.isin(TEXT, NEXT) & s.role.isin(*roles)
        out = F.when(text, F.concat(s.out, F.array(F.struct(s.at.alias("b"), end.alias("e"))))).otherwise(s.out)
        return F.struct(end.alias("at"), F.when(p == TURN, F.lit("")).when(~mark & (s.mark == TURN), unescaped(p)).otherwise(s.role).alias("role"), F.when(mark, p).otherwise(s.mark).alias("mark"), out.alias("out"))

    return F.aggregate(pieces, start, step).out


def format_digest(formatted: DataFrame) -> DataFrame:
    """n_turns, digests of turns and of the text under the loss mask, and the formatted length, all read back from `formatted`."""
    f = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("loss"))
    f = f.withColumn("said", F.array_join(F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), (x.b + 1).cast("int"), (x.e - x.b).cast("int")))), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return f.select(F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
