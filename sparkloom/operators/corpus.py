"""Corpus building: line pools, token chunks, seeded order, weighted interleaving, cumulative stages.

Running totals are two-level: over blocks of a category's sequence first, then over block totals, so that no task holds a whole
category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranges import ranged_sums

#: What sends a line to the structured pool; fixed value.
STRUCTURED = r"(?i)(\bjson\b|\byaml\b|\bxml\b|\bschema\b|\bapi\b|tool call|function call|arguments|markdown table|\|[^\n]+\|)"


def split_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line that is not blank, trimmed of Unicode white space, with its number in the text (from 0)."""
    pieces = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, r"\R|[\x1c-\x1e]")).alias("line_no", "line"))
    return pieces.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")


def pooled(lines: DataFrame, category: str, line: str = "line", routed: list[str] | None = None) -> DataFrame:
    """Lines of the `routed` categories (None: all) that look structured go to the pool 'structured', in the same scan."""
    hit = F.col(line).rlike(STRUCTURED)
    if routed is not None:
        hit = hit & F.col(category).isin(*routed)
    return lines.withColumn("pool", F.when(hit, "structured").otherwise(F.col(category)))


def token_chunks(rows: DataFrame, text: str, size: int) -> DataFrame:
    """White-space tokens in pieces of `size`: chunk_no, n_tokens, chunk; blank pieces are dropped."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    rows = rows.withColumn("__tokens", tokens)
    starts = F.when(F.size("__tokens") > 0, F.sequence(F.lit(0), F.expr(f"(size(__tokens) - 1) div {size}")))
    out = rows.withColumn("chunk_no", F.explode(starts))
    piece = F.slice("__tokens", F.col("chunk_no") * size + 1, F.lit(size))
    return out.withColumn("n_tokens", F.size(piece)).withColumn("chunk", F.array_join(piece, " ")).drop("__tokens", text)


def shuffle_key(seed: int, key: Column) -> Column:
    """A seeded order that any engine reproduces: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def interleaved(items: DataFrame, category: str, order: list[str], tokens: str, weights: dict[str, float], target: int) -> DataFrame:
    """Weighted deficit round-robin as one sort.

    Taking the next item of the category with the smallest tokens / weight (ties by name) until the target is reached
    equals ordering all items by (tokens before in the category / weight, category, place) and stopping at the running total.
    exhausted marks rows behind the first place where a category had run out.
    """
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    rows = items.where(F.col(category).isin(*weights)).withColumn("__w", weight[F.col(category)])
    place = Window.partitionBy(category).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(place)).withColumn("__before", F.coalesce(F.sum(tokens).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("virtual_time", F.col("__before") / F.col("__w"))
    ends = rows.groupBy(category).agg((F.sum(tokens) / F.max("__w")).alias("__end"))
    stop = ends.agg(F.min(F.struct("__end", category)).alias("__stop"))
    rows = rows.crossJoin(F.broadcast(stop))  # one row: where the first category runs out
    rows = rows.withColumn("exhausted", F.struct("virtual_time", category) > F.struct(F.col("__stop.__end"), F.col(f"__stop.{category}")))
    rows = running_total(rows, ["virtual_time", category, "place"], tokens, "total")
    return rows.where(F.col("total") - F.col(tokens) < target).drop("__w", "__before", "__stop")


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum over all rows in a total order, by ranges and then over the ranges' totals."""
    return ranged_sums(rows, order, value, 0).withColumnRenamed("__sum", name)


def stage_counts(sequence: DataFrame, category: str, tokens: str, total: str, stages: dict[str, int]) -> DataFrame:
    """For each stage the tokens of every category up to the first row whose running total reaches the stage's threshold.

    stages: name -> threshold, a fixed short list. Stages that the sequence does not reach are left out.
    """
    sums = [F.min(F.when(F.col(total) >= t, F.col(total))).alias(n) for n, t in stages.items()]
    ends = sequence.agg(*sums).select(F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(t).alias("threshold"), F.col(n).alias("end")) for n, t in stages.items()))).alias("s")).select("s.*").where("end is not null")
    inside = sequence.join(F.broadcast(ends), F.col(total) <= F.col("end"))
    out = inside.groupBy("stage", "threshold", category).agg(F.sum(tokens).alias("tokens"), F.max("end").alias("stage_tokens"))
    return out.withColumn("ratio", F.col("tokens") / F.col("stage_tokens"))
