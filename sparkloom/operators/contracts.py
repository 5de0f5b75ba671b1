"""Contracts on plans, scores, inventories and repacked payloads, as check tables (see checks.py)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.codecs import MXFP4_BLOCK, mxfp4_repacked
from sparkloom.operators.checks import all_checks, check


def mask_contract(masks: DataFrame, layers: int, lowest: int, highest: int) -> DataFrame:
    """masks (source_id, declared_k, layer, experts array<int>): canonical order, size, range; every layer covered."""
    e = F.col("experts")
    key = F.concat_ws(":", "source_id", "layer")
    covered = masks.groupBy("source_id").agg(F.countDistinct("layer").alias("n"), F.min("layer").alias("a"), F.max("layer").alias("b"))
    return all_checks(
        check(masks, "size", key, F.size(e) == F.col("declared_k")),
        check(masks, "canonical", key, e == F.array_sort(F.array_distinct(e))),
        check(masks, "range", key, F.forall(e, lambda x: x.between(lowest, highest))),
        check(covered, "layers", "source_id", (F.col("n") == layers) & (F.col("a") == 0) & (F.col("b") == layers - 1)),
    )


def score_contract(scores: DataFrame, universe: int, selected: int, highest: int) -> DataFrame:
    """scores (layer, expert_id, score, rank, selected): whole layers, ranks 1..n once each, the flag follows the rank, scores in range."""
    by = scores.groupBy("layer").agg(
        F.count("*").alias("n"), F.countDistinct("expert_id").alias("ids"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("a"), F.max("rank").alias("b"),
        F.count_if("selected").alias("s"), F.bool_and(F.col("selected") == (F.col("rank") <= selected)).alias("flag"), F.bool_and(F.col("score").between(0, highest)).alias("span"),
    )
    return all_checks(
        check(by, "rows", "layer", F.col("n") == universe),
        check(by, "unique_ids", "layer", F.col("ids") == F.col("n")),
        check(by, "ranks", "layer", (F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("ranks") == F.col("n"))),
        check(by, "selected", "layer", (F.col("s") == selected) & F.col("flag")),
        check(by, "score_range", "layer", F.col("span")),
    )


def plan_contract(plan: DataFrame, scores: DataFrame, parent: DataFrame) -> DataFrame:
    """plan and parent (layer, expert): the plan is within its parent and keeps exactly the selected ids."""
    inside = plan.join(parent.select("layer", "expert").distinct().withColumn("p", F.lit(True)), ["layer", "expert"], "left")
    chosen = scores.where("selected").select("layer", F.col("expert_id").alias("expert"), F.lit(True).alias("s"))
    both = plan.select("layer", "expert", F.lit(True).alias("k")).join(chosen, ["layer", "expert"], "full")
    key = F.concat_ws(":", "layer", "expert")
    return all_checks(check(inside, "within_parent", key, F.col("p")), check(both, "equals_selection", key, F.col("k") & F.col("s")))


def routing_contract(rows: DataFrame, table: str, width: int, experts: int) -> DataFrame:
    """rows (token_id, `table` array<int>): width, range, no id twice in a row."""
    t = F.col(table)
    return all_checks(
        check(rows, "width", "token_id", F.size(t) == width),
        check(rows, "range", "token_id", F.forall(t, lambda x: x.between(0, experts - 1))),
        check(rows, "distinct", "token_id", F.size(F.array_distinct(t)) == F.size(t)),
    )


def inventory(names: DataFrame, expert_pattern: str, kept: DataFrame, dropped_prefix: str) -> DataFrame:
    """(source, dropped, skipped, expected): names (name) less experts outside `kept` (layer, expert) and less those under a prefix.

    expert_pattern captures layer and expert.
    """
    number = lambda i: F.nullif(F.regexp_extract("name", expert_pattern, i), F.lit("")).cast("int")
    rows = names.select("name", number(1).alias("layer"), number(2).alias("expert"), F.col("name").startswith(dropped_prefix).alias("skip"))
    rows = rows.join(kept.select("layer", "expert").distinct().withColumn("kept", F.lit(True)), ["layer", "expert"], "left")
    gone = F.col("expert").isNotNull() & F.col("kept").isNull() & ~F.col("skip")
    return rows.agg(F.count("*").alias("source"), F.count_if(gone).alias("dropped"), F.count_if("skip").alias("skipped")).withColumn("expected", F.col("source") - F.col("dropped") - F.col("skipped"))


def policy_types(names: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """names with `planned`: the type of the first rule (pattern, type) that matches, else the default."""
    planned: Column = F.lit(default)
    for pattern, kind in reversed(rules):
        planned = F.when(F.col("name").rlike(pattern), kind).otherwise(planned)
    return names.withColumn("planned", planned)


def dry_run_contract(log: DataFrame, names: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """log (position, count, name, target): one line for each tensor, numbered 1..count, with the planned type."""
    both = policy_types(names, rules, default).join(log, "name", "full")
    whole = log.agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b"), F.max("count").alias("c"))
    return all_checks(
        check(both, "planned_type", "name", F.col("planned") == F.col("target")),
        check(whole, "numbering", F.lit("log"), (F.col("a") == 1) & (F.col("b") == F.col("c")) & (F.col("d") == F.col("n")) & (F.col("n") == F.col("c"))),
    )


def repack_contract(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (key, weights, scales, rows) in packed nibbles, target (key, data) in 17-byte blocks: repacked, the bytes are equal."""

    @F.pandas_udf("binary")
    def repacked(weights: pd.Series, scales: pd.Series, rows: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([mxfp4_repacked(np.frombuffer(w, dtype=np.uint8).reshape(n, -1), np.frombuffer(s, dtype=np.uint8).reshape(n, -1)) for w, s, n in zip(weights, scales, rows, strict=True)])

    made = source.select("key", repacked("weights", "scales", "rows").alias("made"))
    both = made.join(target.select("key", "data"), "key", "full")
    return all_checks(
        check(both, "same_keys", "key", F.col("made").isNotNull() & F.col("data").isNotNull()),
        check(both, "whole_blocks", "key", F.octet_length("data") % MXFP4_BLOCK == 0),
        check(both, "bytes", "key", F.col("made") == F.col("data")),
    )


def accepted(reports: DataFrame, required: list[str]) -> DataFrame:
    """One row: whether every required report (name, status) is there and passes, and which do not."""
    wanted = reports.sparkSession.createDataFrame([(r,) for r in required], "name string")
    both = wanted.join(reports, "name", "left")
    bad = F.sort_array(F.collect_list(F.when(~F.coalesce(F.col("status") == "PASS", F.lit(False)), F.col("name"))))
    return both.agg(bad.alias("failing")).withColumn("status", F.when(F.size("failing") == 0, "PASS").otherwise("FAIL"))
