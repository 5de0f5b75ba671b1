"""Vector costs over embeddings, remapping over nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import vectors as V
from sparkloom.plans.registry import query, table

_PAIRS = """p as (select a.vec_id as query_id, b.vec_id as row_id, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine,
  list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as l2
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)"""


def _costs(spark: SparkSession, sf_dir: str, *measures: str, least: int | None = None) -> DataFrame:
    """The stated query set (ids divisible by 50) against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return V.pair_costs(rows.where(F.col("vec_id") % 50 == 0), rows, "vec_id", "embedding", measures, least)


@query(f"with {_PAIRS} select query_id, row_id, round(cosine, 6) as cosine from p")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir, "cosine").select("query_id", "row_id", F.round("cosine", 6).alias("cosine"))


@query(f"with {_PAIRS} select query_id, row_id, round(l2, 6) as l2 from p")
def l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir, "l2").select("query_id", "row_id", F.round("l2", 6).alias("l2"))


@query(f"with {_PAIRS}, r as (select *, row_number() over (partition by query_id order by round(cosine, 12), row_id) as k from p) select query_id, row_id, round(cosine, 6) as cost from r where k = 1")
def nearest_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(_costs(spark, sf_dir, "cosine", least=12), "cosine").select("query_id", "row_id", F.round("cost", 6).alias("cost"))


@query(f"""with {_PAIRS}, r as (select *, row_number() over (partition by query_id order by round(cosine, 12), row_id) as kc, row_number() over (partition by query_id order by round(l2, 12), row_id) as kl from p),
  n as (select query_id, min(case when kc = 1 then row_id end) as by_cosine, min(case when kl = 1 then row_id end) as by_l2 from r group by query_id)
  select count(*) as queries, cast(sum(case when by_cosine <> by_l2 then 1 else 0 end) as bigint) as changed from n""")
def metric_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _costs(spark, sf_dir, "cosine", "l2", least=12)
    both = costs.groupBy("query_id").agg(V.least_row("cosine").alias("c"), V.least_row("l2").alias("l"))
    return both.agg(F.count("*").alias("queries"), F.count_if(F.col("c.row_id") != F.col("l.row_id")).alias("changed"))


# ---- remapping: identifiers are nations, those of regions 0 to 2 survive -----------------------------------------------


def nation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old, new, cost): squared distance of the mean balances of a nation and of a survivor."""
    means = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("old")).agg(F.avg("c_acctbal").alias("x"), F.avg(F.abs("c_acctbal")).alias("y"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("old"), "n_regionkey").join(means, "old", "left").fillna(0.0, ["x", "y"])
    kept = nations.where("n_regionkey < 3").select(F.col("old").alias("new"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return nations.join(F.broadcast(kept)).select("old", "new", ((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2).alias("cost"))  # 25 nations


def slot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six distinct nations for each customer."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.col("c_custkey") + i * 4, F.lit(25)).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", slots.alias("slots"))


def survivors(spark: SparkSession, sf_dir: str) -> list[int]:
    return sorted(r[0] for r in table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long")).collect())


@query()
def greedy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefs = V.preference_orders(nation_costs(spark, sf_dir), "old", "new", "cost")
    done = V.greedy_remap(slot_rows(spark, sf_dir), "slots", survivors(spark, sf_dir), prefs, "old")
    return done.select("c_custkey", "slots", "remapped", "replaced", "avoided", V.unequal_positions("slots", "remapped").cast("long").alias("changed"))


@query()
def optimal_remap_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = {(r.old, r.new): r.cost for r in nation_costs(spark, sf_dir).collect()}  # 25 nations
    found = V.optimal_costs(slot_rows(spark, sf_dir), "slots", survivors(spark, sf_dir), costs)
    return slot_rows(spark, sf_dir).groupBy("slots").agg(F.count("*").alias("rows")).join(found, "slots").select("slots", "rows", F.round("optimal_cost", 6).alias("optimal_cost"))


@query("""with v as (select vec_id, unnest(range(0, len(embedding))) as position, unnest(embedding)::double as value from embeddings),
  r as (select *, row_number() over (partition by vec_id order by value desc, position) as rank from v where value is not null)
  select vec_id, rank, position, value from r where rank <= 5""")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.explode(V.top_components("embedding", 5)).alias("x")
    return table(spark, sf_dir, "embeddings").select("vec_id", best).select("vec_id", "x.rank", "x.position", "x.value")
