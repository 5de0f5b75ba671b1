"""Consensus over customers: groups are nations, evidence comes from order priorities and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import consensus as C
from sparkloom.plans.registry import query, table

K = 20

_SCORED = """
scored as (
  select c_nationkey as nation, c_custkey as custkey,
         max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) = 1 as strong,
         max(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) = 1 as weak,
         case when c_nationkey >= 3 then max(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end) = 1 end as partial,
         c_acctbal > 5000 as rich, c_acctbal
  from customer left join orders on o_custkey = c_custkey
  group by c_nationkey, c_custkey, c_acctbal),
placed as (
  select *, row_number() over (partition by nation order by c_acctbal desc, custkey) - 1 as source_rank,
         case when strong then 2 when weak then 1 else 0 end + cast(coalesce(partial, false) as int) + cast(rich as int) as score
  from scored),
ranked as (
  select *, row_number() over (partition by nation order by score desc, cast(strong as int) desc, cast(weak as int) desc,
         cast(coalesce(partial, false) as int) desc, cast(rich as int) desc, source_rank, custkey) as rank
  from placed)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("custkey"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    # one pass over orders gives the member sets of all three sources
    flags = orders.groupBy("custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("s"), F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("w"), F.bool_or(F.col("o_orderpriority") == "3-MEDIUM").alias("p"))
    rows = customers.join(flags, "custkey", "left")
    no = F.lit(False)
    rows = rows.select("nation", "custkey", F.coalesce("s", no).alias("strong"), F.coalesce("w", no).alias("weak"), F.when(F.col("nation") >= 3, F.coalesce("p", no)).alias("partial"), (F.col("c_acctbal") > 5000).alias("rich"), "c_acctbal")
    place = F.row_number().over(C.Window.partitionBy("nation").orderBy(F.desc("c_acctbal"), "custkey")) - 1
    rows = rows.withColumn("source_rank", place).withColumn("score", C.tiered_score("strong", "weak", ["partial", "rich"]))
    order = [F.desc("score"), *(C.vote(v).desc() for v in ("strong", "weak", "partial", "rich")), F.asc("source_rank"), F.asc("custkey")]
    return C.ranked(rows, ["nation"], order, K)


@query(f"with {_SCORED} select nation, custkey, strong, weak, partial, rich, cast(score as bigint) as score, cast(rank as bigint) as rank, rank <= {K} as selected from ranked")
def consensus_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("nation", "custkey", "strong", "weak", "partial", "rich", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"), "selected")


@query(f"""with {_SCORED} select nation, cast(max(case when rank = {K} then score end) as bigint) as last_selected, cast(max(case when rank = {K + 1} then score end) as bigint) as first_deleted,
  max(case when rank = {K} then score end) = max(case when rank = {K + 1} then score end) as tie_crosses from ranked where rank in ({K}, {K + 1}) group by nation""")
def consensus_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.boundary(scored(spark, sf_dir).withColumn("score", F.col("score").cast("long")), ["nation"], K)


@query(f"with {_SCORED} select rank <= {K} as selected, cast(score as bigint) as score, count(*) as n from ranked group by all")
def consensus_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_histogram(scored(spark, sf_dir).withColumn("score", F.col("score").cast("long")))


@query("""select o_custkey as custkey, count(*) as orders from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey not in
  (select o_custkey from orders where o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) group by o_custkey""")
def nesting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    inner = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("custkey").agg(F.count("*").alias("orders"))
    outer = orders.where(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    return inner.join(outer.select("custkey").distinct(), "custkey", "left_anti")


@query("""with s as (select o_custkey, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) u, max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) h, count(*) n from orders group by o_custkey),
  r as (select c_nationkey as nation, c_custkey as custkey, u, h, coalesce(n, 0) as n, row_number() over (partition by c_nationkey order by coalesce(u, 0) + coalesce(h, 0) desc, coalesce(n, 0) desc, c_custkey) as rank
  from customer left join s on o_custkey = c_custkey) select nation, custkey, n as orders, cast(rank as bigint) as rank from r where rank <= 5""")
def consensus_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("u"), F.max((F.col("o_orderpriority") == "2-HIGH").cast("int")).alias("h"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("custkey")).join(orders, "custkey", "left").fillna(0, ["u", "h", "n"])
    return C.top_k(rows, ["nation"], [(F.col("u") + F.col("h")).desc(), F.desc("n"), F.asc("custkey")], 5).select("nation", "custkey", F.col("n").alias("orders"), F.col("rank").cast("long").alias("rank"))


@query("""with v as (select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)),
  r as (select *, case when quality = 1 then 2 else 0 end + case when toxic = 0 then 1 else 0 end as score from v)
  select lang, score, count(*) as n, cast(sum(case when quality is null then 1 else 0 end) as bigint) as uncovered from r group by lang, score""")
def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    score = C.vote(F.col("quality") == 1) * 2 + C.vote(F.col("toxic") == 0)
    return docs.groupBy("lang", score.alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("uncovered"))
