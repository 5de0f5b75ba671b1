"""Statistics and gates over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import stats as S
from sparkloom.plans.registry import query, table

TOP = 17


@query("""with r as (select c_nationkey as nation, sum(o_totalprice) / (count(*) * max(o_totalprice)) as mass, avg(c_acctbal) as balance from orders join customer on c_custkey = o_custkey group by c_nationkey)
  select nation, round(mass, 9) as mass, round(balance, 6) as balance, round(cast(0.4 as double) * mass + cast(0.6 as double) * balance / 10000, 9) as prior from r""")
def structural_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    found = rows.groupBy(F.col("c_nationkey").alias("nation")).agg((F.sum("o_totalprice") / (F.count("*") * F.max("o_totalprice"))).alias("mass"), F.avg("c_acctbal").alias("balance"))
    return found.select("nation", F.round("mass", 9).alias("mass"), F.round("balance", 6).alias("balance"), F.round(F.lit(0.4) * F.col("mass") + F.lit(0.6) * F.col("balance") / 10000, 9).alias("prior"))


@query("""with m as (select l_returnflag as flag, l_linestatus as status, l_linenumber as member, avg(l_extendedprice / l_quantity) as activation, count(*) as n from lineitem group by all)
  select flag, status, round(avg(activation), 6) as plain_mean, round(sum(n * activation) / sum(n), 6) as weighted_mean, cast(sum(n) as bigint) as n from m group by flag, status""")
def weighted_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("member"))
    members = members.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("activation"), F.count("*").alias("n"))
    return members.groupBy("flag", "status").agg(F.round(F.avg("activation"), 6).alias("plain_mean"), F.round(S.weighted_mean("activation", "n"), 6).alias("weighted_mean"), F.sum("n").alias("n"))


@query("""with c as (select event_type, user_id, count(*) as n from events group by all), t as (select event_type, sum(n) as total, count(*) as users from c group by event_type)
  select c.event_type, t.users as n, cast(t.total as bigint) as total, round(-sum(c.n / t.total * ln(c.n / t.total)) / ln(t.users), 9) as entropy from c join t using (event_type) group by c.event_type, t.users, t.total""")
def routing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    return S.entropy(counts, ["event_type"], "c").withColumn("entropy", F.round("entropy", 9))


@query("""with c as (select c_custkey as user_id, coalesce(n, 0) as n from customer left join (select user_id, count(*) as n from events group by user_id) e on e.user_id = c_custkey)
  select min(n) as minimum, max(n) as maximum, quantile_cont(n, 0.5) as median, round(quantile_cont(n, 0.95), 9) as p95, round(quantile_cont(n, 0.99), 9) as p99,
  case when quantile_cont(n, 0.5) <> 0 then round(max(n) / quantile_cont(n, 0.5), 9) end as max_to_median, round(stddev_pop(n) / avg(n), 9) as variation from c""")
def load_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    found = S.load_distribution(S.zero_filled(counts, "user_id", "n", users), "n")
    return found.select("minimum", "maximum", "median", *(F.round(c, 9).alias(c) for c in ("p95", "p99", "max_to_median", "variation")))


@query("""with c as (select l_suppkey as supplier, count(*) as slots from lineitem group by all) select supplier, slots, cast(row_number() over (order by slots desc, supplier) as bigint) as place from c
  order by slots desc, supplier limit 10""")
def busiest_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("slots")).orderBy(F.desc("slots"), "supplier").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("slots"), "supplier")).cast("long"))  # ten rows


@query("""with s as (select event_type, list_sort(list(value)) as v from events where value is not null group by event_type)
  select event_type, v[cast(floor((len(v) - 1) * 0.01) as int) + 1] as p1, v[cast(floor((len(v) - 1) * 0.05) as int) + 1] as p5, v[cast(floor((len(v) - 1) * 0.5) as int) + 1] as p50, v[cast(floor((len(v) - 1) * 0.95) as int) + 1] as p95 from s""")
def lower_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lower_percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95})


@query("""with r as (select s_suppkey, s_nationkey, rank() over (order by s_nationkey) + (count(*) over (partition by s_nationkey) - 1) / 2.0 as avg_rank, count(*) over () as n from supplier)
  select s_suppkey, s_nationkey, cast(avg_rank as double) as avg_rank, round(cast((avg_rank - 1) / (n - 1) as double), 9) as rank_norm from r""")
def avg_rank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.average_ranks(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey")
    return found.select("s_suppkey", "s_nationkey", F.col("avg_rank").cast("double").alias("avg_rank"), F.round(F.col("rank_norm").cast("double"), 9).alias("rank_norm"))


@query("""with c as (select event_type, user_id, sum(case when day(ts) <= 15 then 1 else 0 end) as a, sum(case when day(ts) > 15 then 1 else 0 end) as b from events group by all),
  r as (select *, rank() over (partition by event_type order by a) + (count(*) over (partition by event_type, a) - 1) / 2.0 as ra, rank() over (partition by event_type order by b) + (count(*) over (partition by event_type, b) - 1) / 2.0 as rb from c)
  select event_type, count(*) as n, case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then round(corr(ra, rb), 9) end as rho from r group by event_type""")
def spearman_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.dayofmonth("ts") <= 15
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count_if(half).alias("a"), F.count_if(~half).alias("b"))
    return S.spearman(counts, "a", "b", ["event_type"]).withColumn("rho", F.round("rho", 9))


@query(f"""with c as (select day(ts) <= 15 as half, user_id, count(*) as n from events group by all), r as (select *, row_number() over (partition by half order by n desc, user_id) as k from c),
  a as (select user_id from r where half and k <= {TOP}), b as (select user_id from r where not half and k <= {TOP}),
  d as (select (select count(*) from a where user_id not in (select user_id from b)) as gone, (select count(*) from b where user_id not in (select user_id from a)) as new)
  select gone, new, (gone + new) // 2 as churn from d""")
def topn_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("half", F.dayofmonth("ts") <= 15)
    counts = events.groupBy("half", "user_id").agg(F.count("*").alias("n"))
    top = lambda side: counts.where(side).orderBy(F.desc("n"), "user_id").limit(TOP)
    return S.churn(top(F.col("half")), top(~F.col("half")), "user_id")


_STAGES = f"""
u as (select event_type, user_id, sum(case when hour(ts) < 6 then 1 else 0 end) as c1, sum(case when hour(ts) < 12 then 1 else 0 end) as c2, sum(case when hour(ts) < 18 then 1 else 0 end) as c3, count(*) as c4 from events group by all),
p as (select 2 as stage, event_type, user_id, c1 as a, c2 as b from u union all select 3, event_type, user_id, c2, c3 from u union all select 4, event_type, user_id, c3, c4 from u),
r as (select *, rank() over (partition by stage, event_type order by a) + (count(*) over (partition by stage, event_type, a) - 1) / 2.0 as ra, rank() over (partition by stage, event_type order by b) + (count(*) over (partition by stage, event_type, b) - 1) / 2.0 as rb,
  row_number() over (partition by stage, event_type order by a desc, user_id) as ka, row_number() over (partition by stage, event_type order by b desc, user_id) as kb from p),
g as (select stage, event_type, count(*) as n, case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end as rho, sum(case when (ka <= {TOP}) <> (kb <= {TOP}) then 1 else 0 end) // 2 as churn from r group by all)
"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count_if(hour < 6).alias("c1"), F.count_if(hour < 12).alias("c2"), F.count_if(hour < 18).alias("c3"), F.count("*").alias("c4"))
    pairs = F.array(*(F.struct(F.lit(i + 1).alias("stage"), F.col(f"c{i}").alias("a"), F.col(f"c{i + 1}").alias("b")) for i in (1, 2, 3)))
    rows = users.select("event_type", "user_id", F.explode(pairs).alias("s")).select("event_type", "user_id", "s.*")
    group = ["stage", "event_type"]
    place = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(c), "user_id")) <= TOP
    churn = rows.withColumn("ka", place("a")).withColumn("kb", place("b")).groupBy(*group).agg(F.expr("count_if(ka <> kb) div 2").alias("churn"))
    return S.spearman(rows, "a", "b", group).join(churn, group)


@query(f"with {_STAGES} select stage, event_type, n, round(rho, 9) as rho, cast(churn as bigint) as churn, coalesce(rho >= 0.6 and churn <= 14, false) as pass from g")
def stage_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).select("stage", "event_type", "n", F.round("rho", 9).alias("rho"), "churn", (S.at_least("rho", 0.6) & (F.col("churn") <= 14)).alias("pass"))


@query(f"with {_STAGES}, s as (select stage, bool_and(coalesce(rho >= 0.6 and churn <= 14, false)) as ok from g group by stage) select min(case when ok then stage end) as accepted, count(*) as stages from s")
def stage_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = _stages(spark, sf_dir).groupBy("stage").agg(F.bool_and(S.at_least("rho", 0.6) & (F.col("churn") <= 14)).alias("ok"))
    return S.first_accepted(passed, "stage", F.col("ok"))


@query("""with v as (select c_nationkey as nation, round(avg(c_acctbal), 6) as r, count(*) as customers, round(avg(c_acctbal), 6) * cast(0.4 as double) + count(*) * cast(0.6 as double) as p from customer group by c_nationkey)
  select nation, round(p, 6) as p, cast(row_number() over (order by r desc, nation) as bigint) as rank_r, cast(row_number() over (order by customers desc, r desc, nation) as bigint) as rank_i, cast(row_number() over (order by round(p, 6) desc, customers desc, r desc, nation) as bigint) as rank_p from v""")
def three_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 6).alias("r"), F.count("*").alias("i"))
    v = v.withColumn("p", F.round(F.col("r") * F.lit(0.4) + F.col("i") * F.lit(0.6), 6))
    # a row for each nation, so one task holds them all
    rank = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long")
    return v.select("nation", "p", rank(F.desc("r"), "nation").alias("rank_r"), rank(F.desc("i"), F.desc("r"), "nation").alias("rank_i"), rank(F.desc("p"), F.desc("i"), F.desc("r"), "nation").alias("rank_p"))


@query("""select l_returnflag as flag, l_linestatus as status, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_discounted, round(avg(l_discount), 9) as avg_discount, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) as discount_share, count(*) as n
  from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by all""")
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_discounted"), F.round(F.avg("l_discount"), 9).alias("avg_discount"), F.round(S.weighted_mean("l_discount", "l_extendedprice"), 9).alias("discount_share"), F.count("*").alias("n"))
