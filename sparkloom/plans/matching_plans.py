"""Matches with evidence, grids, zips, complements and tolerances over parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import matching as M
from sparkloom.operators.provenance import merged_catalogs
from sparkloom.plans.registry import query, table


@query("""with u as (select round(p_retailprice, 0) as v, min(p_partkey) as part from part where p_retailprice is not null group by 1 having count(*) = 1),
  w as (select round(o_totalprice / 100, 0) as v, min(o_orderkey) as match from orders group by 1 having count(*) = 1)
  select part, match from u join w using (v)""")
def scalar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round("p_retailprice", 0).alias("v"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("part"), F.round(F.col("o_totalprice") / 100, 0).alias("v"))
    return M.unique_scalar_match(left, right, "part", "v")


@query("""with u as (select round(p_retailprice, 0) as v, min(p_partkey) as part from part where p_retailprice is not null group by 1 having count(*) = 1),
  w as (select round(o_totalprice / 100, 0) as v, min(o_orderkey) as match from orders group by 1 having count(*) = 1), s as (select part, match from u join w using (v)),
  f as (select l_partkey as part, min(l_orderkey) as match from lineitem where l_quantity >= 45 group by 1)
  select p_partkey as part, coalesce(s.match, f.match) as match, case when s.match is not null then 'scalar' when f.match is not null then 'order' end as evidence
  from part left join s on s.part = p_partkey left join f on f.part = p_partkey""")
def match_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_order = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_orderkey").alias("match"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    return M.with_fallback(keys, "part", [("scalar", scalar_match(spark, sf_dir)), ("order", by_order)])


@query("""with e as (select n_nationkey as nation, s as status from nation, (values ('F'), ('O'), ('X')) v(s)), f as (select c_nationkey as nation, o_orderstatus as status, count(*) as n from orders join customer on c_custkey = o_custkey group by all)
  select coalesce(e.nation, f.nation) as nation, coalesce(e.status, f.status) as status, case when n is null then 'missing' when e.nation is null then 'unexpected' when n > 1 then 'repeated' else 'ok' end as found
  from e full join f on e.nation = f.nation and e.status = f.status""")
def expectation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    expected = M.grid(nations, spark.createDataFrame([("F",), ("O",), ("X",)], "state string"))
    seen = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("state"))
    return M.against_grid(expected, seen, ["nation", "state"]).select("nation", F.col("state").alias("status"), F.col("status").alias("found"))


@query("""with p as (select l_orderkey as o, list(l_partkey order by l_linenumber, l_partkey) as a, list(l_suppkey order by l_linenumber desc, l_suppkey desc) as b from lineitem group by 1),
  z as (select o, unnest(range(0, len(a))) as position, a, b from p) select o as order_key, position, a[position + 1] as part, b[position + 1] as supplier from z""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key"))
    up = lines.agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")), asc=False).alias("b"))
    both = up.select("order_key", F.explode(M.zipped(F.col("a.l_partkey"), F.col("b.l_suppkey"))).alias("z"))
    return both.select("order_key", "z.position", F.col("z.a").alias("part"), F.col("z.b").alias("supplier"))


@query("""with a as (select l_partkey as part, max(l_discount) as v from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as part, max(l_discount) as v from lineitem where l_returnflag = 'R' group by 1)
  select * from (select coalesce(a.part, b.part) as part, case when a.v is null and b.v is not null then 'right only' when a.v is not null and b.v is null then 'left only' when a.v <> b.v then 'differs' end as problem
  from a full join b on a.part = b.part) where problem is not null""")
def one_sided_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_discount").alias("v"))
    return M.one_sided(side("A"), side("R"), "part", "v")


@query("""select o_custkey as customer, o_orderdate as date, o_orderkey as order_key, o_totalprice as price from orders where o_totalprice > 150000
  qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1""")
def first_large_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"))
    return M.first_satisfying(rows, ["customer"], ["date", "order_key"], F.col("price") > 150000)


@query("""select p_partkey as part, p_type as kind from part where not (coalesce(p_size > 10, false) or coalesce(starts_with(p_brand, 'Brand#1'), false))""")
def predicate_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return M.complement(rows, F.col("p_size") > 10, F.col("p_brand").startswith("Brand#1")).select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind"))


@query("""select l_orderkey as order_key, l_linenumber as line, abs(l_discount - l_tax) > 0.0400000001 as beyond from lineitem""")
def tolerance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), M.beyond("l_discount", "l_tax", 0.0400000001).alias("beyond"))


@query("""select o_orderkey as order_key, o_orderkey // 60 as member, (o_orderkey // 12) % 5 as "row", o_orderkey % 12 as "column" from orders""")
def unraveled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), *M.unraveled("o_orderkey", 5, 12))


@query("""with a as (select l_orderkey as order_key, list(l_partkey order by l_linenumber, l_partkey) as p from lineitem group by 1)
  select order_key, array_to_string(list_distinct_in_order, ',') as sample, array_to_string(list_transform(range(0, 9), lambda i: p[i % len(p) + 1]), ',') as tiled from (
  select order_key, p, list_transform(list_filter([1, len(p) // 2 + 1, len(p)], lambda x, i: list_position([p[1], p[len(p) // 2 + 1], p[len(p)]], p[x]) = i), lambda x: p[x]) as list_distinct_in_order from a)""")
def sampled_and_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s")).select("order_key", F.col("s.l_partkey").alias("p"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return lists.select("order_key", text(scalars.first_middle_last("p")).alias("sample"), text(scalars.tiled("p", 9)).alias("tiled"))


@query("""with a as (select p_brand as name, 'base' as origin, count(*) as n from part where p_size <= 25 group by 1), b as (select p_brand as name, 'supplement' as origin, count(*) as n from part where p_size > 48 group by 1)
  select name, origin, n, name in (select name from a intersect select name from b) as clash from (select * from a union all select * from b)""")
def add_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = lambda keep: table(spark, sf_dir, "part").where(keep).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return merged_catalogs(brands("p_size <= 25"), brands("p_size > 48"))


@query("""with o as (select o_custkey as customer, o_orderkey as order_key, o_totalprice as price, lead(o_orderkey) over w as next_key, lead(o_totalprice) over w as next_price
  from orders window w as (partition by o_custkey order by o_orderkey)) select customer, order_key, next_key, next_price - price as change from o where next_key is not null""")
def consecutive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    both = M.consecutive(orders, ["customer"], ["key"], "price")
    return both.select("customer", F.col("key").alias("order_key"), "next_key", (F.col("next_price") - F.col("price")).alias("change"))
