"""Overlap, reconciliation, contracts and dense ids over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import checks as K
from sparkloom.operators import sets as S
from sparkloom.plans.registry import query, table


@query("""with m as (select distinct c_nationkey as nation, o_orderpriority as source, c_custkey as member from orders join customer on c_custkey = o_custkey),
  s as (select nation, source, count(*) n from m group by all),
  x as (select a.nation, a.source as a, b.source as b, count(*) as common from m a join m b on a.nation = b.nation and a.member = b.member and a.source < b.source group by all)
  select x.nation, x.a, x.b, x.common, sa.n as n_a, sb.n as n_b, sa.n + sb.n - x.common as combined, round(x.common / (sa.n + sb.n - x.common), 8) as jaccard, x.common = sa.n as a_in_b
  from x join s sa on sa.nation = x.nation and sa.source = x.a join s sb on sb.nation = x.nation and sb.source = x.b""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    members = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("source"), F.col("c_custkey").alias("member"))
    return S.overlap(members, "nation", "source", "member")


@query("""select l_orderkey as orderkey, count(*) as n, cast(min(l_linenumber) as bigint) as least, cast(max(l_linenumber) as bigint) as most, count(distinct l_linenumber) as distinct_numbers,
  min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as contiguous from lineitem group by l_orderkey""")
def mask_contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contiguity(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber"), ["orderkey"], "l_linenumber", 1)


@query("""select conv_id, count(*) as n, min(turn) as least, max(turn) as most, count(distinct turn) as distinct_numbers, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous
  from conversations group by conv_id""")
def conversation_turn_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contiguity(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing' else 'extra' end as state
  from (select distinct doc_id from documents) d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null""")
def namespace_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""with p as (select p_brand as brand, p_partkey as old_id, row_number() over (partition by p_brand order by p_partkey) - 1 as new_id from part)
  select brand, l_partkey as old_id, new_id, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem join p on old_id = l_partkey group by all""")
def dense_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.dense_ids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("old_id")), ["brand"], "old_id")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("old_id")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return lines.join(parts, "old_id").select("brand", "old_id", F.col("new_id").cast("long").alias("new_id"), "lines", "quantity")


@query("""with g as (select l_orderkey, count(*) as n, count(distinct l_linenumber) as d, list_sort(list(distinct l_linenumber)) as slots from lineitem group by l_orderkey)
  select n as entries, d as slots, count(*) as orders, cast(sum(case when slots = range(1, n + 1) then 1 else 0 end) as bigint) as complete, cast(sum(n - d) as bigint) as surplus from g group by n, d""")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("entries"), F.sort_array(F.collect_set("l_linenumber")).alias("s"))
    groups = groups.withColumn("slots", F.size("s").cast("long"))
    whole = F.col("s") == F.sequence(F.lit(1), F.col("entries").cast("int"))
    return groups.groupBy("entries", "slots").agg(F.count("*").alias("orders"), F.count_if(whole).alias("complete"), F.sum(F.col("entries") - F.col("slots")).alias("surplus"))


@query("""select case when c.k = 1 then 'low' when c.k = 2 then 'high' end as policy, brands, parts from
  (select case when p_size <= 10 then 1 when p_size >= 40 then 2 else 3 end as k, count(distinct p_brand) as brands, count(*) as parts from part group by 1) c""")
def policy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = F.when(F.col("p_size") <= 10, "low").when(F.col("p_size") >= 40, "high")
    return table(spark, sf_dir, "part").groupBy(policy.alias("policy")).agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("parts"))


@query("""with wanted(name, position) as (values ('JAPAN', 0), ('BRAZIL', 1), ('nation3', 2), ('NATION_7', 3), ('nowhere', 4))
  select w.position, w.name, n.n_nationkey from wanted w left join nation n on lower(n.n_name) = lower(w.name)""")
def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["JAPAN", "BRAZIL", "nation3", "NATION_7", "nowhere"]
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(n) for n in names))).alias("position", "name"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("key"))
    return wanted.join(nations, F.lower("name") == F.col("key"), "left").select("position", "name", "n_nationkey")


_CHECKS = """
checks as (
  select 'order_lines_contiguous' as name, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as ok from lineitem group by l_orderkey
  union all select 'turns_contiguous', min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) from conversations group by conv_id
  union all select 'label_has_document', doc_id in (select doc_id from documents) from labels
  union all select 'discount_in_range', l_discount between 0 and 0.1 from lineitem)
"""


def _all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, labels = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "labels")
    known = table(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("known", F.lit(True))
    return K.all_checks(
        K.check(S.contiguity(lines, ["l_orderkey"], "l_linenumber", 1), "order_lines_contiguous", "l_orderkey", F.col("contiguous")),
        K.check(S.contiguity(table(spark, sf_dir, "conversations"), ["conv_id"], "turn"), "turns_contiguous", "conv_id", F.col("contiguous")),
        K.check(labels.join(known, "doc_id", "left"), "label_has_document", "doc_id", F.col("known")),
        K.check(lines, "discount_in_range", "l_orderkey", F.col("l_discount").between(0, 0.1)),
    )


@query(f"with {_CHECKS} select name as \"check\", count(*) as rows, cast(sum(case when ok then 0 else 1 end) as bigint) as failures, case when bool_and(ok) then 'PASS' else 'FAIL' end as status from checks group by name")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(_all_checks(spark, sf_dir))


@query(f"with {_CHECKS} select bool_and(ok) as all_ok, cast(sum(case when ok then 0 else 1 end) as bigint) as failures from checks")
def verification_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.verdict(_all_checks(spark, sf_dir))
