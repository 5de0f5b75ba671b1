"""Digests, lineage and bit packing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.plans.registry import query, table


@query("""with parent as (select n_nationkey, sha256(n_nationkey || '|' || n_name) as digest from nation),
  child as (select c_custkey, c_nationkey, sha256(c_nationkey || '|' || n.n_name) as claimed from customer join nation n on n.n_nationkey = case when c_custkey % 100 = 7 then (c_nationkey + 1) % 25 else c_nationkey end)
  select c_nationkey as nation, count(*) as children, cast(sum(case when claimed = digest then 0 else 1 end) as bigint) as broken from child join parent on n_nationkey = c_nationkey group by c_nationkey""")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children name their parent's digest; every hundredth names the wrong one."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    digest = lambda key: F.sha2(F.concat_ws("|", key, "n_name"), 256)
    parent = nations.select("n_nationkey", digest("n_nationkey").alias("digest"))
    named = F.when(F.col("c_custkey") % 100 == 7, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    child = table(spark, sf_dir, "customer").withColumn("named", named).join(F.broadcast(nations), F.col("n_nationkey") == F.col("named"))  # 25 nations
    child = child.select("c_nationkey", digest("c_nationkey").alias("claimed")).join(F.broadcast(parent), F.col("c_nationkey") == F.col("n_nationkey"))
    return child.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("children"), F.count_if(F.col("claimed") != F.col("digest")).alias("broken"))


@query("""with b as (select event_id, (event_id * 37 + user_id) % 256 as byte from events) select byte, byte & 15 as low, byte >> 4 as high, ((byte & 15) << 4) | (byte >> 4) as swapped, count(*) as n, min(event_id) as first_event from b group by byte""")
def nibble_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 + F.col("user_id")) % 256).alias("byte"))
    low, high = X.nibbles("byte")
    return rows.groupBy("byte", low.alias("low"), high.alias("high"), X.packed_nibbles(high, low).alias("swapped")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""with e as (select event_id // 32 as block, (event_id * 7 + user_id) % 256 as exponent from events) select exponent, count(*) as blocks, exponent >= 128 as high, pow(2, exponent - 127) as scale from e group by exponent order by exponent desc limit 16""")
def exponent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(((F.col("event_id") * 7 + F.col("user_id")) % 256).alias("exponent"))
    counts = rows.groupBy("exponent").agg(F.count("*").alias("blocks"))
    return counts.orderBy(F.desc("exponent")).limit(16).withColumn("high", F.col("exponent") >= 128).withColumn("scale", X.e8m0_scale("exponent"))


@query("""select doc_id, sha1(('blob ' || strlen(text))::blob || '\\x00'::blob || encode(text)) as blob_sha1 from documents""")
def git_blob_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.git_blob_sha1("text").alias("blob_sha1"))


@query("""with a as (select part.p_brand as brand, min(p_size) as least, max(p_size) as most, count(*) as n from part group by p_brand), b as (select distinct p_brand as brand from part join lineitem on p_partkey = l_partkey)
  select a.brand, least, most, n, b.brand is not null as sold, ((n + 4095) // 4096) * 4096 as aligned from a left join b using (brand)""")
def catalog_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.operators.shards import aligned

    parts = table(spark, sf_dir, "part")
    brands = parts.groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.count("*").alias("n"))
    sold = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand")).distinct().withColumn("s", F.lit(True))
    return brands.join(sold, "brand", "left").select("brand", "least", "most", "n", F.coalesce("s", F.lit(False)).alias("sold"), aligned("n", 4096).alias("aligned"))
