"""The fitted lexicon of toxic words: against SQL, on labels it was not fitted on, and on hostile rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import oracles
from sparkloom.llm.quality_rules import LEAST_DOCUMENTS, keep_good, quality_rules, rule_order, toxic_lexicon, toxic_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_verdicts_equal_sql(spark, tables):
    docs, labels = tables
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(oracles.QUALITY)
    names = [c[0] for c in rel.description]
    got = {tuple(r[n] for n in names) for r in quality_rules(docs, lexicon=toxic_lexicon(docs, labels)).collect()}
    assert got == set(rel.fetchall())


def test_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    lexicon = toxic_lexicon(docs, labels.where(half == 0))
    rule = toxic_words(lexicon)
    other = docs.join(labels.where(half == 1), "doc_id")
    order = ["toxic_words"]
    kept = quality_rules(other, order=order, lexicon=lexicon).where("not base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = kept.groupBy("lang", "toxic").agg(F.avg((~F.col("kept")).cast("int")).alias("rejected")).collect()
    assert rule.__name__ == "toxic_words" and len(rows) == 8
    for r in rows:
        assert r.rejected >= 0.8 if r.toxic else r.rejected <= 0.03, r


def test_defined_results(spark):
    bad = "zorgal frump zorgit frump " + " ".join(f"b{i}x" for i in range(60))
    rows = [(i, bad + f" {i}", 1) for i in range(LEAST_DOCUMENTS)] + [(100 + i, " ".join(f"c{i}y{k}" for k in range(60)), 0) for i in range(9)]
    rows += [(200, None, 1), (201, "", 1), (None, bad, 1), (0, rows[0][1], 1)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows], "doc_id long, text string, toxic int, p int").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(0, 0), (1, None), (300, 1)], "doc_id long, toxic int")
    lexicon = toxic_lexicon(docs, labels)
    assert "zor" in lexicon and "fru" in lexicon and not any(x.startswith(("zor", "fru")) and len(x) > 3 for x in lexicon)
    rejected = {r.doc_id for r in quality_rules(docs, lexicon=lexicon).where("not kept and not base_failed").collect()}
    assert rejected == {*range(LEAST_DOCUMENTS), None}
    assert sorted(rule_order(docs.limit(0)))  # an empty table has an order too
    assert toxic_lexicon(docs.limit(0), labels) == toxic_lexicon(docs, labels.limit(0)) == toxic_lexicon(docs, labels.where("toxic = 0")) == []
    assert keep_good(docs, lexicon=lexicon).columns == docs.columns
    assert keep_good(docs.limit(0), lexicon=lexicon).collect() == []
    numbers = docs.withColumn("text", F.lit(12))
    assert keep_good(numbers).collect() == []
