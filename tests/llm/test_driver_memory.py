"""What grows with the documents does not pass through the driver."""

from sparkloom.llm.shared import connected_components
from sparkloom.llm.simhash_dedup import simhash_components


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    kind = type(edges)
    whole = kind.checkpoint

    def checkpoint(self, *args, **options):
        done = whole(self, *args, **options)
        plans.append(final_plan(self))
        return done

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == dict.fromkeys(range(41), 0)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_simhash_components_broadcast_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i // 2} and more of {i // 2}") for i in range(60)], "doc_id long, text string")
    found = simhash_components(docs, shingle_words=4, max_bits=4)
    of = {r.doc_id: r.component_id for r in found.collect()}
    assert len(of) == 60 and all(of[i] == of[i - i % 2] for i in range(60))
    assert "Broadcast" not in final_plan(found)
