"""Joins whose small side the planner takes for smaller than it is."""

import random

from policylake.llm import simhash
from policylake.session import materialize


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if name in plan]


def test_copies_of_fingerprints_are_not_broadcast(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    prints += [p ^ 0b1011 for p in prints[:20]]
    links = simhash.links(materialize(spark.createDataFrame([(p,) for p in prints], "fp long")))
    assert joins(links) == ["SortMergeJoin"]
    want = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert len(want) == 20 and {tuple(r) for r in links.collect()} == want


def test_keys_of_kept_documents_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of a few") for i in range(40)], "doc_id int, text string")
    kept = simhash.keep_one(docs)
    assert joins(kept) == ["SortMergeJoin"]
    assert kept.count() == len({r["component_id"] for r in simhash.near_duplicates(docs).collect()})
