"""Searches to the fixed point, in one range and in many, against a search by hand."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators import graph, search


def by_hand(pairs, roots):
    hops, front, out = dict.fromkeys(roots, 0), list(roots), {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    while front:
        front = sorted({b for a in front for b in out.get(a, ()) if b not in hops and not hops.__setitem__(b, hops[a] + 1)})
    return hops


@pytest.mark.parametrize("rows", [2_000_000, 100, 1])
def test_hops_are_those_of_a_search_by_hand(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "ROWS_A_RANGE", rows)
    draw = random.Random(1)
    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in ((draw.randrange(150), draw.randrange(150)) for _ in range(300))]
    edges = spark.createDataFrame([*pairs, ("n000", None), (None, "n001")], "src string, dst string")
    roots = spark.createDataFrame([("n000",), ("n007",), ("out",), ("n000",)], "node string")
    want = by_hand(pairs, ["n000", "n007", "out"])
    got, why = graph.trace(edges, roots)
    got = {r["node"]: (r["hop"], r["parent"]) for r in got.collect()}
    assert why == "fixed_point" and {n: h for n, (h, _) in got.items()} == want and len(want) > 20
    assert all(p == min((a for a, b in pairs if b == n and want.get(a) == h - 1), default=None) for n, (h, p) in got.items())


def test_a_long_chain_takes_few_jobs(spark):
    chain = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    root, end = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(300,)], "node long")
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    assert graph.reached(chain, root).agg(F.max("hop")).first()[0] == 400
    assert {r["node"] for r in search.backbone(chain, root, end).collect()} == set(range(301))
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 150
    sc.setLocalProperty("spark.jobGroup.id", None)
