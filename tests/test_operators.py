"""Operators that SQL does not express, against plain Python on small rows."""

import random

from pyspark.sql import functions as F

from trailspark.functions import judging
from trailspark.operators import graph, intervals, judge, ranking
from trailspark.sources.store import AnswerStore


def test_refused_batches_are_halved():
    seen = []

    def client(batch, ids):
        seen.append(len(ids))
        if len(ids) > 2:
            raise ValueError("request too large")
        return [0.5] * len(ids)

    assert [i for i, _, _ in judge.ask(client, 0, list("abcde"))] == list("abcde") and seen == [5, 3, 2, 1, 2]


def test_judged_spends_the_budget(spark):
    items = spark.createDataFrame([(f"i{n:03}",) for n in range(50)], "id string")
    rows = judge.judged(items, judge.Scripted({"i000": 0.9}), ["id"], size=16, budget=2).collect()
    assert sum(r["asked"] for r in rows) == 32 and [r["p"] for r in rows if r["id"] == "i000"] == [0.9] and sum(r["p"] is not None for r in rows) == 1


def test_folds(spark):
    draw = random.Random(1)
    sizes = [draw.randint(1, 300) for _ in range(40)]
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate(sizes)], "k string, i long, chars long")
    left, want = 500, []
    for s in sizes:
        want.append(s <= left)
        left -= s if s <= left else 0
    assert [r["taken"] for r in judge.within_budget(rows, "k", ["i"], "chars", 500).orderBy("i").collect()] == want
    batch, used, n, want = 0, 0, 0, []
    for s in sizes:
        if n and (n == 16 or used + s > 600):
            batch, used, n = batch + 1, 0, 0
        used, n = used + s, n + 1
        want.append(batch)
    assert [r["batch"] for r in judge.sized_batches(rows, "k", ["i"], "chars", box=600).orderBy("i").collect()] == want


def test_round_robin_keeps_shares():
    drawn = judge.round_robin({"a": 2.0, "b": 1.0}, {"a": 100, "b": 2}, 9)
    assert drawn[:6] == ["a", "b", "a", "a", "b", "a"] and drawn[6:] == ["a"] * 3


def test_active_search_stops(spark):
    rows = [(f"d{i}", float(i % 7), i) for i in range(20)]
    c = spark.createDataFrame(rows, "id string, score double, ord int")
    e = spark.createDataFrame([("d0", "d1")], "src string, dst string")
    none = spark.createDataFrame([], "id string, p double")
    assert judge.active_search(c, e, none, batch=4)[1] == "missing oracle answers"
    every = spark.createDataFrame([(f"d{i}", 0.1) for i in range(20)], "id string, p double")
    state, why = judge.active_search(c, e, every, batch=10, guard=9)
    assert why == "exhausted" and state.where("p is null").count() == 0


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 17).alias("k"), "id").repartition(7)
    got = [(r["k"], r["id"], r["rn"]) for r in ranking.numbered(rows, ["k", "id"]).collect()]
    assert sorted(got) == [(k, i, n + 1) for n, (k, i) in enumerate(sorted((i % 17, i) for i in range(1000)))]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 3.0)], "src long, dst long, weight double")
    roots = spark.createDataFrame([(1,)], "node long")
    rows, why = graph.trace(edges, roots)
    assert {(r["node"], r["hop"]) for r in rows.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)} and why == "fixed_point"
    mass = {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    out = {1: [(2, 1.0)], 2: [(3, 1.0)], 3: [(1, 0.25), (4, 0.75)], 4: []}
    for _ in range(200):
        lost = mass[4]
        after = {n: (0.25 + 0.75 * lost) * (n == 1) for n in mass}
        for n, ends in out.items():
            for m, p in ends:
                after[m] += 0.75 * mass[n] * p
        mass = after
    degree = {1: 1, 2: 1, 3: 4, 4: 1}
    got = {r["node"]: r["mass"] for r in graph.random_walk(edges, spark.createDataFrame([(1, 1.0)], "node long, weight double"), rounds=80).collect()}
    assert all(abs(got[n] - mass[n] / degree[n] ** 0.5) < 1e-4 for n in mass)


def test_intervals(spark):
    spans = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 3, 5), ("f", "c", 6, 6), ("f", "d", 12, 14)], "file string, span string, start int, end int")
    points = spark.createDataFrame([("f", 4), ("f", 6), ("f", 11), ("g", 1)], "file string, line int")
    assert {(r["file"], r["line"]): r["span"] for r in intervals.innermost(points, spans).collect()} == {("f", 4): "b", ("f", 6): "c", ("f", 11): None, ("g", 1): None}
    assert {(r["start"], r["end"], r["n_spans"]) for r in intervals.merged(spans).collect()} == {(1, 10, 3), (12, 14, 1)}
    assert intervals.covered(spans).first()["n_lines"] == 13


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.9,), (0.1,), (0.5,), (None,)], "p double").select(judging.verdict(F.col("p")).alias("v"), judging.band(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("yes", "high"), ("no", "low"), ("unsure", "middle"), ("unanswered", None)]


def test_store_keeps_the_newest(spark, tmp_path):
    store = AnswerStore(spark, f"{tmp_path}/answers")
    for i, p in enumerate([0.1, None, 0.7]):
        store.append(spark.createDataFrame([("x", "m", p, i)], "item string, model string, p double, seq long").withColumn("recorded", F.timestamp_seconds(F.lit(100 + i))))
    assert [(r["item"], r["p"]) for r in store.current().collect()] == [("x", 0.7)]
    assert store.status().first()["n"] == 3 and store.status().first()["unanswered"] == 1
