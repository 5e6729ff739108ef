"""Iterative operators (GR1, GR2, GR4, AG10). State is cut by written tables, so a lost executor costs a read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut


def degrees(edges: DataFrame) -> DataFrame:
    """AG10: weighted out-degree and number of edges."""
    return edges.groupBy("src").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


#: Rows of a range of nodes (its edges, and its nodes once more), which one task holds.
ROWS_A_RANGE = 2_000_000


def _relax(p: int, firsts: list, rows, given):
    """One range's part of a breadth-first search: its rows (node, dst) and the hops that its nodes have (new = 0) or are sent (new = 1).

    Returns nodes whose hop became less, in this range or in others, with it; others' nodes are sent to their ranges.
    """
    import numpy as np
    import pandas as pd

    codes, nodes = pd.factorize(np.concatenate([rows["node"].to_numpy(), rows["dst"].to_numpy(), given["node"].to_numpy()]))
    src, dst, at = codes[: len(rows)], codes[len(rows) : 2 * len(rows)], codes[2 * len(rows) :]
    homes = np.maximum(np.searchsorted(np.array(firsts, dtype=nodes.dtype), nodes, side="right") - 1, 0)
    order = np.argsort(src, kind="stable")
    dst, counts = dst[order], np.bincount(src, minlength=len(nodes))
    ends = np.cumsum(counts)
    far = np.iinfo(np.int64).max
    hops = np.full(len(nodes), far)
    new = given["new"].to_numpy() == 1
    sent = given["hop"].to_numpy().astype(np.int64)
    np.minimum.at(hops, at[~new], sent[~new])
    before = hops.copy()
    np.minimum.at(hops, at[new], sent[new])
    start = np.flatnonzero(hops < before)
    start = start[np.argsort(hops[start], kind="stable")]
    levels = hops[start]  # ascending; a node may get less before its level comes
    i, hop, front = 0, 0, start[:0]
    while i < len(start) or len(front):
        hop = hop if len(front) else int(levels[i])
        j = int(np.searchsorted(levels, hop, side="right"))
        front = np.concatenate([front, start[i:j][hops[start[i:j]] == hop]])
        i = max(i, j)
        n = counts[front]
        ahead = dst[np.repeat(ends[front] - np.cumsum(n), n) + np.arange(n.sum())]
        ahead = np.unique(ahead[hops[ahead] > hop + 1])
        hops[ahead] = hop + 1
        front, hop = ahead[homes[ahead] == p], hop + 1
    changed = np.flatnonzero(hops < before)
    return pd.DataFrame({"node": nodes[changed], "hop": hops[changed], "home": homes[changed], "own": homes[changed] == p})


def _hop_by_hop(edges: DataFrame, roots: DataFrame, depth: int | None) -> tuple[DataFrame, str]:
    seen = cut(roots.select("node", F.lit(0).alias("hop"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent")).distinct())
    edge, hop, last = cut(edges.select("src", "dst").distinct()), 0, seen
    while depth is None or hop < depth:
        hop += 1
        step = last.join(edge, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("node").alias("from"))
        last = cut(step.select(F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.col("from").alias("parent")).join(seen, "node", "left_anti"))
        if last.isEmpty():
            return seen, "fixed_point"
        seen = cut(seen.unionByName(last))
    return seen, "depth"


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hop) of all that roots reach, roots at hop 0; an edge without an end is none.

    Nodes are dealt to ranges. A task searches its range to the end and sends on what left it, until nothing does: rounds are
    ranges that a path passes, not its hops. Only ranges that were sent something are read. Where one node has more edges than a
    few ranges should, the search goes hop by hop.
    """
    kind = edges.schema["src"].dataType
    edge = edges.select("src", F.col("dst").cast(kind).alias("dst")).where("src is not null and dst is not null").distinct()
    edge = cut(edge)
    root = cut(roots.select(F.col("node").cast(kind).alias("node")).distinct())
    every = edge.withColumnRenamed("src", "node").unionByName(edge.select(F.col("dst").alias("node"), "dst").distinct())  # a node's own row, which leads nowhere new, so that nodes without edges count
    ranges = max(1, -(-every.count() // ROWS_A_RANGE))
    dealt = cut((every.repartitionByRange(ranges, "node") if ranges > 1 else every.repartition(1)).withColumn("home", F.spark_partition_id()))
    firsts = dealt.groupBy("home").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()  # one row a range
    if any(r["n"] > 4 * ROWS_A_RANGE for r in firsts):
        return _hop_by_hop(edge, root, None)[0].select("node", "hop")
    place = {r["home"]: i for i, r in enumerate(firsts)}
    homes, firsts = [r["home"] for r in firsts], [r["first"] for r in firsts]
    schema = f"node {kind.simpleString()}, hop long, home int, own boolean"

    def run(key, rows, given):
        out = _relax(place[key[0]], firsts, rows, given)
        return out.assign(home=[homes[h] for h in out["home"]])

    state = None
    sent = cut(dealt.join(root, "node", "left_semi").select("node", F.lit(0).cast("long").alias("hop"), "home").distinct())
    rounds = 0
    while active := [r["home"] for r in sent.select("home").distinct().collect()]:  # numbers of ranges
        given = sent.withColumn("new", F.lit(1))
        if state is not None:
            given = given.unionByName(state.where(F.col("home").isin(active)).withColumn("new", F.lit(0)))
        out = cut(dealt.where(F.col("home").isin(active)).repartition(len(active), "home").groupBy("home").cogroup(given.groupBy("home")).applyInPandas(run, schema))
        sent = out.where("not own").groupBy("node", "home").agg(F.min("hop").alias("hop"))
        own = out.where("own").select("node", "hop", "home")
        state = own if state is None else state.unionByName(own)
        rounds += 1
        if rounds % 8 == 0:
            state = cut(state.groupBy("node", "home").agg(F.min("hop").alias("hop")))
    found = root.withColumn("hop", F.lit(0).cast("long"))
    if state is not None:
        found = found.unionByName(state.select("node", "hop"))
    return cut(found.groupBy("node").agg(F.min("hop").cast("int").alias("hop")))


def trace(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> tuple[DataFrame, str]:
    """GR1/GR2: (node, hop, parent) of all that roots reach; and why it stopped: depth or fixed_point. With a depth, hop by hop."""
    if depth is None:
        near = reached(edges, roots)
        ahead = near.select(F.col("node").alias("src"), (F.col("hop") + 1).alias("hop"))
        parents = edges.select("src", F.col("dst").alias("node")).join(ahead, "src").join(near, ["node", "hop"], "left_semi").groupBy("node").agg(F.min("src").alias("parent"))
        return near.join(parents, "node", "left").select("node", "hop", "parent"), "fixed_point"
    return _hop_by_hop(edges, roots, depth)


def random_walk(edges: DataFrame, seeds: DataFrame, restart: float = 0.25, hub_penalty: float = 0.5, rounds: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """GR4: personalised walk (node, mass). Dangling mass returns to the seeds; mass is divided by max(1, degree) ** penalty at the end."""
    out = cut(edges.groupBy("src").agg(F.sum("weight").alias("total")))
    share = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(seeds.select("node")).distinct())
    total = seeds.agg(F.sum("weight")).first()[0]
    start = cut(nodes.join(seeds.groupBy("node").agg(F.sum("weight").alias("s")), "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / F.lit(total)).alias("s")))
    now = start.select("node", F.col("s").alias("mass"))
    for _ in range(rounds):
        sent = now.join(share, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("mass") * F.col("p")).alias("got"))
        lost = now.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("lost")).first()[0]
        after = start.join(sent, F.col("node") == F.col("dst"), "left").select("node", (F.col("s") * F.lit(restart + (1 - restart) * lost) + (1 - restart) * F.coalesce("got", F.lit(0.0))).alias("mass"))
        after = cut(after)
        error = after.join(now.select("node", F.col("mass").alias("old")), "node").agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0]
        now = after
        if error < tolerance:
            break
    return now.join(out, F.col("node") == F.col("src"), "left").select("node", F.round(F.col("mass") / F.pow(F.greatest(F.lit(1.0), F.coalesce("total", F.lit(0.0))), hub_penalty), 6).alias("mass"))
