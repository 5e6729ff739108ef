"""Connected components of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work, hub_join, work_table


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the smallest node of the component.

    Alternating large-star and small-star steps; each round's edges are written to the shared folder, and the number
    of rounds grows with the logarithm of the number of nodes. A hub's edges meet its minimum where they lie.
    """
    now = work_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = hub_join(both, work_table(low, "lowest"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work_table(large, "edges")
        low = work_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), "lowest")
        small = hub_join(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = work_table(small, "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for done in (now, large, low):
            drop_work(done)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
