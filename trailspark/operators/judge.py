"""Judging with an explicit budget (WN16-WN18, JD1, JD4, JD8, GR6). The client is scripted or replayed: no remote calls here.

Batches are cut and the budget is spent on the driver, before dispatch; a retried task asks with the same batch id, so
a client that remembers ids never spends twice. Answers that are missing stay null and are never negatives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import cut
from .ranking import batches

Client = Callable[[int, list[str]], list[float | None]]


class Scripted:
    """Answers from a table of probabilities; ids that it lacks stay unanswered."""

    def __init__(self, answers: dict[str, float], refuse_over: int | None = None):
        self.answers, self.refuse_over = answers, refuse_over

    def __call__(self, batch: int, ids: list[str]) -> list[float | None]:
        if self.refuse_over is not None and len(ids) > self.refuse_over:
            raise ValueError("request too large")
        return [self.answers.get(i) for i in ids]


def ask(client: Client, batch: int, ids: list[str]) -> list[tuple[str, float | None, int]]:
    """JD4: one request; a refused one is halved, depth first. (id, probability, requests spent so far on it)."""
    try:
        return [(i, p, 1) for i, p in zip(ids, client(batch, ids), strict=True)]
    except ValueError:
        if len(ids) == 1:
            return [(ids[0], None, 1)]
        half = (len(ids) + 1) // 2
        return [(i, p, n + 1) for part in (ids[:half], ids[half:]) for i, p, n in ask(client, batch, part)]


def judged(items: DataFrame, client: Client, order: list[str], size: int = 16, budget: int | None = None) -> DataFrame:
    """JD1: items (id, …) with batch and p. Beyond the budget's requests items stay unasked (asked = false)."""
    dealt = batches(items, order, size)

    def run(frames):
        import pandas as pd

        for frame in frames:
            frame = frame.copy()
            answers: dict = {}
            for batch, part in frame.groupby("batch"):
                answers.update({i: p for i, p, _ in ask(client, int(batch), part["id"].tolist())})
            frame["p"] = pd.array([answers[i] for i in frame["id"]], dtype="Float64")
            yield frame[["id", "batch", "p"]]

    chosen = dealt if budget is None else dealt.where(F.col("batch") < budget)
    answered = chosen.select("id", "batch").repartition("batch").sortWithinPartitions("batch", "id").mapInPandas(run, "id string, batch long, p double")
    return dealt.join(answered.select("id", "p", F.lit(True).alias("asked")), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def sized_batches(items: DataFrame, of: str, order: list[str], chars: str, box: int, most: int = 16) -> DataFrame:
    """WN17: closes a batch early when its characters would exceed the box. The fold is sequential in a group, which must be small."""
    schema = items.schema.simpleString()[7:-1] + ",batch:long"

    def fold(frame):
        frame, batch, n, used, out = frame.sort_values(order, kind="stable"), 0, 0, 0, []
        for size in frame[chars]:
            if n and (n == most or used + size > box):
                batch, n, used = batch + 1, 0, 0
            n, used = n + 1, used + size
            out.append(batch)
        frame["batch"] = out
        return frame

    return items.groupBy(of).applyInPandas(fold, schema)


def within_budget(items: DataFrame, of: str, order: list[str], chars: str, budget: int) -> DataFrame:
    """WN16b: in reading order an item that would overrun is skipped, and smaller later ones still enter."""
    schema = items.schema.simpleString()[7:-1] + ",taken:boolean"

    def fold(frame):
        frame, left, out = frame.sort_values(order, kind="stable"), budget, []
        for size in frame[chars]:
            out.append(bool(size <= left))
            left -= size if size <= left else 0
        frame["taken"] = out
        return frame

    return items.groupBy(of).applyInPandas(fold, schema)


def evict_oldest(items: DataFrame, of: str, newest_first: list[Column], chars: str, budget: int) -> DataFrame:
    """WN16a: what is kept when the oldest goes first until the rest fits: a running sum from the newest."""
    total = F.sum(chars).over(Window.partitionBy(of).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("kept", total <= budget)


def round_robin(shares: dict[str, float], sizes: dict[str, int], draws: int) -> list[str]:
    """WN18: smooth weighted round-robin over queues; an empty queue leaves the round."""
    left, credit, out = dict(sizes), dict.fromkeys(shares, 0.0), []
    while len(out) < draws and any(left.get(q, 0) for q in shares):
        live = [q for q in shares if left.get(q, 0)]
        for q in live:
            credit[q] += shares[q]
        pick = max(live, key=lambda q: credit[q])
        credit[pick] -= sum(shares[q] for q in live)
        left[pick] -= 1
        out.append(pick)
    return out


def active_search(candidates: DataFrame, edges: DataFrame, answers: DataFrame, batch: int = 16, guard: int = 4, least_gain: float = 0.0, boost: float = 0.5, found: float = 0.8) -> tuple[DataFrame, str]:
    """GR6: rerank, judge the best batch, spread what was found, until a stop rule. (id, round, p), and the reason.

    candidates: id, score, ord. A round is one small batch; the rest stays in tables.
    """
    state = cut(candidates.select("id", F.col("score").cast("double").alias("score"), "ord", F.lit(None).cast("int").alias("round"), F.lit(None).cast("double").alias("p")))
    known = cut(answers.select("id", F.col("p").alias("answer")))
    for step in range(guard):
        if state.where("round is null").isEmpty():
            return state, "exhausted"
        confirmed = state.where(F.col("p") >= found).select(F.col("id").alias("src"))
        near = edges.join(confirmed, "src").groupBy(F.col("dst").alias("id")).agg(F.lit(boost).alias("boost"))
        open_rows = state.where("round is null").join(near, "id", "left").withColumn("value", F.col("score") + F.coalesce("boost", F.lit(0.0)))
        picked = cut(open_rows.orderBy(F.desc("value"), "ord").limit(batch).join(known, "id", "left").select("id", "answer", "value"))
        gain = picked.agg(F.sum("value")).first()[0]
        state = cut(state.join(picked, "id", "left").select("id", "score", "ord", F.when(F.col("value").isNotNull(), step).otherwise(F.col("round")).alias("round"), F.coalesce("answer", "p").alias("p")))
        if picked.where("answer is not null").isEmpty():
            return state, "missing oracle answers"
        if gain < least_gain:
            return state, "marginal value"
    return state, "request guard"
