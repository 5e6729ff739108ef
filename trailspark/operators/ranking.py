"""Ranking (AG8, AG9, TK1-TK5, WN1-WN11, WN17, WN19). Every order has an explicit last tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import cut


#: Rows dealt to one task. Adaptive partitions are sized by compressed bytes; rows of small keys are many times larger in memory.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows by keys in partitions of about ROWS_A_TASK of their n rows, so that a task's memory does not grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)), *keys)


def postings(units: DataFrame, tokens: Column) -> DataFrame:
    """(doc, term, tf)."""
    return units.select("doc", F.explode(tokens).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(units: DataFrame, tokens: Column, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """AG9: (query, doc, score) of queries (query, term). Only postings of asked terms are joined; statistics cover all units."""
    sized = units.select("doc", tokens.alias("terms")).withColumn("len", F.size("terms").cast("double"))
    totals = sized.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avg_len"))  # one row
    asked = queries.select("query", "term").distinct()
    found = sized.select("doc", "len", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc", "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    rows = found.join(df, "term").join(asked, "term").join(F.broadcast(totals))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))


def best(rows: DataFrame, k: int, by: list[Column], of: list[str] | None = None) -> DataFrame:
    """TK1/TK4: the first k rows (of each group), with their rank."""
    w = Window.partitionBy(*(of or [F.lit(0)])).orderBy(*by)
    if of:
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(w))


def normalised(rows: DataFrame, features: list[str], of: list[str]) -> DataFrame:
    """WN2: each feature over its maximum in the group; all zero where that is 0."""
    w = Window.partitionBy(*of)
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double") / F.nullif(F.max(f).over(w).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """WN10/ST2: the first row of each key in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def rarities(names: DataFrame, places: DataFrame) -> DataFrame:
    """AG8: names with how many distinct places hold them (0 is kept) and 1 / log2(2 + n)."""
    n = places.groupBy("name").agg(F.countDistinct("at").alias("n"))
    return names.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_places"), F.round(1.0 / F.log2(2.0 + F.coalesce("n", F.lit(0))), 6).alias("rarity"))


def batches(items: DataFrame, order: list[str], size: int = 16, of: str | None = None) -> DataFrame:
    """WN17: items in batches of at most size, the same for any input order. Without a group, numbers are given by range partition, so no task sorts everything."""
    if of:
        rn = F.row_number().over(Window.partitionBy(of).orderBy(*order))
        return items.withColumn("batch", F.floor((rn - 1) / size).cast("long"))
    return numbered(items, order).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """items with rn = 1, 2, … in order: a range sort, counts per partition, and their running sum (one row per partition)."""
    dealt = items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    dealt = cut(dealt)  # both reads below must see one numbering
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__i").alias("__first"))
    before = sizes.select(F.col("__p").alias("__p2"), "__first", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    out = dealt.join(F.broadcast(before), F.col("__p") == F.col("__p2"))  # as many rows as partitions
    return out.withColumn("rn", F.col("__before") + F.col("__i") - F.col("__first") + 1).drop("__p", "__p2", "__i", "__first", "__before")


def interleave(ranked: DataFrame, limit: int) -> DataFrame:
    """WN19: the first of each ranking, then the second of each, each item once."""
    once = first_wins(ranked, ["item"], [F.col("rank"), F.col("source")])
    return once.orderBy("rank", "source", "item").limit(limit)
