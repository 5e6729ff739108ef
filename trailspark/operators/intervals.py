"""Joins and folds over inclusive line intervals (JN4, JN6, JN7, JN20, WN12-WN14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """JN6: points (file, line) with the smallest span (span, start, end) of their file that holds them; ties by span.

    The file is an equi key, so this is a hash join with a range residual; null where nothing holds a point.
    """
    s = spans.select(F.col("file").alias("f2"), "span", "start", "end")
    held = points.join(s, (F.col("file") == F.col("f2")) & F.col("line").between(F.col("start"), F.col("end")), "left")
    best = F.min_by("span", F.struct(F.col("end") - F.col("start"), F.col("span")))
    return held.groupBy("file", "line").agg(best.alias("span"))


def holders(spans: DataFrame) -> DataFrame:
    """JN7: for each span the smallest strictly larger span that contains it; null at the top."""
    o = spans.select(F.col("file").alias("f2"), F.col("span").alias("o"), F.col("start").alias("os"), F.col("end").alias("oe"))
    inside = (F.col("file") == F.col("f2")) & (F.col("os") <= F.col("start")) & (F.col("oe") >= F.col("end")) & (F.col("oe") - F.col("os") > F.col("end") - F.col("start"))
    return spans.join(o, inside, "left").groupBy("file", "span").agg(F.min_by("o", F.struct(F.col("oe") - F.col("os"), F.col("o"))).alias("holder"))


def inside(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """JN4: every (span, call) of a file where the call's line is within the span."""
    s = spans.select(F.col("file").alias("f2"), "span", "start", "end")
    return calls.join(s, (F.col("file") == F.col("f2")) & F.col("line").between(F.col("start"), F.col("end"))).drop("f2", "start", "end")


def merged(spans: DataFrame, key: str = "file") -> DataFrame:
    """SF21/WN13: overlapping or touching ranges of a key as one; a running maximum finds the gaps."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    grouped = opened.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans")).drop("run")


def islands(lines: DataFrame, mark: Column, key: str = "file") -> DataFrame:
    """WN13: runs of consecutive lines with one mark."""
    w = Window.partitionBy(key, "mark").orderBy("line")
    runs = lines.select(key, "line", mark.alias("mark")).withColumn("run", F.col("line") - F.row_number().over(w))
    return runs.groupBy(key, "mark", "run").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("run")


def pieces(spans: DataFrame, size: int = 60) -> DataFrame:
    """WN14: spans cut into pieces of at most size lines."""
    starts = F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(size)))
    return spans.select("file", "span", "end", starts.alias("from")).select("file", "span", F.col("from").alias("start"), F.least(F.col("from") + size - 1, F.col("end")).alias("end"))


def context(lines: DataFrame, flag: Column, before: int = 2, after: int = 2, key: str = "file") -> DataFrame:
    """WN12: the lines at most so many lines from one that has the flag."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-after, before)
    return lines.withColumn("near", F.max(flag.cast("int")).over(w)).where("near = 1").drop("near")


def covered(spans: DataFrame) -> DataFrame:
    """AG2: distinct covered lines of a file; nested spans count once, without exploding a line."""
    return merged(spans).groupBy("file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n_lines"))
