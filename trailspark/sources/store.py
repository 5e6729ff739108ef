"""The answer store (SC23, WN9, TK8, AG16): appended Parquet, newest row per key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relate import latest


class AnswerStore:
    SCHEMA = "item string, model string, p double, recorded timestamp, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, answers: DataFrame) -> None:
        answers.select("item", "model", "p", "recorded", "seq").write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def current(self) -> DataFrame:
        return latest(self.rows(), ["item", "model"], ["recorded", "seq"])

    def status(self) -> DataFrame:
        return self.rows().groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").isNull()).alias("unanswered"), F.min("recorded").alias("oldest"))
