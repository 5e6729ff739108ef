"""What made queries slow on large tables, seen in their plans."""

from pyspark.sql import functions as F

from trailspark.functions import values
from trailspark.operators import bindings
from trailspark.sources import text as source


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_words_are_literal_patterns(spark):
    rows = spark.createDataFrame([("the cat",), ("other",), ("a.c abc",), ("_the",), (None,)], "text string").repartition(2)
    found = source.search(rows, ["the", "a.c", "the"], whole_word=True)
    assert sorted((r["text"], r["term"]) for r in found.collect()) == [("a.c abc", "a.c"), ("the cat", "the"), ("the cat", "the")]
    assert "RLIKE(" in plan(found) and "concat(" not in plan(found)  # a pattern made of a column is compiled for each row


def test_quoting_does_not_split_texts_into_characters(spark):
    assert "split(" not in plan(spark.range(1).select(values.json_quoted(F.concat(F.col("id").cast("string"), F.lit("x")))))


def test_reexports_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    schema = "path string, name string, next string, proven boolean"
    rows = spark.createDataFrame([("a", None, "b", True), ("b", "f", "c", True), ("c", None, "d", False)], schema).mapInPandas(counted, schema)
    wanted = spark.createDataFrame([("a", "f", True)], "target string, name string, proven boolean")
    got = bindings.exporters(wanted, rows).collect()
    assert {(r["path"], r["proven"]) for r in got} == {("a", True), ("b", True), ("c", True), ("d", False)} and made.value == 3
