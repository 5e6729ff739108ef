"""Moves, places and request values against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from trailspark.functions import mentions, values
from trailspark.operators import places

TEXTS = ["plain", 'quote " and \\ back', "tab\tline\nfeed\r\b\f", "bell \x07 unit \x1f del \x7f", "é ß 日本", "😀 wide", ""]


def column(spark, rows, made):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", made(F.col("t")).alias("x")).orderBy("i").collect()]


def test_json_of_strings(spark):
    assert column(spark, TEXTS, values.json_quoted) == [json.dumps(t) for t in TEXTS]
    assert column(spark, TEXTS, values.serialized_chars) == [len(json.dumps(t)) for t in TEXTS]
    assert column(spark, TEXTS, values.content_hash) == [hashlib.sha256(json.dumps(t).encode()).hexdigest() for t in TEXTS]
    assert column(spark, TEXTS, values.git_blob_id) == [hashlib.sha1(f"blob {len(t.encode())}\0".encode() + t.encode()).hexdigest() for t in TEXTS]
    whole = [hashlib.sha256(json.dumps({"state": {"code": t, "a": "x"}, "questions": {"q": t}}, sort_keys=True).encode()).hexdigest() for t in TEXTS]
    assert column(spark, TEXTS, lambda t: values.request_sha256({"code": t, "a": F.lit("x")}, {"q": t})) == whole


def test_words_budgets_names(spark):
    got = column(spark, ["parseHTTPResponse the boxes", "classes is status", None], values.identifier_words)
    assert {"parse", "http", "response", "box"} <= set(got[0]) and "the" not in got[0] and got[1:] == [["classe", "status"], []]
    assert column(spark, ["5GB", " 1.5 mb ", "1024", "7 apples", None], values.byte_budget) == [5 * 10**9, 1_500_000, 1024, None, None]
    said = "call run_all() and `Store.flush` in `src/app.py`, see MAX_SIZE, fooBar and `two words`"
    assert column(spark, [said, None], mentions.code_names) == [["run_all", "flush", "MAX_SIZE", "fooBar"], []]


def test_neighbours_take_the_first_move_and_count_what_is_left_out(spark):
    schema = "opened string, file string, start int, end int, rank int"
    a = spark.createDataFrame([("o", "f", 1, 5, 1), ("o", "g", 1, 2, 2), ("o", "h", 1, 2, 3)], schema)
    b = spark.createDataFrame([("o", "f", 1, 5, 1), ("o", "k", 7, 9, 2)], schema)
    kept, omitted = places.neighbours({"callees": b, "callers": a}, per_move=2)
    assert sorted((r["file"], r["move"]) for r in kept.collect()) == [("f", "callers"), ("g", "callers"), ("k", "callees")]
    assert [(r["move"], r["omitted"]) for r in omitted.collect()] == [("callers", 1)]


def test_same_file_and_subset(spark):
    units = spark.createDataFrame([("f", str(i), 10 * i, 10 * i + 5) for i in range(8)], "file string, span string, start int, end int")
    near = [r["other"] for r in places.same_file(units, 2).where("span = '3'").orderBy("rank").collect()]
    assert near == ["2", "4"]
    answers = spark.createDataFrame([(1,), (2,)], "k int")
    assert places.require_subset(answers, answers, "k").count() == 2
    try:
        places.require_subset(answers, answers.where("k = 1"), "k")
    except ValueError:
        return
    raise AssertionError("what was not offered was taken")
