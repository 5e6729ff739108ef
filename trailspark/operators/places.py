"""Moves from opened code to places, and the lookups under them (JD7, JN16, JN28, JN32, AG6, AG13, FP8, FP17, PB1, PB2, SC21, ST5, TK7, WN4).

A move takes opened units and fact tables, joined by name or file, and gives rows with their order within the opened
unit. ``neighbours`` unites moves: of places with the same lines the first move's stays, and each move has a cap whose
omitted places are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

# Fixed values.
PASSED_ON_ROLES = ("argument", "assignment", "base", "collection", "decorator", "export", "receiver", "return", "type")
MOVES = ("callers", "client_calls", "callees", "queried_models", "referenced_by", "passed_on", "imported", "same_file", "keys_mentioned", "co_changed", "lines_before", "rest_of_file")
HEAD_LINES, MAX_KEY_HITS, MAX_DEFINITION_LINES = 40, 30, 120


def _ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def call_site_count(calls: DataFrame) -> DataFrame:
    """AG6."""
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"))


def callers(opened: DataFrame, calls: DataFrame, tests: DataFrame) -> DataFrame:
    """Call sites (file, line) of opened definitions (name, opened), tests last."""
    sites = calls.select("name", "file", "line").distinct().join(tests.select("file").distinct().withColumn("test", F.lit(True)), "file", "left")
    rows = opened.join(sites, "name").withColumn("test", F.coalesce("test", F.lit(False)))
    return _ranked(rows, ["name", "opened"], [F.col("test"), F.col("file"), F.col("line")])


def callees(opened: DataFrame, calls: DataFrame, defs: DataFrame, tests: DataFrame) -> DataFrame:
    """What opened files call: a definition of the own file is proven and stands alone, others are candidates by name.

    Proven first, then those not only in tests, then by call sites, fewest first.
    """
    names = calls.join(opened, "file", "left_semi").select("file", "name").distinct()
    own = names.join(defs.select("file", "name").distinct(), ["file", "name"]).select("file", "name", F.col("file").alias("target"), F.lit(True).alias("proven"))
    others = names.join(own, ["file", "name"], "left_anti").join(defs.select("name", F.col("file").alias("target")).distinct(), "name").select("file", "name", "target", F.lit(False).alias("proven"))
    found = own.unionByName(others).join(tests.select(F.col("file").alias("target")).distinct().withColumn("test", F.lit(True)), "target", "left")
    only_tests = F.min(F.coalesce("test", F.lit(False))).over(Window.partitionBy("file", "name"))
    rows = found.withColumn("only_tests", only_tests).join(call_site_count(calls), "name")
    return _ranked(rows.drop("test"), ["file"], [~F.col("proven"), F.col("only_tests"), F.col("n_sites"), F.col("name"), F.col("target")])


def referenced_by(opened: DataFrame, refs: DataFrame) -> DataFrame:
    """Uses of opened names other than calls, with their roles."""
    return opened.join(refs.select("name", "file", "line", "role").distinct(), "name")


def passed_on(opened: DataFrame, refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions that opened files pass on, by role."""
    given = refs.join(opened, "file", "left_semi").where(F.col("role").isin(*PASSED_ON_ROLES)).select("file", "name", "role").distinct()
    return given.join(defs.select("name", F.col("file").alias("target")).distinct(), "name")


def imported(imports: DataFrame, defs: DataFrame, line_counts: DataFrame) -> DataFrame:
    """JN29: imports (file, target, name or null) open the name's definition in the target, else the target's head."""
    found = imports.join(defs.select("name", F.col("file").alias("target"), F.col("start").alias("at")), ["target", "name"], "left")
    sized = found.join(line_counts.select(F.col("file").alias("target"), "n_lines"), "target", "left")
    head = F.least(F.coalesce("n_lines", F.lit(HEAD_LINES)), F.lit(HEAD_LINES))
    return sized.select("file", "target", "name", F.coalesce("at", F.lit(1)).alias("start"), F.when(F.col("at").isNull(), head).alias("head_end"))


def client_calls(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """JN17 both ways: (name, key) where a text (key, text) holds a block's accessor between dots; an equi join on the word."""
    accessor = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    words = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\.(\w+)(?=\.)"), F.lit(1)))).alias("word"))
    return blocks.select("name", accessor.alias("word")).distinct().join(words, "word").select("name", "key")


def same_file(units: DataFrame, nearest: int = 3) -> DataFrame:
    """The nearest units of the same file that do not overlap, nearest first. Units of a file are in order: candidates come from its neighbours, not from all pairs."""
    w = Window.partitionBy("file").orderBy("start", "span")
    unit = F.struct("start", "end", "span")
    around = F.concat(F.collect_list(unit).over(w.rowsBetween(-nearest, -1)), F.collect_list(unit).over(w.rowsBetween(1, nearest)))
    rows = units.withColumn("around", around).select("file", "span", "start", "end", F.explode("around").alias("o"))
    apart = F.when(F.col("o.end") < F.col("start"), F.col("start") - F.col("o.end")).when(F.col("o.start") > F.col("end"), F.col("o.start") - F.col("end"))
    rows = rows.select("file", "span", F.col("o.span").alias("other"), F.col("o.start").alias("other_start"), apart.alias("distance")).where("distance is not null")
    return _ranked(rows, ["file", "span"], [F.col("distance"), F.col("other_start"), F.col("other")]).where(F.col("rank") <= nearest).drop("other_start")


def lines_around(units: DataFrame, line_counts: DataFrame, size: int = HEAD_LINES) -> DataFrame:
    """The moves lines_before and rest_of_file: up to size lines on both sides of a unit."""
    sized = units.join(line_counts, "file")
    before = F.struct(F.lit("lines_before").alias("move"), F.greatest(F.lit(1), F.col("start") - size).alias("from"), (F.col("start") - 1).alias("to"))
    after = F.struct(F.lit("rest_of_file").alias("move"), (F.col("end") + 1).alias("from"), F.least(F.col("n_lines"), F.col("end") + size).alias("to"))
    return sized.select("file", "span", F.explode(F.array(before, after)).alias("m")).select("file", "span", "m.*").where(F.col("from") <= F.col("to"))


def keys_mentioned(mentions: DataFrame, most: int = MAX_KEY_HITS) -> DataFrame:
    """Lines of other files that mention a file's keys (file, line, key), rarest key first; keys with more hits than most point nowhere."""
    each = mentions.select("file", "line", "key").distinct()
    own = each.groupBy("file", "key").agg(F.count(F.lit(1)).alias("own"))
    total = each.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    usable = own.join(total, "key").withColumn("hits", F.col("total") - F.col("own")).where(F.col("hits").between(1, most)).select("file", "key", "hits")
    hit = usable.join(each.select("key", F.col("file").alias("hit_file"), F.col("line").alias("hit_line")), "key").where("hit_file <> file")
    return _ranked(hit, ["file"], [F.col("hits"), F.col("key"), F.col("hit_file"), F.col("hit_line")])


def neighbours(moves: dict[str, DataFrame], per_move: int = 10) -> tuple[DataFrame, DataFrame]:
    """TK4/ST2: places (opened, file, start, end, rank) of moves in precedence: (places, omitted counts)."""
    united = None
    for at, name in enumerate(m for m in MOVES if m in moves):
        rows = moves[name].select("opened", "file", "start", "end", "rank", F.lit(name).alias("move"), F.lit(at).alias("precedence"))
        united = rows if united is None else united.unionByName(rows)
    first = _ranked(united.withColumnRenamed("rank", "place"), ["opened", "file", "start", "end"], [F.col("precedence"), F.col("place")]).where("rank = 1").drop("rank")
    within = _ranked(first, ["opened", "move"], [F.col("place"), F.col("file"), F.col("start")])
    omitted = within.where(F.col("rank") > per_move).groupBy("opened", "move").agg(F.count(F.lit(1)).alias("omitted"))
    return within.where(F.col("rank") <= per_move).drop("place"), omitted


def callers_of_file(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """JN16: (target, file, n): calls from other files of what a file defines."""
    named = defs.select("name", F.col("file").alias("target")).distinct()
    return calls.join(named, "name").where("file <> target").groupBy("target", "file").agg(F.count(F.lit(1)).alias("n"))


def files_naming(hits: DataFrame) -> DataFrame:
    """JN28: of hits (file, line, term) the first line of each file."""
    return hits.groupBy("term", "file").agg(F.min("line").alias("line"))


def context_queue(edges: DataFrame) -> DataFrame:
    """JN32: one-hop neighbours of each node, both directions, most connections first."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    n = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("connections"))
    return _ranked(n, ["src"], [F.desc("connections"), F.col("dst")])


def delivered(items: DataFrame, shown: DataFrame) -> DataFrame:
    """FP17: items (file, span, start, end) all of whose lines are within shown ranges; touching ranges count as one."""
    whole = intervals.merged(shown).select(F.col("file").alias("f2"), F.col("start").alias("s"), F.col("end").alias("e"))
    return items.join(whole, (F.col("file") == F.col("f2")) & (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")), "left_semi")


def changed_since(base: DataFrame, now: DataFrame) -> DataFrame:
    """FP8/SC7: (key, state) of what differs between two snapshots (key, sha): changed, new or gone."""
    both = base.select("key", F.col("sha").alias("before")).join(now.select("key", F.col("sha").alias("after")), "key", "full")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return both.select("key", state.alias("state")).where("state is not null")


def outside(answers: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """ST5: answers for what was not offered; there must be none."""
    return answers.join(offered.select(key).distinct(), key, "left_anti")


def require_subset(answers: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    if not outside(answers, offered, key).isEmpty():
        raise ValueError("an answer names what was not offered")
    return answers


def normalized_scores(rows: DataFrame, by: str, score: str) -> DataFrame:
    """WN4: shifted only if the least is negative, then over the shifted maximum."""
    w = Window.partitionBy(by)
    shift = F.least(F.min(score).over(w), F.lit(0.0))
    most = F.max(score).over(w) - shift
    return rows.withColumn("normalized", F.when(most > 0, (F.col(score) - shift) / most).otherwise(F.lit(0.0)))


def unit_scores(pieces: DataFrame) -> DataFrame:
    """AG13: the best probability of a unit's judged pieces (unit, piece, p), and the earliest piece that has it."""
    return pieces.groupBy("unit").agg(F.max("p").alias("score"), F.min_by("piece", F.struct(-F.col("p"), F.col("piece"))).alias("best_piece"))


def place_for_line(points: DataFrame, units: DataFrame, radius: int = 10, most: int = MAX_DEFINITION_LINES) -> DataFrame:
    """PB1/PB2: the innermost unit of a line where it is small enough, else a window around the line."""
    held = intervals.innermost(points, units).join(units.select("file", "span", "start", "end"), ["file", "span"], "left")
    whole = F.col("span").isNotNull() & (F.col("end") - F.col("start") + 1 <= most)
    start, end = F.when(whole, F.col("start")).otherwise(F.greatest(F.lit(1), F.col("line") - radius)), F.when(whole, F.col("end")).otherwise(F.col("line") + radius)
    rows = held.select("file", "line", F.when(whole, "unit").otherwise("window").alias("kind"), start.alias("from"), end.alias("to"))
    return rows.withColumn("key", F.concat(F.col("file").cast("string"), F.lit(":"), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")))


def name_table_add(held: DataFrame, new: DataFrame) -> DataFrame:
    """SC21: rows (blob, name, line) of blobs that the table does not hold yet; append them."""
    return new.join(held.select("blob").distinct(), "blob", "left_anti")


def outline(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """TK7: the first of each group, and how many were left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return _ranked(rows.withColumn("omitted", F.greatest(n - limit, F.lit(0))), [by], order).where(F.col("rank") <= limit)
