"""Allowances, bindings through modules and facts of scripts, on small cases made by hand."""

import pytest
from pyspark.sql import functions as F

from trailspark.operators import bindings, search
from trailspark.operators.questions import Allowance, ask_all, existence, picked
from trailspark.sources import script

TS = """import a, { b as c, default as d, type T } from "./m"; // from 'no'
import * as ns from './ns'
export * from "./x"; export { q as r } from './y'
const { f, g: h } = require('g'); const db = require("db")
export async function load(x: number): Promise<{a: string}> {
  return db.query(`a ${run(x, { k: `z` })} b (`) // )
}
class Store extends Base {
  private static async flush(a = {}) { this.items.push(a?.b()); }
  get size(): number { return /[(]/.test("(") ? 1 : 2 }
}
const arrow = async (p) => {
  if (p) { go(p) }
}
const one = x => x.trim()
const plain = 5
"""


def test_allowance_counts_under_every_cap():
    top = Allowance(10)
    child = top.scope()
    child.spend(2)
    assert (top.left(), child.left()) == (8, 8)
    shares = child.reserve({"a": 3, "b": 4})
    assert (top.left(), child.left(), shares["a"].left()) == (1, 1, 3)
    inner = shares["a"].reserve({"x": 2})
    inner["x"].spend(2)
    assert (shares["a"].left(), inner["x"].left(), top.left()) == (1, 0, 1)
    top.spend(1)
    for wrong in (lambda: top.spend(1), lambda: top.reserve({"c": 1}), lambda: top.reserve({"c": -1}), lambda: inner["x"].spend(1)):
        with pytest.raises(ValueError):
            wrong()
    assert top.left() == 0 and shares["b"].left() == 4 and Allowance().left() is None


def test_equal_requests_are_sent_once(spark):
    rows = spark.createDataFrame([(1, "x", "q"), (2, "x", "q"), (3, "y", "q"), (4, "z", "q"), (5, "", "q")], "request long, state string, question string")
    none = spark.createDataFrame([], "sha string, p double")
    allowed = Allowance(2)
    first = ask_all(rows, lambda b, ids: [0.7] * len(ids), none, allowed, lambda c: c)
    assert {r["request"]: (r["p"], r["source"]) for r in first.collect()} == {1: (0.7, "sent"), 2: (0.7, "sent"), 3: (0.7, "sent"), 4: (None, None), 5: (None, None)}
    assert allowed.left() == 0
    again = ask_all(rows, lambda b, ids: [0.1] * len(ids), first.where("p is not null").select("sha", "p"), Allowance(1), lambda c: c)
    assert {r["request"]: r["source"] for r in again.collect()} == {1: "stored", 2: "stored", 3: "stored", 4: "sent", 5: None}


def test_choices_and_existence(spark):
    options = spark.createDataFrame([("q", "b", 0.4), ("q", "a", 0.4), ("q", "c", 0.2), ("one", "x", 0.3), ("none", "x", None)], "question string, option string, p double")
    assert sorted((r["question"], r["choice"], round(r["confidence"], 3)) for r in picked(options, ["question"]).collect()) == [("one", "x", 1.0), ("q", "a", 0.1)]
    pieces = spark.createDataFrame([("h", i, i, "x" * 10) for i in range(5)], "hypothesis string, piece int, ord int, code string")
    points = spark.createDataFrame([("h", "p", "12345678"), ("h", "q", "1")], "hypothesis string, point string, question string")
    got = existence(pieces, points, lambda b, ids: [0.5, None], 40, Allowance()).collect()
    assert sorted((r["point"], r["p"], r["n_shown"], r["n_evicted"]) for r in got) == [("p", 0.5, 2, 3), ("q", None, 2, 3)]


def test_bindings_go_through_reexports_and_cycles(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    uses = t([("u", 1, "f", None), ("u", 2, "g", None), ("u", 3, "h", "m"), ("u", 4, "k", None), ("u", 5, "f", "x"), ("u", 6, "z", None), ("u", 9, "f", None)], "file string, line int, name string, receiver string")
    definitions = t([("c", "f0"), ("c", "h"), ("b", "g"), ("d", "g"), ("u", "k"), ("c", "k")], "file string, name string")
    imported = t([("u", "f", "a", "f0"), ("u", "g", "a", "g"), ("u", "k", "c", "k"), ("u", "z", None, "z")], "file string, name string, target string, exported string")
    reexports = t([("a", None, "b", True), ("b", None, "a", True), ("b", "f0", "c", True), ("a", "g", "d", True)], "path string, name string, next string, proven boolean")
    got = bindings.bindings(
        uses, t([], "file string, line int, name string, state string, defined_in string"), t([("u", "f", 8, 10)], "file string, name string, first int, last int"),
        t([("u", "m", "c")], "file string, receiver string, target string"), imported, reexports, definitions, t([], "file string"),
    )
    assert {r["line"]: (r["state"], r["defined_in"], r["via"]) for r in got.collect()} == {
        1: ("resolved", "c", "import"), 2: ("candidate", None, "import"), 3: ("resolved", "c", "module"), 4: ("resolved", "u", "facts"),
        5: ("unresolved", None, "facts"), 6: ("unresolved", None, "facts"), 9: ("candidate", None, "local"),
    }
    hidden = bindings.through_modules(t([("a", "f0", True)], "target string, name string, proven boolean"), reexports, definitions, t([("b",)], "file string")).collect()
    assert [(r["state"], r["defined_in"]) for r in hidden] == [("unknown", None)]


def test_facts_of_scripts(spark):
    files = spark.createDataFrame([("a.ts", TS), ("b.ts", "function x() { ("), ("c.js", ""), ("d.js", None)], "path string, text string")
    got = [tuple(r)[1:] for r in script.script_facts(files.where("path = 'a.ts'")).collect()]
    kinds = {(k, n): (s, e) for k, n, s, e, _ in got if k != "call"}
    assert kinds == {("function", "load"): (5, 7), ("class", "Store"): (8, 11), ("function", "flush"): (9, 9), ("function", "size"): (10, 10), ("function", "arrow"): (12, 14), ("function", "one"): (15, 15)}
    assert {(n, r) for k, n, _, _, r in got if k == "call"} == {("require", None), ("query", "db"), ("run", None), ("push", "this.items"), ("b", "a"), ("test", "<expression>"), ("go", None), ("trim", "x")}
    assert [(r["path"], r["kind"]) for r in script.script_facts(files.where("path <> 'a.ts'")).collect()] == [("b.ts", "unparsed")]
    names = [tuple(r)[1:] for r in script.script_names(files).collect()]
    assert names == [
        ("name", "./m", "b", "c"), ("name", "./m", None, "d"), ("name", "./m", "T", "T"), ("name", "./m", None, "a"), ("module", "./ns", None, "ns"), ("reexport", "./x", None, None),
        ("reexport", "./y", "q", "r"), ("name", "g", "f", "f"), ("name", "g", "g", "h"), ("module", "db", None, "db"),
    ]
    assert len(script.blanked(TS)) == len(TS) and script.blanked(TS).count("\n") == TS.count("\n")


def test_scripts_are_indexed(spark):
    files = spark.createDataFrame([("src/a.ts", "import { go } from '../lib/b.js'\nexport function run() {\n  go()\n}\n"), ("lib/b.ts", "export const go = () => 1\n"), ("x/c.ts", "import '../../../up'\nimport z from './none'\n")], "path string, text string")
    ix = search.Index.of(files)
    assert {(r["src"], r["spec"], r["target"]) for r in ix.links.collect()} == {("src/a.ts", "../lib/b.js", "lib/b.ts"), ("x/c.ts", "../../../up", None), ("x/c.ts", "./none", None)}
    assert {(r["path"], r["symbol"]) for r in ix.units.where("symbol <> ''").collect()} == {("src/a.ts", "run"), ("lib/b.ts", "go")}
    assert [(r["path"], r["start"]) for r in ix.calls.where(F.col("name") == "go").collect()] == [("src/a.ts", 3)]
