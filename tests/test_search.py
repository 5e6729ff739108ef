"""Index, sources and searches over small literal texts, with scripted answers."""

import pytest

from trailspark.operators import search
from trailspark.operators.judge import Scripted

FILES = [
    ("app/store.py", "import json\n\n\ndef flush(cache):\n    return write(cache)\n\n\ndef write(cache):\n    return json.dumps(cache)\n"),
    ("app/jobs.py", "from app.store import flush\n\n\ndef sweep(cache):\n    flush(cache)\n    return 1\n\n\nclass Worker:\n    def run(self):\n        return sweep({})\n"),
    ("tests/test_store.py", "from app.store import flush\n\n\ndef test_flush():\n    assert flush({})\n"),
    ("copy/other.py", "def flush(cache):\n    return write(cache)\n"),
    ("bad.py", "def broken(:\n"),
    ("README.md", "# Store\nCall `flush` in app/store.py\n## Jobs\nsee jobs.py\n"),
    ("schema.prisma", 'generator client {\n  a = "{"\n}\nmodel Website {\n  id Int // {\n}\nenum Kind { A }\n'),
    ("conf.yaml", "a: 1\nb:\n  c: 2\n"),
]


@pytest.fixture(scope="module")
def ix(spark):
    return search.Index.of(spark.createDataFrame(FILES, "path string, text string"))


def test_units(ix):
    got = {(r["path"], r["symbol"], r["start"], r["end"]) for r in ix.units.collect()}
    assert got >= {("app/store.py", "flush", 4, 5), ("app/jobs.py", "Worker", 9, 11), ("README.md", "Store > Jobs", 3, 5), ("schema.prisma", "model Website", 4, 6), ("schema.prisma", "enum Kind", 7, 7), ("conf.yaml", "b", 2, 4), ("bad.py", "", 1, 2)}
    assert not any(s == "run" for _, s, _, _ in got)


def test_import_links(ix):
    got = {(r["src"], r["spec"]): r["target"] for r in ix.links.collect()}
    assert got["app/jobs.py", "app.store.flush"] == "app/store.py" and got["app/store.py", "json"] is None


def test_sources(ix):
    seeds = search.Seeds(names=["flush"], texts=["see `store.py` and 'write' in jobs"], files=["app/store.py"], anchors=[("app/jobs.py", 4)])
    by = {k: {(r["path"], r["line"]) for r in f(ix, seeds).collect()} for k, f in search.SOURCES.items()}
    assert by["anchor"] == {("app/jobs.py", 4)}
    assert by["definition"] == {("app/store.py", 4), ("copy/other.py", 1)}
    assert by["caller"] == {("app/jobs.py", 5), ("tests/test_store.py", 5)}
    assert by["callee"] == {("app/store.py", 8)}
    assert by["importer"] == {("app/jobs.py", None), ("tests/test_store.py", None)}
    assert by["named_file"] == {("app/store.py", None)}
    assert ("app/store.py", 8) in by["literal"]
    assert [r["distance"] for r in search.file_source(ix, seeds).collect()] == [1]
    assert search.reach(ix, seeds, search.SOURCES).count() > 10


def test_find_all_judges_all_hops_of_a_find(spark):
    callers = "\n\n".join(f"def use{i}(x):\n    return core(x + {i})\n" for i in range(7))
    own = search.Index.of(spark.createDataFrame([("lib/base.py", "def core(x):\n    return x\n"), ("lib/uses.py", callers)], "path string, text string"))
    uses = {r["unit"] for r in own.units.where("path = 'lib/uses.py'").collect()}
    core = own.units.where("path = 'lib/base.py'").first()["unit"]
    answers = {f"t|{u}": 0.1 for u in uses} | {f"t|{core}": 0.95}
    rows, stop = search.find_all(own, {"t": "where is core defined"}, search.Seeds(anchors=[("lib/base.py", 1)]), Scripted(answers), budget=30, size=2)
    got = {r["unit"]: r["p"] for r in rows.collect()}
    assert stop == "settled" and len(uses) == 7 and got == dict.fromkeys(uses, 0.1) | {core: 0.95}


def test_find_all_settles_and_keeps_unanswered_apart(ix):
    flush = "app/store.py:4:5"
    answers = {f"t|{u['unit']}": 0.1 for u in ix.units.collect()} | {f"t|{flush}": 0.95}
    rows, stop = search.find_all(ix, {"t": "where is flush defined"}, search.Seeds(names=["flush"]), Scripted(answers), budget=9, size=2)
    got = {r["unit"]: r for r in rows.collect()}
    assert stop == "settled" and got[flush]["p"] == 0.95 and got[flush]["value"] == max(r["value"] for r in got.values())
    assert got["app/jobs.py:4:6"]["p"] == 0.1  # a caller, one hop from the find
    result = search.point_results(rows).first()
    assert result["outcome"] == "found" and result["judged"] < ix.units.count()
    rows, stop = search.find_all(ix, {"t": "where is flush defined"}, search.Seeds(names=["flush"]), Scripted({}), budget=1, size=2)
    assert stop == "call cap" and {r["reason"] for r in rows.collect()} == {"unanswered", "not reached"}
    assert search.point_results(rows).first()["outcome"] == "unknown" and search.coverage(rows).agg({"n": "sum"}).first()[0] == rows.count()


def test_find_code(ix):
    start, goal = "app/jobs.py:9:11", "app/store.py:4:5"
    answers = {u["unit"]: 0.5 for u in ix.units.collect()} | {goal: 0.9}
    rows, stop = search.find_code(ix, [start], Scripted(answers), beam=2)
    got = {r["unit"]: r for r in rows.collect()}
    assert stop == "found" and got[goal]["verdict"] == "found" and got[start]["verdict"] == "start"
    rows, stop = search.find_code(ix, [start], Scripted({}), steps=1)
    assert stop == "budget" and rows.first()["verdict"] == "start" or rows.first()["verdict"] == "unanswered"


def test_trace(ix):
    start, goal, side = "app/jobs.py:9:11", "app/store.py:8:9", "tests/test_store.py:4:5"
    answers = {f"writes|{u['unit']}": 0.1 for u in ix.units.collect()} | {f"writes|{goal}": 0.9}
    duties, kept = search.trace_workflow(ix, [start], ["writes", "reads"], Scripted(answers), budget=5)
    got = {r["check"]: r for r in duties.collect()}
    assert got["writes"]["status"] == "evidence backed" and got["reads"]["status"] == "unresolved" and got["reads"]["examined"] == 0
    nodes = {r["node"] for r in kept.collect()}
    assert {start, goal} <= nodes and side not in nodes


def test_agent_search(ix):
    goal = "app/store.py:4:5"
    answers = {f"h/{p}|{u['unit']}": 0.1 for p in ("a", "b") for u in ix.units.collect()} | {f"h/a|{goal}": 0.9}
    points, ranked = search.agent_search(ix, {"h": {"a": "flush the cache", "b": "nothing like this"}}, search.Seeds(names=["flush"], texts=["flush"]), Scripted(answers), budget=8)
    got = {r["point"]: r for r in points.collect()}
    assert (got["a"]["outcome"], got["a"]["band"]) == ("found", "high") and got["b"]["outcome"] != "found"
    assert ranked.where("target = 'h/a' and rank = 1").first()["unit"] == goal
