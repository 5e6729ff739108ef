"""Paths, mentions, facts, comments, blocks and git sources on literal inputs."""

import re
import subprocess

import pytest
from pyspark.sql import functions as F

from trailspark.functions import mentions, paths, text
from trailspark.sources import code, git


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_paths(spark):
    names = ["a/test/b.py", "src/x_test.go", "src/contest.py", "conftest.py", "docs/a.ts", "README.MD", "a.prisma", "Makefile"]
    assert column(spark, names, paths.is_test) == [True, True, False, True, False, False, False, False]
    assert column(spark, names, paths.language_of) == ["python", None, "python", "python", "typescript", None, "prisma", None]
    assert column(spark, names, paths.is_docs) == [False, False, False, False, True, True, False, False]
    assert column(spark, names, lambda p: paths.kept(p, exclude=["docs"], with_tests=False)) == [False, False, True, False, False, False, True, False]


def test_left_out(spark):
    rows = spark.createDataFrame([(".env", ""), (".env.sample", ""), ("a.bin", "x\0"), ("vendor/a.txt", ""), ("dist/yarn.lock", "# @generated"), ("a.txt", "// Do not edit\n"), ("dist/a.txt", ""), ("a.txt", "fine\n" * 12 + "# @generated")], "p string, t string")
    assert [r["r"] for r in rows.select(paths.left_out(F.col("p"), F.col("t")).alias("r")).collect()] == ["env file", None, "binary", "vendored", None, "generated", "output folder", None]


@pytest.mark.parametrize(("glob", "fits", "not_"), [("*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("/src/*.py", ["src/a.py"], ["src/b/a.py", "x/src/a.py"]), ("src/**/t?.[!a]s", ["src/t1.ts", "src/a/b/t2.js"], ["src/t1.as"]), ("a.b*", ["a.bc"], ["axbc"])])
def test_globs(glob, fits, not_):
    pattern = re.compile(paths.glob_pattern(glob))
    assert all(pattern.match(p) for p in fits) and not any(pattern.match(p) for p in not_)


def test_mentions(spark):
    said = "Run `Store.flush()` then load_all(x) in ../jobs/run_all.py; MAX_SIZE, fooBar and `a/b.py`; uv run python3 -u -m app.jobs --all 'user.name'"
    rows = spark.createDataFrame([("k", said), ("n", None)], "k string, t string")
    assert [r["name"] for r in mentions.names_in(rows, "k", "t").orderBy("ord").collect()] == ["flush", "load_all", "run_all", "MAX_SIZE", "fooBar"]
    assert column(spark, [said, None], mentions.paths_in)[0][0] == "Store.flush"
    assert "jobs/run_all.py" in column(spark, [said], mentions.paths_in)[0]
    assert column(spark, [said, None], mentions.modules_run) == [["app.jobs"], []]
    assert column(spark, [said], mentions.literals_in) == [["user.name"]]
    assert column(spark, ["Website"], mentions.client_call) == [".website."]
    assert column(spark, ["getHTTPCode"], text.spelling_variants)[0][:2] == ["getHTTPCode", "get_httpcode"]


def test_facts(spark):
    rows = spark.createDataFrame([(1, "x\n# TODO fix 2024-05-06\n# TODO(ann): ok AB-12")], "k long, t string")
    assert {(r["fact"], r["line"], r["value"]) for r in mentions.facts_in(rows, "k", "t").collect()} == {("todo_without_owner", 2, "TODO"), ("date", 2, "2024-05-06"), ("ticket_reference", 3, "AB-12")}


def test_comments_and_imports(spark):
    files = spark.createDataFrame([("a.py", "# Copyright me\nx = 1  # noqa\n# one\n# two\ny = 2\n# ----\n"), ("b.ts", "import {a} from './a'\n// import b from 'b'\nconst c = require(\"c\")\n")], "path string, text string")
    got = {(r["start"], r["end"]): r["reason"] for r in code.comments(files).where("path = 'a.py'").collect()}
    assert got == {(1, 1): "licence_header", (2, 2): "tool_directive", (3, 4): None, (6, 6): "divider"}
    assert [r["spec"] for r in code.script_imports(files.where("path = 'b.ts'")).orderBy("ord").collect()] == ["./a", "c"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "d").mkdir()
    (tmp_path / "a.py").write_text("one\ntwo\n")
    (tmp_path / ".gitignore").write_text("out/\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("one\n2\nthree\n")
    (tmp_path / "d" / "b.py").write_text("b\n")
    run("add", ".")
    run("commit", "-qm", "second")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x").write_text("x")
    (tmp_path / "new.txt").write_text("x")
    root = str(tmp_path)
    assert {r["path"] for r in git.tracked(spark, root).collect()} == {"a.py", "d/b.py", ".gitignore"}
    assert {r["path"]: r["reason"] for r in git.working(spark, root).collect()} == {"a.py": None, "d/b.py": None, ".gitignore": None, "new.txt": "untracked", "out": "ignored"}
    assert {r["folder"] for r in git.collapsed(git.working(spark, root)).collect()} == {"new.txt", "out"}
    assert {r["path"]: r["text"] for r in git.at_commit(spark, root, "HEAD~1").collect()}["a.py"] == "one\ntwo\n"
    assert git.commits(spark, root).where("path = 'a.py'").count() == 2 and git.commits(spark, root, newest=1).where("path = 'a.py'").first()["seq"] == -1
    assert {(r["path"], r["line"]) for r in git.changed_lines(spark, root, "HEAD~1").collect()} == {("a.py", 2), ("a.py", 3), ("d/b.py", 1)}
    with pytest.raises(git.ToolFailed):
        git.git(root, "rev-parse", "--verify", "nothing")


def test_from_directory_keeps_large_files(spark, tmp_path):
    from trailspark.sources import text as source

    large = "a line of a log\n" * 140_000
    (tmp_path / "large.log").write_text(large)
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["problem"]) for r in source.from_directory(spark, str(tmp_path)).collect()}
    assert got == {"large.log": (large, None), "b.bin": (None, "binary")}
