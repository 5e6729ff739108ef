"""Sources over text files (SC1, SC3, SC8, SC9, SC13, SC19)."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_directory(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """SC3: (path, sha256, text, problem) of all files below root; a binary file has a reason, not a text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if suffixes:
        files = files.where(F.lower("path").rlike(r"\.(" + "|".join(s.lstrip(".") for s in suffixes) + ")$"))
    problem = F.when(F.instr(F.substring("content", 1, 8000).cast("string"), "\0") > 0, "binary")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.when(problem.isNull(), F.decode("content", "utf-8")).alias("text"), problem.alias("problem"))


def lines(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """SC8: (file, line, text), 1-based."""
    return files.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def search(rows: DataFrame, terms: list[str], whole_word: bool = False) -> DataFrame:
    """SC19: each line with each term that it holds; one pass over the lines, terms are a literal array."""
    held = lambda t: F.contains("text", F.lit(t))
    # A literal pattern is compiled once; a word without signs must be held before its pattern can fit.
    word = lambda t: F.regexp_like("text", F.lit(f"(^|[^A-Za-z0-9_]){t}($|[^A-Za-z0-9_])"))
    whole = lambda t: held(t) & word(t) if re.fullmatch("[A-Za-z0-9_]+", t) else word(t)
    fits = whole if whole_word else held
    return rows.select("*", F.explode(F.array_compact(F.array(*[F.when(fits(t), F.lit(t)) for t in terms]))).alias("term"))


FACT_SCHEMA = "path string, kind string, name string, start int, end int, receiver string"


def _python_facts(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "unparsed", "", 1, text.count("\n") + 1, None)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append((path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, None))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((path, "call", f.id, node.lineno, node.end_lineno, None))
            elif isinstance(f, ast.Attribute):
                out.append((path, "call", f.attr, node.lineno, node.end_lineno, ast.unparse(f.value) if isinstance(f.value, ast.Name | ast.Attribute) else "<expression>"))
        elif isinstance(node, ast.Import):
            out += [(path, "import", a.name, node.lineno, node.end_lineno, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, "import", f"{'.' * node.level}{node.module or ''}.{a.name}", node.lineno, node.end_lineno, a.asname) for a in node.names]
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """SC9 for Python files (path, text): definitions, calls and imports; a file that does not parse is one row "unparsed"."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["text"], strict=True) for r in _python_facts(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "start", "end", "receiver"])

    return files.select("path", "text").mapInPandas(run, FACT_SCHEMA)


def _headings(text: str) -> list[tuple[str | None, int, int]]:
    blocks, stack, name, start, fence, front = [], [], None, 1, None, False
    rows = text.split("\n")
    for i, row in enumerate(rows, 1):
        if i == 1 and row.strip() == "---":
            front = True
            continue
        if front:
            front = row.strip() != "---"
            continue
        mark = row.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = None if fence == mark else fence or mark
            continue
        level = len(row) - len(row.lstrip("#"))
        if fence or not 1 <= level <= 6 or not row[level : level + 1].isspace():
            continue
        if i > start:
            blocks.append((name, start, i - 1))
        stack = [s for s in stack if s[0] < level] + [(level, row[level:].strip())]
        name, start = " > ".join(s[1] for s in stack), i
    return [*blocks, (name, start, len(rows))]


def markdown_blocks(files: DataFrame) -> DataFrame:
    """SC13: (path, name, start, end): sections under their heading paths; lines before the first heading have no name."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *b) for p, t in zip(frame["path"], frame["text"], strict=True) for b in _headings(t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "start", "end"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, start int, end int")
