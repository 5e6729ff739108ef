"""Facts of source texts beyond definitions (SC12-SC15, JD22, PB2): schema blocks, keyed text blocks, imports, comments.

Parsers are Arrow-batched functions over (path, text), one row per fact; what they find is joined and ranked in Spark.
"""

from __future__ import annotations

import io
import json
import re
import tokenize

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# Fixed values.
BLOCK_KINDS = ("model", "view", "enum", "type")
DIRECTIVE = re.compile(r"^\W*(noqa|type:\s*ignore|pylint:|mypy:|eslint-disable|eslint-enable|@ts-ignore|@ts-expect-error|@ts-nocheck|prettier-ignore|istanbul ignore|c8 ignore|nosec|fmt:\s*(on|off)|pragma|isort:|ruff:)", re.I)
DIVIDER = r"^[\s#/*=\-_~+.]*$"
LICENSE = r"(?i)\b(license|copyright|spdx-license-identifier)\b"


def _rows_of(files: DataFrame, find, columns: dict[str, str]) -> DataFrame:
    """find(path, text) -> tuples, as rows of path and columns."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *found) for p, t in zip(frame["path"], frame["text"], strict=True) for found in find(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", *columns])

    return files.select("path", "text").mapInPandas(run, "path string, " + ", ".join(f"`{k}` {v}" for k, v in columns.items()))


def _schema_blocks(_: str, text: str):
    head = re.compile(r"^\s*([A-Za-z]+)\s+([A-Za-z][A-Za-z0-9_]*)\s*\{")
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//.*|([{}])')
    rows = text.split("\n")
    # depth after each line, were every brace outside strings and comments counted
    moves = [sum({"{": 1, "}": -1}.get(m[1], 0) for m in token.finditer(row)) for row in rows]
    at = 0
    while at < len(rows):
        opened = head.match(rows[at])
        end, depth = None, 0
        if opened:
            for i in range(at, len(rows)):
                depth += moves[i]
                if depth <= 0:
                    end = i
                    break
        if end is None:
            at += 1
            continue
        if opened[1] in BLOCK_KINDS:
            yield opened[1], opened[2], at + 1, end + 1
        at = end + 1


def schema_blocks(files: DataFrame) -> DataFrame:
    """SC12: (path, keyword, name, start, end) of model, view, enum and type blocks."""
    return _rows_of(files, _schema_blocks, {"keyword": "string", "name": "string", "start": "int", "end": "int"})


def _keyed_blocks(path: str, text: str):
    """Top-level keys of YAML, tables of TOML, keys of a JSON object; one block for all else."""
    rows = text.split("\n")
    kind = path.rsplit(".", 1)[-1].lower()
    starts: list[tuple[int, str]] = []
    if kind in ("yml", "yaml"):
        starts = [(i, m[1].strip("\"'")) for i, r in enumerate(rows) if (m := re.match(r"([^\s#\-][^:]*):(?:\s|$)", r))]
    elif kind == "toml":
        starts = [(i, m[1].strip()) for i, r in enumerate(rows) if (m := re.match(r"\s*\[+([^\]]+)\]+\s*(?:#.*)?$", r))]
    elif kind == "json":
        try:
            whole = json.loads(text)
        except ValueError:
            whole = None
        if isinstance(whole, dict):
            at = 0
            for key in whole:
                mark = json.dumps(key)
                for i in range(at, len(rows)):
                    if re.match(r"\s{0,4}\{?\s*(?:%s|%s)\s*:" % (re.escape(mark), re.escape(json.dumps(key, ensure_ascii=False))), rows[i]):
                        starts.append((i, key))
                        at = i + 1
                        break
    if not starts:
        yield None, 1, len(rows)
        return
    if starts[0][0] > 0:
        yield None, 1, starts[0][0]
    for (i, name), following in zip(starts, [*(s[0] for s in starts[1:]), len(rows)], strict=True):
        yield name, i + 1, following


def keyed_blocks(files: DataFrame) -> DataFrame:
    """SC13: (path, name, start, end) of YAML, TOML and JSON files, by key."""
    return _rows_of(files, _keyed_blocks, {"name": "string", "start": "int", "end": "int"})


def script_imports(files: DataFrame) -> DataFrame:
    """SC14 for scripts: (path, spec, ord): what is imported, re-exported or required, each once, comments blanked."""
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r"(?m)(^|[\s;])//.*$", "$1")
    found = F.regexp_extract_all(bare, F.lit(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""), F.lit(1))
    return files.select("path", F.posexplode(F.array_distinct(found)).alias("ord", "spec"))


def import_candidates(spec: str = "spec", path: str = "path"):
    """JN11 for Python: the files that a dotted module may be, by priority; relative ones from the importing file's folder."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    above = F.split(path, "/")
    base = F.when(dots > 0, F.array_join(F.slice(above, 1, F.greatest(F.size(above) - dots, F.lit(0))), "/")).otherwise(F.lit(""))
    stem = F.when((base != "") & (module != ""), F.concat_ws("/", base, module)).otherwise(F.concat(base, module))
    parent = F.regexp_replace(stem, r"/?[^/]*$", "")
    ends = [".py", "/__init__.py"]
    return F.array(*[F.concat(s, F.lit(e)) for s in (stem, parent) for e in ends])


def _comments(path: str, text: str):
    if not path.endswith(".py"):
        for m in re.finditer(r"(?m)^\s*//.*(?:\n\s*//.*)*|/\*(?s:.*?)\*/", text):
            first = text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
            yield first, first + m[0].lstrip().count("\n"), m[0].strip(), True
        return
    marks = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                marks.append((token.start[0], token.string, not token.line[: token.start[1]].strip()))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass  # what was read before the error stands
    block: list = []
    for line, string, whole in [*marks, (-9, "", False)]:
        if block and whole and block[2] and line == block[1] + 1:
            block = [block[0], line, True, f"{block[3]}\n{string}"]
            continue
        if block:
            yield block[0], block[1], block[3], block[2]
        block = [line, line, whole, string]


def comments(files: DataFrame) -> DataFrame:
    """JD22/FP16: (path, start, end, text, whole_line, reason): adjacent line comments are one; reason says why one is noise, null where it is kept."""
    found = _rows_of(files, _comments, {"start": "int", "end": "int", "text": "string", "whole_line": "boolean"})
    body = F.transform(F.split("text", "\n"), lambda r: F.regexp_replace(r, r"^\s*(?:#+|//+|/\*+|\*+/?|\*/)\s?", ""))
    directive = F.forall(F.filter(body, lambda r: F.trim(r) != ""), lambda r: r.rlike("(?i)" + DIRECTIVE.pattern))
    some = F.exists(body, lambda r: F.trim(r) != "")
    reason = F.when(F.replace("text", F.lit("\n"), F.lit(" ")).rlike(DIVIDER), "divider").when(some & directive, "tool_directive").when((F.col("start") <= 3) & F.array_join(body, " ").rlike(LICENSE), "licence_header")
    return found.withColumn("reason", reason)


def comments_in_diff(found: DataFrame, changed: DataFrame) -> DataFrame:
    """JN21: comments with a changed line, or right above one."""
    c = changed.select(F.col("path").alias("path2"), F.col("line"))
    near = (F.col("path") == F.col("path2")) & F.col("line").between(F.col("start"), F.col("end") + 1)
    return found.join(c, near, "left_semi")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.language_of(F.col("path"))).withColumn("test", paths.is_test(F.col("path")))
