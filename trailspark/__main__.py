"""The command line: python -m trailspark stats|units|find|findall|trace|cache|schema ROOT ... (SC26, SC27, SC32, JD23, JD24).

The client replays a JSON-lines file of {"id", "p"} answers (--answers); what it lacks stays unanswered. Results go to
a pack: rows as JSON, a manifest that binds them to the digest of the scope, and a report. Exit: 0 done, 1 stopped by a
refusal, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import search
from .operators.judge import Scripted
from .plans.state import ship
from .sources import text as source


class Refused(RuntimeError):
    pass


def scope(spark: SparkSession, root: str, args: argparse.Namespace) -> DataFrame:
    """FP2/FP7/FP9: (path, text) of a folder; over the cap the counts are refused with, not rows."""
    top = os.path.abspath(root).rstrip("/")
    files = source.from_directory(spark, top).where("text is not null")
    files = files.select(F.expr(f"substring(path, locate('{top}/', path) + {len(top) + 1})").alias("path"), "text")
    wanted = paths.kept(F.col("path"), args.include, args.exclude, with_tests=not args.no_tests, with_docs=True)
    files = files.where(~F.col("path").startswith(".git/") & wanted & paths.left_out(F.col("path"), F.col("text")).isNull())
    n = files.count()
    if args.max_files and n > args.max_files:
        by = files.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(20)
        raise Refused(f"{n} files are over the cap of {args.max_files}: " + ", ".join(f"{r['folder']} {r['n']}" for r in by.collect()))
    return files


def identity(files: DataFrame) -> str:
    """SC27: a digest of the scope's paths and contents, in any order."""
    row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "text").cast("decimal(38,0)"))).first()
    return f"{row[0]}-{row[1]}"


def pack(rows: DataFrame, files: DataFrame, to: str, title: str, stop: str) -> None:
    rows.write.mode("overwrite").json(os.path.join(to, "rows"))
    with open(os.path.join(to, "manifest.json"), "w") as f:
        json.dump({"command": title, "scope": identity(files), "stop": stop, "columns": rows.columns}, f, indent=1)
    head = rows.limit(50).collect()
    with open(os.path.join(to, "report.md"), "w") as f:
        f.write(f"# {title}\n\nStopped: {stop}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}\n")
        f.writelines(f"| {' | '.join(str(v) for v in r)} |\n" for r in head)


def resume(spark: SparkSession, files: DataFrame, to: str) -> DataFrame:
    """SC27: a pack's rows, refused where the scope has changed since."""
    with open(os.path.join(to, "manifest.json")) as f:
        if json.load(f)["scope"] != identity(files):
            raise Refused("the scope has changed since the pack was written")
    return spark.read.json(os.path.join(to, "rows"))


def statistics(ix: search.Index) -> DataFrame:
    """JD23: per file its lines, functions and classes, and the largest definition."""
    defs = ix.definitions.withColumn("size", F.col("end") - F.col("start") + 1)
    counted = defs.groupBy("path").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.max("size").alias("largest"))
    sized = ix.files.select("path", F.size(F.split("text", "\n", -1)).alias("lines"))
    bad = ix.facts.where("kind = 'unparsed'").select("path", F.lit(True).alias("unparsed"))
    return sized.join(counted, "path", "left").join(bad, "path", "left").orderBy("path")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trailspark")
    p.add_argument("command", choices=["stats", "units", "find", "findall", "trace", "resume", "schema"])
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("question", nargs="?", default="")
    p.add_argument("--name", action="append", default=[], help="a name to search for")
    p.add_argument("--start", action="append", default=[], help="PATH:LINE")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--no-tests", action="store_true")
    p.add_argument("--max-files", type=int)
    p.add_argument("--calls", type=int, default=24)
    p.add_argument("--answers", help="JSON lines of id and p to replay")
    p.add_argument("--out", help="folder of the pack")
    args = p.parse_args(argv)
    if args.command == "schema":
        print(json.dumps({a.dest: (a.choices and list(a.choices)) or getattr(a.type, "__name__", "string") for a in p._actions if a.dest != "help"}, indent=1))
        return 0
    spark = SparkSession.builder.appName("trailspark").getOrCreate()
    ship(spark)
    try:
        files = scope(spark, args.root, args)
        answers = {}
        if args.answers:
            with open(args.answers) as f:
                answers = {r["id"]: r["p"] for r in map(json.loads, f)}
        client, stop = Scripted(answers), "done"
        if args.command == "resume":
            rows = resume(spark, files, args.out)
        else:
            ix = search.Index.of(files)
            at = [(s.rpartition(":")[0], int(s.rpartition(":")[2])) for s in args.start]
            seeds = search.Seeds(names=args.name, texts=[args.question] if args.question else [], anchors=at)
            if args.command == "stats":
                rows = statistics(ix)
            elif args.command == "units":
                rows = ix.units.drop("code")
            elif args.command == "findall":
                rows, stop = search.find_all(ix, {"target": args.question}, seeds, client, args.calls)
            else:
                units = [r["unit"] for r in search.units_reached(ix, search.reach(ix, seeds, {"anchor": search.anchor_source})).collect()]
                if args.command == "find":
                    rows, stop = search.find_code(ix, units, client, steps=args.calls)
                else:
                    rows, _ = search.trace_workflow(ix, units, [args.question], client, args.calls)
        if args.out and args.command != "resume":
            pack(rows, files, args.out, args.command, stop)
        rows.show(50, truncate=80)
    except Refused as refusal:
        print(refusal, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
