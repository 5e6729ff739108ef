"""Sources over git (SC2, SC4-SC6, SC16, SC17, LK10): listings and logs are small and read on the driver; contents are not.

A command's output becomes a DataFrame of its lines, and everything from there on is Spark. File contents come from
binaryFile, or from git objects by tasks that each export a bounded chunk of paths.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ToolFailed(RuntimeError):
    pass


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=off", *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise ToolFailed(done.stderr.strip())
    return done.stdout


def tracked(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """SC2: (path, reason): files at HEAD; what is no regular file has a reason."""
    kinds = {"120000": "symlink", "160000": "nested repository"}
    rows = []
    for entry in git(root, "ls-tree", "-r", "-z", "HEAD").split("\0"):
        if entry:
            meta, path = entry.split("\t", 1)
            if not prefixes or path.startswith(prefixes):
                rows.append((path, kinds.get(meta.split(" ", 1)[0])))
    return spark.createDataFrame(rows, "path string, reason string")


def working(spark: SparkSession, root: str) -> DataFrame:
    """SC5: (path, reason): tracked files, and untracked or ignored ones with the reason that leaves them out."""
    listed = [(p, None) for p in git(root, "ls-files", "-z").split("\0") if p]
    listed += [(p, "untracked") for p in git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p]
    listed += [(p.rstrip("/"), "ignored") for p in git(root, "ls-files", "-z", "--others", "--ignored", "--exclude-standard", "--directory").split("\0") if p]
    return spark.createDataFrame(listed, "path string, reason string")


def collapsed(rows: DataFrame) -> DataFrame:
    """SC6: left-out paths by the outermost folder that holds no kept file: (folder, n)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    kept = rows.where("reason is null").select(F.explode(above).alias("folder")).distinct()
    gone = rows.where("reason is not null").select("path", F.posexplode(above).alias("depth", "folder"))
    return gone.join(kept, "folder", "left_anti").groupBy("path").agg(F.min_by("folder", "depth").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def at_commit(spark: SparkSession, root: str, commit: str, prefixes: tuple[str, ...] = (), chunk: int = 200) -> DataFrame:
    """SC4: (path, text) as of a commit; the tasks need the repository at root."""
    sha = git(root, "rev-parse", "--verify", "--end-of-options", f"{commit}^{{commit}}").strip()
    paths = [p for p in git(root, "ls-tree", "-r", "-z", "--name-only", sha).split("\0") if p and (not prefixes or p.startswith(prefixes))]

    def run(frames):
        for frame in frames:
            frame = frame.copy()
            frame["text"] = [git(root, "show", f"{sha}:{p}") for p in frame["path"]]
            yield frame

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, len(paths) // chunk)).mapInPandas(run, "path string, text string")


def commits(spark: SparkSession, root: str, newest: int = 200) -> DataFrame:
    """SC16: (commit, seq, path), the newest of each path; seq falls with age."""
    rows, sha, n = [], None, 0
    for line in git(root, "log", "--format=%x01%H", "--name-only", "--no-renames").split("\n"):
        if line.startswith("\1"):
            sha, n = line[1:], n - 1
        elif line:
            rows.append((sha, n, line))
    table = spark.createDataFrame(rows, "commit string, seq long, path string")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), "commit"))
    return table.withColumn("r", rank).where(F.col("r") <= newest).drop("r")


def changed_lines(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """SC17: (path, line) that a diff adds or changes, from its hunk headers."""
    diff = git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", base, head).split("\n")
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(diff) if d.startswith(("+++ ", "@@ "))], "i long, d string")
    path = F.last(F.when(F.col("d").startswith("+++ b/"), F.expr("substring(d, 7)")), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("i"))  # a diff's headers, from the driver
    hunk = lambda g: F.regexp_extract("d", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", g)
    hunks = rows.withColumn("path", path).where(F.col("d").startswith("@@ "))
    sized = hunks.select("path", hunk(1).cast("int").alias("start"), F.when(hunk(2) == "", 1).otherwise(hunk(2).try_cast("int")).alias("n")).where("n > 0")
    return sized.select("path", F.explode(F.expr("sequence(start, start + n - 1)")).alias("line"))
