"""Relations between stored facts (JN1-JN3, JN8, JN11-JN13, JN18, JN22, JN24-JN27, WN8, WN9, ST6, TK8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import cut
from .ranking import best, dealt


def newest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """WN8: the newest n rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """WN9: the newest row of each key, by one aggregation with map-side combine instead of a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*key, "__v.*")


def co_changed(commits: DataFrame, n_newest: int = 200, limit: int = 5) -> DataFrame:
    """JN13: files (path) that share one's newest commits, most often first, ties by path."""
    commits = cut(commits)
    sizes = commits.groupBy("commit").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1))).first()  # rows, and pairs at most
    n, most = (x or 0 for x in sizes)
    recent = newest(dealt(commits, n, "path"), "path", [F.desc("seq"), F.desc("commit")], n_newest)
    other = dealt(commits.select("commit", F.col("path").alias("other")), n, "commit")
    pairs = dealt(recent, n, "commit").join(other, "commit").where("path <> other").select("path", "other")
    counted = dealt(pairs, most, "path").groupBy("path", "other").agg(F.count(F.lit(1)).alias("n"))
    return best(counted, limit, [F.desc("n"), F.col("other")], ["path"])


def similar(sets: DataFrame, subject: Column, limit: int = 10) -> DataFrame:
    """JN22: sets (id, items) by Jaccard similarity with the subject's, only those above 0."""
    one = sets.where(subject).select(F.col("id").alias("sid"), F.col("items").alias("sitems"))  # a single row
    common, either = F.size(F.array_intersect("items", "sitems")), F.size(F.array_union("items", "sitems"))
    scored = sets.join(F.broadcast(one), F.col("id") != F.col("sid")).select("id", F.round(common.cast("double") / either, 6).alias("score"))
    return best(scored.where("score > 0"), limit, [F.desc("score"), F.col("id")])


def binding(calls: DataFrame, definitions: DataFrame, imports: DataFrame, unparsed: DataFrame) -> DataFrame:
    """JN8: the evidence ladder. An unparsed file turns "no definition" into unknown, never into a negative."""
    d = definitions.groupBy("name").agg(F.count(F.lit(1)).alias("n_defs"))
    same = definitions.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n_same"))
    imp = imports.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n_imports"))
    rows = calls.join(unparsed.select("file", F.lit(True).alias("bad")), "file", "left").join(d, "name", "left").join(same, ["name", "file"], "left").join(imp, ["file", "name"], "left")
    state = (
        F.when(F.col("n_defs").isNull() & F.col("bad"), "unknown")
        .when(F.col("n_defs").isNull(), "unresolved")
        .when(F.col("receiver").isNotNull(), "candidate")
        .when(F.col("n_same") == 1, "resolved")
        .when((F.col("n_imports") == 1) & (F.col("n_defs") == 1), "resolved")
        .otherwise("candidate")
    )
    return rows.select(*calls.columns, state.alias("state"))


def first_match(wanted: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """JN11: each specifier's candidate paths in order of priority; the first that is in scope, else null."""
    each = wanted.select("src", "spec", F.posexplode(candidates).alias("priority", "path"))
    hit = each.join(files.select("path").distinct(), "path", "left_semi").groupBy("src", "spec").agg(F.min_by("path", "priority").alias("target"))
    return wanted.select("src", "spec").distinct().join(hit, ["src", "spec"], "left")


def open_questions(items: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """JN24/JN25: what has no stored answer yet."""
    return items.join(answers.select(*key), key, "left_anti")


def layered(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """ST6: the answer of the first layer that has one; its place says which."""
    union = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("layer", F.lit(i))
        union = one if union is None else union.unionByName(one)
    rest = [c for c in union.columns if c not in key]
    return union.groupBy(*key).agg(F.min_by(F.struct(*rest), "layer").alias("__v")).select(*key, "__v.*")


def content_repeats(units: DataFrame) -> DataFrame:
    """JN26: units (id, sha, p): equal contents are judged once; repeats take the answer of the first that has one, or stay unanswered."""
    one = units.groupBy("sha").agg(F.min("id").alias("judged"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("id"))).alias("p1"), F.count(F.lit(1)).alias("n"))
    return units.join(one, "sha").select("id", "judged", F.col("p1").alias("p"), "n")


def known_values(held: DataFrame, least_chars: int = 8, most_files: int = 5) -> DataFrame:
    """JN27: values (value, file) that are long and in few files."""
    return held.where(F.length("value") >= least_chars).groupBy("value").agg(F.countDistinct("file").alias("n_files")).where(F.col("n_files") <= most_files)


def named_by_suffix(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """JN18: path tokens ↔ files that are the token or end with /token, as an equi join on the last segment."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    t, f = tokens.withColumn("__b", base(F.col("token"))), files.withColumn("__b2", base(F.col("path")))
    fits = (F.col("path") == F.col("token")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("token")))
    return t.join(f, (F.col("__b") == F.col("__b2")) & fits).drop("__b", "__b2")


def forget(rows: DataFrame, confirmed: str, before: Column, limit: int, key: str) -> DataFrame:
    """TK8: what stays after deleting the longest unconfirmed first, at most limit rows, none that were confirmed since."""
    gone = rows.where(F.col(confirmed) < before).orderBy(confirmed, key).limit(limit)
    return rows.join(gone.select(key), key, "left_anti")
