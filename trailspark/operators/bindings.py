"""What a use of a name stands for (JN9, JN10, GR7): an injected answer, a local value, a module or import followed through re-exports, else the evidence ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut
from .relate import binding as ladder


def exporters(wanted: DataFrame, reexports: DataFrame) -> DataFrame:
    """GR7: (target, name, path, proven): every module through which a name of a target module may come.

    wanted: (target, name, proven). reexports: (path, name, next, proven); a null name passes on all. Only what a round
    reached for the first time goes on, so cycles end, and a chain is as proven as its least proven link.
    """
    frontier = cut(wanted.select("target", "name", F.col("target").alias("path"), "proven").distinct())
    reached = frontier
    reexports = cut(reexports)  # each round reads them
    named = reexports.where("name is not null").select("path", "name", "next", F.col("proven").alias("link"))
    whole = reexports.where("name is null").select("path", "next", F.col("proven").alias("link"))
    while True:
        steps = frontier.join(named, ["path", "name"]).select("target", "name", "next", "proven", "link")
        steps = steps.unionByName(frontier.join(whole, "path").select("target", "name", "next", "proven", "link"))
        ahead = steps.select("target", "name", F.col("next").alias("path"), (F.col("proven") & F.col("link")).alias("proven")).distinct()
        frontier = cut(ahead.join(reached, ["target", "name", "path", "proven"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)  # tables of the rounds; none is written twice
    return reached.groupBy("target", "name", "path").agg(F.max("proven").alias("proven"))


def through_modules(wanted: DataFrame, reexports: DataFrame, definitions: DataFrame, unparsed: DataFrame) -> DataFrame:
    """JN10: (target, name, state, defined_in): the one proven definition among the exporters resolves; one in a file that was not parsed may hide it."""
    paths = exporters(wanted, reexports)
    n = definitions.groupBy(F.col("file").alias("path"), "name").agg(F.count(F.lit(1)).alias("n"))
    hidden = unparsed.select(F.col("file").alias("path"), F.lit(True).alias("bad")).distinct()
    rows = paths.join(n, ["path", "name"], "left").join(hidden, "path", "left")
    defined = F.col("n").isNotNull()
    by = rows.groupBy("target", "name").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n_defs"), F.max(F.when(defined, F.col("path"))).alias("only"), F.max(F.when(defined, F.col("proven"))).alias("sure"),
        F.coalesce(F.bool_or("bad"), F.lit(False)).alias("hides"),
    )
    one = (F.col("n_defs") == 1) & F.col("sure") & ~F.col("hides")
    state = F.when(F.col("hides"), "unknown").when(one, "resolved").otherwise("candidate")
    return by.select("target", "name", state.alias("state"), F.when(one, F.col("only")).alias("defined_in"))


def bindings(uses: DataFrame, resolver: DataFrame, locals_: DataFrame, aliases: DataFrame, imported: DataFrame, reexports: DataFrame, definitions: DataFrame, unparsed: DataFrame) -> DataFrame:
    """JN9: uses (file, line, name, receiver) with state, defined_in and via (resolver, local, module, import or facts).

    resolver: (file, line, name, state, defined_in), which wins. locals_: (file, name, first, last), where a function binds
    a name itself. aliases: (file, receiver, target), names that hold a whole module. imported: (file, name, target,
    exported), null target out of scope. A file's own definition goes before its import of the same name.
    """
    uses, definitions, unparsed = uses.dropDuplicates(["file", "line", "name", "receiver"]), cut(definitions), cut(unparsed.select("file"))  # the latter are read several times
    given = resolver.select("file", "line", "name", F.struct("state", "defined_in", F.lit("resolver").alias("via")).alias("given")).dropDuplicates(["file", "line", "name"])
    looked_up = F.coalesce("receiver", "name")
    l = locals_.select(F.col("file").alias("lf"), F.col("name").alias("ln"), "first", "last")  # noqa: E741
    inside = (F.col("file") == F.col("lf")) & (looked_up == F.col("ln")) & F.col("line").between(F.col("first"), F.col("last"))
    held = uses.join(l, inside, "left_semi").withColumn("is_local", F.lit(True)).withColumn("__r", F.coalesce("receiver", F.lit(""))).drop("receiver")
    own = definitions.select("file", "name", F.lit(True).alias("own")).distinct()
    modules = aliases.where("target is not null").dropDuplicates(["file", "receiver"]).withColumnRenamed("target", "module")
    by_name = imported.where("target is not null").dropDuplicates(["file", "name"]).select("file", "name", F.col("target").alias("source"), F.coalesce("exported", F.lit("default")).alias("exported"))
    rows = uses.withColumn("__r", F.coalesce("receiver", F.lit(""))).join(given, ["file", "line", "name"], "left").join(held, ["file", "line", "name", "__r"], "left")
    rows = rows.join(modules, ["file", "receiver"], "left").join(by_name, ["file", "name"], "left").join(own, ["file", "name"], "left")
    free, plain = F.col("is_local").isNull(), F.col("receiver").isNull()
    via = (
        F.when(F.col("given").isNotNull(), "resolver").when(~free & plain, "local").when(free & ~plain & F.col("module").isNotNull(), "module")
        .when(free & plain & F.col("source").isNotNull() & F.col("own").isNull(), "import").otherwise("facts")
    )
    rows = rows.withColumn("via", via)
    target, wanted_name = F.when(F.col("via") == "module", F.col("module")).when(F.col("via") == "import", F.col("source")), F.when(F.col("via") == "import", F.col("exported")).otherwise(F.col("name"))
    rows = cut(rows.select("file", "line", "name", "receiver", "given", "via", target.alias("target"), wanted_name.alias("wanted")))
    asked = rows.where("target is not null").select("target", F.col("wanted").alias("name"), F.lit(True).alias("proven")).distinct()
    led = through_modules(asked, reexports, definitions, unparsed).withColumnsRenamed({"name": "wanted", "state": "led_state", "defined_in": "led_in"})
    none = definitions.select("file", "name").limit(0)
    facts = ladder(rows.where("via = 'facts'").select("file", "line", "name", "receiver"), definitions, none, unparsed.select("file").distinct())
    # The ladder resolves here by one definition in the file alone: imports were followed above.
    facts = facts.withColumn("defined_in", F.when(F.col("state") == "resolved", F.col("file"))).withColumn("via", F.lit("facts"))
    other = rows.where("via <> 'facts'").join(led, ["target", "wanted"], "left")
    state = F.when(F.col("via") == "resolver", F.col("given.state")).when(F.col("via") == "local", "candidate").otherwise(F.col("led_state"))
    where = F.when(F.col("via") == "resolver", F.col("given.defined_in").cast(dict(definitions.dtypes)["file"])).otherwise(F.col("led_in"))
    out = ["file", "line", "name", "receiver", "state", "defined_in", "via"]
    return other.select("file", "line", "name", "receiver", state.alias("state"), where.alias("defined_in"), "via").unionByName(facts.select(*out))
