"""Searches over an index of source texts (JD6-JD10, JD21, JN30, AG8, AG11, WN6, WN18): sources, features, waves, navigation, traces.

An ``Index`` is a handful of tables. A source is a function from seeds to reaches (path, line or null, name, distance);
reaches become units by an interval join; values rank units per target; only a wave (requests x 16 rows) ever comes to
the driver, which is where budgets are exact and stop rules live. Unanswered rows stay null: they are never a "no".
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mentions, paths, text
from ..plans.state import cut
from ..sources import code as code_facts
from ..sources import script
from ..sources import text as source
from . import graph, ranking
from .judge import Client, ask, round_robin

REACH = "path string, line int, name string, distance int, source string, ord int"
PIECE = 60


@dataclass
class Index:
    """files (path, text); lines; facts (definitions, calls, imports); units (unit, path, start, end, symbol, sha, code, test)."""

    files: DataFrame
    lines: DataFrame
    facts: DataFrame
    units: DataFrame
    links: DataFrame

    @classmethod
    def of(cls, files: DataFrame) -> Index:
        """SC1/JD21: every file once; Python files and scripts by their outermost definitions, others by blocks or pieces of 60 lines."""
        files = cut(files.select("path", "text").dropDuplicates(["path"]))
        lines = source.lines(files, "path")
        parsed = files.where(paths.language_of(F.col("path")) == "python")
        scripts = files.where(paths.language_of(F.col("path")).isin("javascript", "typescript", "tsx"))
        facts = cut(source.python_facts(parsed).unionByName(script.script_facts(scripts)))
        defs = facts.where("kind in ('function', 'class')")
        o = defs.select(F.col("path").alias("path2"), F.col("start").alias("os"), F.col("end").alias("oe"))
        held = (F.col("path") == F.col("path2")) & (F.col("os") <= F.col("start")) & (F.col("oe") >= F.col("end")) & (F.col("oe") - F.col("os") > F.col("end") - F.col("start"))
        outer = defs.join(o, held, "left_anti").select("path", "start", "end", F.col("name").alias("symbol"))
        schema = code_facts.schema_blocks(files.where(F.col("path").endswith(".prisma"))).select("path", "start", "end", F.concat_ws(" ", "keyword", "name").alias("symbol"))
        marked = source.markdown_blocks(files.where(paths.is_markup(F.col("path")))).select("path", "start", "end", F.coalesce("name", F.lit("")).alias("symbol"))
        keyed = code_facts.keyed_blocks(files.where(paths.suffix_of(F.col("path")).isin("yml", "yaml", "toml", "json"))).select("path", "start", "end", F.coalesce("name", F.lit("")).alias("symbol"))
        listed = outer.unionByName(schema).unionByName(marked).unionByName(keyed)
        sized = files.select("path", F.size(F.split("text", "\n", -1)).alias("n")).join(listed.select("path").distinct(), "path", "left_anti")
        rest = sized.select("path", "n", F.explode(F.expr(f"sequence(1, n, {PIECE})")).alias("start")).select("path", "start", F.expr(f"least(start + {PIECE - 1}, n)").alias("end"), F.lit("").alias("symbol"))
        spans = listed.unionByName(rest).join(files, "path")
        code = F.array_join(F.expr("slice(split(text, '\n', -1), start, end - start + 1)"), "\n")
        units = spans.select(F.concat_ws(":", "path", "start", "end").alias("unit"), "path", "start", "end", "symbol", code.alias("code"), paths.is_test(F.col("path")).alias("test"))
        units = cut(units.withColumn("sha", F.sha2("code", 256)))
        return cls(files, lines, facts, units, cut(import_links(files, facts)))

    @property
    def definitions(self) -> DataFrame:
        return self.facts.where("kind in ('function', 'class')")

    @property
    def calls(self) -> DataFrame:
        return self.facts.where("kind = 'call'")


def import_links(files: DataFrame, facts: DataFrame) -> DataFrame:
    """JN11/JN12: (src, spec, target): import edges; target is null outside the index."""
    wanted = facts.where("kind = 'import'").select(F.col("path").alias("src"), F.col("name").alias("spec"))
    scripts = files.where(paths.language_of(F.col("path")).isin("javascript", "typescript", "tsx"))
    named = code_facts.script_imports(scripts).select(F.col("path").alias("src"), "spec")
    candidates = F.posexplode(script.import_candidates(F.col("spec"), F.col("src"))).alias("priority", "path")
    each = wanted.select("src", "spec", F.posexplode(code_facts.import_candidates("spec", "src")).alias("priority", "path")).unionByName(named.select("src", "spec", candidates))
    wanted = wanted.unionByName(named)
    hit = each.join(files.select("path"), "path", "left_semi").groupBy("src", "spec").agg(F.min_by("path", "priority").alias("target"))
    return wanted.distinct().join(hit, ["src", "spec"], "left")


@dataclass
class Seeds:
    names: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    anchors: list[tuple[str, int]] = field(default_factory=list)


Source = Callable[[Index, Seeds], DataFrame]


def _reaches(rows: DataFrame, name: str, distance: int) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in (("line", "int"), ("name", "string")) if c not in rows.columns}
    return rows.withColumns(missing).select("path", F.col("line").cast("int").alias("line"), "name", F.lit(distance).alias("distance"), F.lit(name).alias("source"))


def _spark(ix: Index) -> SparkSession:
    return ix.files.sparkSession


def _table(ix: Index, rows: Iterable[tuple], schema: str) -> DataFrame:
    return _spark(ix).createDataFrame(list(rows), schema)  # a request's own seeds


def _names(ix: Index, seeds: Seeds) -> DataFrame:
    return _table(ix, [(n,) for n in dict.fromkeys(seeds.names)], "name string")


def anchor_source(ix: Index, seeds: Seeds) -> DataFrame:
    return _reaches(_table(ix, seeds.anchors, "path string, line int"), "anchor", 0)


def file_source(ix: Index, seeds: Seeds) -> DataFrame:
    """Near files (an anchor's or imported by it) at 1, others at 2."""
    own = _table(ix, [(p,) for p, _ in seeds.anchors], "path string")
    near = own.union(ix.links.join(own, F.col("src") == F.col("path"), "left_semi").where("target is not null").select("target")).distinct().withColumn("near", F.lit(True))
    rows = _table(ix, [(f,) for f in seeds.files], "path string").join(near, "path", "left")
    return _reaches(rows, "file", 2).withColumn("distance", F.lit(2)).join(near, "path", "left").withColumn("distance", F.when(F.col("near"), 1).otherwise(2)).drop("near")


def name_source(ix: Index, seeds: Seeds) -> DataFrame:
    """SC19: the lines that hold a name."""
    return _reaches(source.search(ix.lines, seeds.names).select("path", "line", F.col("term").alias("name")), "name", 3) if seeds.names else _nothing(ix)


def _nothing(ix: Index) -> DataFrame:
    return _spark(ix).createDataFrame([], REACH).drop("ord")


def definition_source(ix: Index, seeds: Seeds) -> DataFrame:
    return _reaches(ix.definitions.join(F.broadcast(_names(ix, seeds)), "name").select("path", F.col("start").alias("line"), "name"), "definition", 1)


def caller_source(ix: Index, seeds: Seeds) -> DataFrame:
    """JN3: call sites of the names; a plain call wins over one with a receiver on the same line."""
    sites = ix.calls.join(F.broadcast(_names(ix, seeds)), "name").select("path", F.col("start").alias("line"), "name", "receiver")
    once = ranking.first_wins(sites, ["path", "line", "name"], [F.col("receiver").isNotNull().cast("int"), F.col("receiver")])
    return _reaches(once, "caller", 1)


def callee_source(ix: Index, seeds: Seeds) -> DataFrame:
    """JN4/JN14: definitions of what the named functions call."""
    own = ix.definitions.join(F.broadcast(_names(ix, seeds)), "name").select(F.col("path").alias("path2"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = ix.calls.join(own, (F.col("path") == F.col("path2")) & F.col("start").between(F.col("s"), F.col("e")), "left_semi").select("name").distinct()
    return _reaches(ix.definitions.join(inside, "name").select("path", F.col("start").alias("line"), "name"), "callee", 1)


def import_source(ix: Index, seeds: Seeds) -> DataFrame:
    own = _table(ix, [(f,) for f in seeds.files], "src string")
    return _reaches(ix.links.join(F.broadcast(own), "src", "left_semi").where("target is not null").select(F.col("target").alias("path")).distinct(), "import", 1)


def importer_source(ix: Index, seeds: Seeds) -> DataFrame:
    own = _table(ix, [(f,) for f in seeds.files], "target string")
    return _reaches(ix.links.join(F.broadcast(own), "target", "left_semi").select(F.col("src").alias("path")).distinct(), "importer", 1)


def named_file_source(ix: Index, seeds: Seeds) -> DataFrame:
    """JN18: files that a text names, by an equi join on the last segment."""
    from .relate import named_by_suffix

    asked = _table(ix, [(t,) for t in seeds.texts], "text string").select(F.explode(mentions.paths_in(F.col("text"))).alias("token"))
    return _reaches(named_by_suffix(asked.distinct(), ix.files.select("path")).select("path", F.col("token").alias("name")), "named_file", 1)


def file_word_source(ix: Index, seeds: Seeds) -> DataFrame:
    """Files whose path holds words of the request."""
    words = _table(ix, [(t,) for t in seeds.texts], "text string").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    parts = ix.files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("path"), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("word"))
    return _reaches(parts.join(F.broadcast(words), "word").select("path", F.col("word").alias("name")), "file_word", 1)


def literal_source(ix: Index, seeds: Seeds) -> DataFrame:
    held = [r["v"] for r in _table(ix, [(t,) for t in seeds.texts], "text string").select(F.explode(mentions.literals_in(F.col("text"))).alias("v")).collect()]  # of the request's own texts
    open_lines = ix.lines.where(~paths.is_lockfile(F.col("path")))
    return _reaches(source.search(open_lines, held).select("path", "line", F.col("term").alias("name")), "literal", 2) if held else _nothing(ix)


def spelling_source(ix: Index, seeds: Seeds) -> DataFrame:
    """SF3: other spellings of a name; a hit counts for the original."""
    forms = _names(ix, seeds).select("name", F.explode(text.spelling_variants(F.col("name"))).alias("form")).where("form <> name")
    words = ix.lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("form"))
    return _reaches(words.join(F.broadcast(forms), "form").select("path", "line", "name"), "spelling", 3)


def model_source(ix: Index, seeds: Seeds) -> DataFrame:
    """JN17: schema blocks that the seeds' code queries; blocks are found by the accessor word, an equi join."""
    blocks = ix.units.where(F.col("symbol").rlike("^(model|view) ")).select("path", "start", F.expr("substring_index(symbol, ' ', -1)").alias("name"))
    accessor = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    called = ix.lines.join(F.broadcast(_table(ix, [(f,) for f in seeds.files], "path string")), "path", "left_semi").select(F.explode(F.regexp_extract_all("text", F.lit(r"\.(\w+)(?=\.)"), F.lit(1))).alias("a")).distinct()
    return _reaches(blocks.join(called, accessor == F.col("a"), "left_semi").select("path", F.col("start").alias("line"), "name"), "model", 1)


def scent_source(ix: Index, seeds: Seeds, limit: int = 20) -> DataFrame:
    """BM25's best units for the texts and names as one query; distance is 4 + rank."""
    terms = _table(ix, [(" ".join([*seeds.texts, *seeds.names]),)], "text string").select(F.lit("q").alias("query"), F.explode(text.words(F.col("text"))).alias("term"))
    scored = ranking.bm25(ix.units.select(F.col("unit").alias("doc"), F.col("code").alias("text")), text.words(F.col("text")), terms)
    top = ranking.best(scored.where("score > 0"), limit, [F.desc("score"), F.col("doc")])
    rows = top.join(ix.units, F.col("doc") == F.col("unit")).select("path", F.col("start").alias("line"), "rank")
    return _reaches(rows, "scent", 4).join(rows.select("path", "line", "rank"), ["path", "line"]).withColumn("distance", 4 + F.col("rank")).drop("rank").select("path", "line", "name", "distance", "source")


def reached_source(rows: DataFrame, name: str) -> Source:
    """Given reaches under a name of their own."""
    return lambda ix, seeds: rows.select("path", "line", "name", "distance", F.lit(name).alias("source"))


SOURCES: dict[str, Source] = {
    "anchor": anchor_source, "file": file_source, "name": name_source, "caller": caller_source, "callee": callee_source, "definition": definition_source, "import": import_source, "importer": importer_source,
    "named_file": named_file_source, "file_word": file_word_source, "literal": literal_source, "spelling": spelling_source, "model": model_source, "scent": scent_source,
}


def reach(ix: Index, seeds: Seeds, sources: dict[str, Source]) -> DataFrame:
    """ST1: every source's reaches, with provenance."""
    out = None
    for i, f in enumerate(sources.values()):
        one = f(ix, seeds).select("path", "line", "name", "distance", "source", F.lit(i).alias("ord"))
        out = one if out is None else out.unionByName(one)
    return cut(out)


def units_reached(ix: Index, reaches: DataFrame) -> DataFrame:
    """JN30/WN11: (unit, distance, source, …), each once, at its smallest distance, the earlier source on a tie."""
    u = ix.units.withColumnsRenamed({"path": "path2"})
    fits = (F.col("path") == F.col("path2")) & (F.col("line").isNull() | F.col("line").between(F.col("start"), F.col("end")))
    hit = reaches.join(u, fits)
    nearest = hit.groupBy("unit").agg(F.min_by(F.struct("distance", "source"), F.struct("distance", "ord")).alias("r"))
    return ix.units.join(nearest, "unit").select("unit", "path", "start", "end", "symbol", "code", "sha", "test", F.col("r.distance").alias("distance"), F.col("r.source").alias("source"))


def valued(units: DataFrame, names: DataFrame, targets: DataFrame) -> DataFrame:
    """WN6: units per target with value = rarities + 2 x defines + file named - distance / 10 - test.

    names: (name, rarity). A target (target, description) counts the names that it spells out, or all if none.
    """
    own = targets.join(F.broadcast(names), mentions.holds_word(F.col("description"), F.col("name"))).select("target", "name", "rarity")  # a request's targets and names
    none = targets.join(own.select("target").distinct(), "target", "left_anti").crossJoin(names).select("target", "name", "rarity")
    per_target = own.unionByName(none).groupBy("target").agg(F.collect_list(F.struct("name", "rarity")).alias("names"))
    asked = targets.select("target").join(per_target, "target", "left")
    rows = units.crossJoin(F.broadcast(asked))  # the targets of one request
    held = F.filter("names", lambda n: mentions.holds_word(F.col("code"), n["name"]))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    rarity = F.coalesce(F.aggregate(held, F.lit(0.0), lambda a, n: a + n["rarity"]), F.lit(0.0))
    defines = F.coalesce(F.exists("names", lambda n: n["name"] == F.regexp_extract("symbol", r"([^.\s]*)$", 1)), F.lit(False))
    stem = F.regexp_replace(paths.name_of(F.col("path")), r"(?<=.)\.[^.]*$", "")
    filed = F.coalesce(F.exists("names", lambda n: bare(n["name"]) == bare(stem)), F.lit(False))
    value = rarity + 2.0 * defines.cast("double") + filed.cast("double") - 0.1 * F.col("distance") - F.col("test").cast("double")
    return rows.withColumn("value", F.round(value, 9)).drop("names")


def find_all(ix: Index, targets: dict[str, str], seeds: Seeds, client: Client, budget: int, sources: dict[str, Source] | None = None, hops: dict[str, Source] | None = None, size: int = 16, waves: int = 1, yes: float = 0.8, shares: dict[str, float] | None = None, first_only: bool = False) -> tuple[DataFrame, str]:
    """JD8: judges what the sources reach, best value first, until the requests are spent or every target has settled.

    (unit, target, p, value, source, distance, repeat_of, reason) of every reached unit and target, and why it stopped.
    A target settles once a unit clears ``yes`` and that unit's one-step hops are judged. Units of equal code are judged
    once; ``reason`` says why a row has no answer.
    """
    spark = _spark(ix)
    picked = sources or {k: SOURCES[k] for k in ("anchor", "file", "name")}
    hops = {k: SOURCES[k] for k in ("caller", "callee")} if hops is None else hops
    reaches = reach(ix, seeds, picked)
    counts = ranking.rarities(_names(ix, seeds), reaches.where("name is not null").select("name", F.concat_ws(":", "path", "line").alias("at")))
    names = cut(counts.select("name", "rarity"))
    asked = spark.createDataFrame(list(targets.items()), "target string, description string")
    value = lambda rows: valued(rows, names, asked)
    pool = cut(value(units_reached(ix, reaches)))
    answers = spark.createDataFrame([], "unit string, p double, target string")
    contents = lambda got: got.join(ix.units.select("unit", "sha"), "unit")
    hopped = spark.createDataFrame([], "target string, unit string, distance long")
    expanded: set[str] = set()
    spent, stop = 0, "exhausted"
    shares = shares or dict.fromkeys(targets, 1.0)
    done: set[str] = set()  # judged places: as many as requests allow
    yes_of: dict[str, set[str]] = {t: set() for t in targets}
    while True:
        once = ranking.first_wins(pool, ["target", "sha"], [F.desc("value"), F.col("unit")])
        open_rows = once.join(contents(answers).select("sha"), "sha", "left_anti")
        queue = ranking.best(open_rows, size * waves, [F.desc("value"), F.col("sha"), F.col("unit")], ["target"]).select("target", "unit", "rank").collect()  # a wave per target
        waiting: dict[str, list[str]] = {t: [] for t in targets}
        if expanded:
            one = ranking.first_wins(hopped.join(ix.units.select("unit", "sha"), "unit"), ["target", "sha"], [F.col("distance"), F.col("unit")])
            open_hops = one.join(contents(answers).select("target", "sha"), ["target", "sha"], "left_anti")
            for r in ranking.best(open_hops, size * waves, [F.col("distance"), F.col("unit")], ["target"]).orderBy("target", "rank").collect():  # a wave per target
                waiting[r["target"]].append(r["unit"])
        settled = {t for t in targets if yes_of[t] and not waiting[t]}
        if len(settled) == len(targets):
            stop = "settled"
            break
        queues = {t: waiting[t] + ([] if yes_of[t] else [r["unit"] for r in sorted(queue, key=lambda r: r["rank"]) if r["target"] == t]) for t in targets if t not in settled}
        order: list[str] = []
        at = dict.fromkeys(queues, 0)
        for t in round_robin({t: shares[t] for t in queues}, {t: len(q) for t, q in queues.items()}, sum(map(len, queues.values()))):
            unit = queues[t][at[t]]
            at[t] += 1
            if unit not in order and unit not in done and len(order) < size * waves:
                order.append(unit)
        if not order:
            break
        got = []
        for i in range(0, len(order), size):
            if spent == budget:
                stop = "call cap"
                break
            batch = order[i : i + size]
            for t in targets:
                got += [(u, p, t) for u, p, _ in ask(client, spent, [f"{t}|{u}" for u in batch])]
            spent += 1
            done.update(batch)
        got = [(u.split("|", 1)[1], p, t) for u, p, t in got]
        if got:
            answers = cut(answers.unionByName(spark.createDataFrame(got, "unit string, p double, target string")))
        fresh = {(t, u) for u, p, t in got if p is not None and p >= yes}
        for t, u in fresh:
            yes_of[t].add(u)
        if first_only and fresh:
            stop = "found"
            break
        if stop == "call cap":
            break
        new = {u for _, u in fresh} - expanded
        if new and hops:
            expanded |= new
            symbols = [r["symbol"] for r in ix.units.where(F.col("unit").isin(*new)).select("symbol").collect() if r["symbol"]]
            found = cut(units_reached(ix, reach(ix, Seeds(names=symbols), hops)).where(~F.col("unit").isin(*new)))
            pool = cut(pool.unionByName(value(found).join(pool.select("unit", "target"), ["unit", "target"], "left_anti")))
            # the hops stay a table, of which each round draws the nearest that are open
            now = spark.createDataFrame([(t,) for t in sorted({t for t, u in fresh if u in new})], "target string")
            near = cut(hopped.unionByName(now.crossJoin(found.select("unit", "distance"))))
            hopped = cut(near.groupBy("target", "unit").agg(F.min("distance").alias("distance")))
    # JN26: copies take the answer of the one that was judged
    judged = contents(answers).groupBy("target", "sha").agg(F.min_by(F.struct("p", "unit"), "unit").alias("j"))
    result = pool.join(judged, ["target", "sha"], "left").withColumns({"p": F.col("j.p"), "unit2": F.col("j.unit")})
    answered = F.col("unit2").isNotNull()
    reason = F.when(F.col("p").isNotNull(), None).when(answered, "unanswered").otherwise("not reached")
    return result.select("unit", "target", "p", "value", "source", "distance", F.when(F.col("unit2") != F.col("unit"), F.col("unit2")).alias("repeat_of"), reason.alias("reason")), stop


def point_results(rows: DataFrame, bar: float = 0.8, failure: bool = False) -> DataFrame:
    """AG11: per target the best probability, how many units were judged, how many not, and the outcome."""
    best, judged = F.max("p"), F.count("p")
    outcome = F.when(best >= bar, "found").when((judged == 0) | F.lit(failure), "unknown").otherwise("none among judged")
    return rows.groupBy("target").agg(outcome.alias("outcome"), best.alias("best"), judged.alias("judged"), F.count_if(F.col("p").isNull()).alias("not_judged"))


def coverage(rows: DataFrame) -> DataFrame:
    """AG12/AG18: what was left, by source and reason."""
    return rows.where("p is null").groupBy("target", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


def call_edges(ix: Index) -> DataFrame:
    """JN14/JN23: (src, dst, weight) between units: a call inside src whose name a unit dst defines."""
    u = ix.units.select(F.col("unit").alias("src"), F.col("path").alias("path2"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = ix.calls.join(u, (F.col("path") == F.col("path2")) & F.col("start").between(F.col("s"), F.col("e"))).select("src", "name")
    d = ix.units.where("symbol <> ''").select(F.col("unit").alias("dst"), F.regexp_extract("symbol", r"([^.\s]*)$", 1).alias("name"))
    return inside.join(d, "name").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def co_file_edges(ix: Index) -> DataFrame:
    """Each unit with the next of its file."""
    after = F.lead("unit").over(Window.partitionBy("path").orderBy("start", "unit"))
    return ix.units.select(F.col("unit").alias("src"), after.alias("dst"), F.lit(0.5).alias("weight")).where("dst is not null")


def find_code(ix: Index, starts: list[str], client: Client, beam: int = 3, steps: int = 20, depth: int | None = None, yes: float = 0.8, no: float = 0.2) -> tuple[DataFrame, str]:
    """JD6/TK3: best-first navigation from start units over call and same-file moves.

    A round opens the best ``beam`` places: starts first, then neighbours by falling probability, then by when they were
    found. (unit, step, p, verdict, parent) of what was opened, and the outcome. A start is never a find, and nothing
    proves that code is absent.
    """
    spark = _spark(ix)
    moves = call_edges(ix)
    edges = cut(moves.select("src", "dst", F.lit(0).alias("move")).union(moves.select("dst", "src", F.lit(1))).union(co_file_edges(ix).select("src", "dst", F.lit(2))).union(co_file_edges(ix).select("dst", "src", F.lit(2))).groupBy("src", "dst").agg(F.min("move").alias("move")))
    # the frontier is a queue of places with their scores: opened rounds x neighbours, read by key from edges
    queue: list[tuple] = [(0, 0.0, i, u, 0, None, None) for i, u in enumerate(starts)]
    seen: set[str] = set()
    opened, n, stop = [], len(starts), "nothing left"
    for step in range(steps):
        chosen = []
        for item in sorted(queue, key=lambda q: q[:3]):
            if item[3] not in seen and len(chosen) < beam and (item[0] == 0 or item[6] is None or item[6] > no):
                seen.add(item[3])
                chosen.append(item)
        if not chosen:
            break
        queue = [q for q in queue if q[3] not in seen]
        got = {i: p for i, p, _ in ask(client, step, [c[3] for c in chosen])}
        for c in chosen:
            opened.append((c[3], step, got[c[3]], c[5], c[0] == 0))
        if any(got[c[3]] is not None and got[c[3]] >= yes and c[0] for c in chosen):
            stop = "found"
            break
        if depth is not None and step >= depth:
            stop = "depth"
            break
        near = edges.join(F.broadcast(spark.createDataFrame([(c[3],) for c in chosen], "src string")), "src").orderBy("src", "move", "dst").collect()  # the neighbours of a beam
        for r in near:
            if r["dst"] not in seen:
                p = got[r["src"]]
                queue.append((3, -(p or 0.0), n, r["dst"], step + 1, r["src"], p))
                n += 1
    else:
        stop = "budget"
    rows = spark.createDataFrame(opened, "unit string, step int, p double, parent string, start boolean")
    verdict = F.when(F.col("p").isNull(), "unanswered").when(F.col("start"), "start").when(F.col("p") >= yes, "found").when(F.col("p") <= no, "searched").otherwise("unsure")
    return rows.withColumn("verdict", verdict), stop


def backbone(edges: DataFrame, roots: DataFrame, evidence: DataFrame, depth: int | None = None) -> DataFrame:
    """GR3: the nodes on a shortest path from a root to each evidence node; parents are the smallest."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    tree = cut(graph.trace(both, roots, depth)[0])
    ends = tree.join(evidence.select("node"), "node", "left_semi").select("node")
    back = graph.reached(tree.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst")), ends)
    return roots.select("node").union(back.select("node")).distinct()


def trace_workflow(ix: Index, starts: list[str], checks: list[str], client: Client, budget: int, depth: int | None = None, size: int = 16, yes: float = 0.8, no: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """JD10: (check, status, evidence, examined, total) and the spans kept by the backbone.

    Every check is asked about every reached span within the budget; spans that were not examined leave a check
    unresolved, never a gap.
    """
    spark = _spark(ix)
    moves = call_edges(ix)
    both = cut(moves.select("src", "dst").union(moves.select("dst", "src")).distinct())
    roots = spark.createDataFrame([(s,) for s in starts], "node string")
    spans = cut(graph.trace(both, roots, depth)[0])
    total = spans.count()
    batches = cut(ranking.batches(spans.select(F.col("node").alias("id"), "hop"), ["hop", "id"], size).where(F.col("batch") < budget))
    got = []
    for row in batches.groupBy("batch").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("batch").toLocalIterator():  # at most budget x size rows
        for check in checks:
            got += [(check, i.split("|", 1)[1], p) for i, p, _ in ask(client, row["batch"], [f"{check}|{i}" for i in row["ids"]])]
    answers = cut(spark.createDataFrame(got, "check string, node string, p double"))
    each = spark.createDataFrame([(c,) for c in checks], "check string").join(answers, "check", "left")
    examined = F.count("p")
    status = F.when(F.count_if(F.col("p") >= yes) > 0, "evidence backed").when((F.count_if((F.col("p") > no) & (F.col("p") < yes)) > 0) | (examined < total), "unresolved").otherwise("gap to investigate")
    duties = each.groupBy("check").agg(status.alias("status"), F.count_if(F.col("p") >= yes).alias("evidence"), examined.alias("examined"), F.lit(total).alias("total"))
    return duties, backbone(moves, roots, answers.where(F.col("p") >= yes).select("node").distinct(), depth)


def agent_search(ix: Index, hypotheses: dict[str, dict[str, str]], seeds: Seeds, client: Client, budget: int, rounds: int = 2, best: int = 4, following: int = 8, high: float = 0.7, low: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """JD11: hypotheses (name -> point -> description): list, rank and judge; points without a find are searched again from what the first round ranked best.

    Per point (hypothesis, point, outcome, band, best, judged, not_judged), and the ranked places: the best of each point
    and those that follow.
    """
    points = {f"{h}/{p}": d for h, ps in hypotheses.items() for p, d in ps.items()}
    left, merged = budget, None
    open_points, now = points, seeds
    for round_ in range(rounds):
        calls = left if round_ == rounds - 1 else max(1, left // 2)
        rows, _ = find_all(ix, open_points, now, client, calls, sources={k: SOURCES[k] for k in ("anchor", "file", "name", "scent")})
        rows = cut(rows.withColumn("round", F.lit(round_)))
        merged = rows if merged is None else merged.unionByName(rows)
        left -= calls
        results = {r["target"]: r for r in point_results(merged).collect()}  # one row per point
        open_points = {t: d for t, d in points.items() if results[t]["outcome"] != "found"}
        if not open_points or left < 1:
            break
        near = ranking.best(rows.where("p is not null"), best, [F.desc("p"), F.desc("value"), F.col("unit")], ["target"]).select("unit").distinct()
        symbols = [r["symbol"] for r in ix.units.join(near, "unit", "left_semi").select("symbol").collect() if r["symbol"]]  # at most best per point
        now = Seeds(names=list(dict.fromkeys([*seeds.names, *symbols])), texts=[*seeds.texts, *open_points.values()], files=seeds.files, anchors=seeds.anchors)
    once = ranking.first_wins(merged.where("p is not null"), ["target", "unit"], [F.desc("p"), F.col("round")])
    ranked = ranking.best(once, best + following, [F.desc("p"), F.desc("value"), F.col("unit")], ["target"]).withColumn("shown", F.when(F.col("rank") <= best, "best").otherwise("next"))
    results = point_results(merged.groupBy("target", "unit").agg(F.max("p").alias("p")))
    parts = F.split("target", "/", 2)
    band = F.when(F.col("best") >= high, "high").when(F.col("best") < low, "low").when(F.col("best").isNotNull(), "middle")
    return results.select(parts[0].alias("hypothesis"), parts[1].alias("point"), "outcome", band.alias("band"), "best", "judged", "not_judged"), ranked.select("target", "unit", "p", "rank", "shown")
