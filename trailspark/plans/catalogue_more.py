"""Further queries of the reference's operators: frontier orders, coverage, histories, retention, excerpts and composed searches."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mentions, text
from ..operators import graph, intervals, ranking, relate, search
from . import fixtures as fx
from .catalogue import _STEP, query


def hashed(batch: int, ids: list[str]) -> list[float]:
    """A client whose answers follow from the ids alone: no table of answers has to be held anywhere."""
    return [zlib.crc32(i.encode()) % 100 / 100 for i in ids]


@query("select doc_id, rank from (select doc_id, row_number() over (order by n_chars desc, sha256(text), doc_id) as rank from documents) where rank <= 50")
def value_key_order(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
    return ranking.best(docs, 50, [F.desc("n_chars"), F.col("sha"), F.col("doc_id")]).select("doc_id", "rank")


@query(f"with {fx.LINKS}, scope as (select distinct '/' || lang as path from documents) select count(*) as n_links, count(*) filter (where spec not in (select path from scope)) as n_unresolved from links")
def graph_unresolved(spark, d):
    """AG10: links whose target is not in scope."""
    scope = fx.table(spark, d, "documents").select(F.concat(F.lit("/"), "lang").alias("spec")).distinct().withColumn("held", F.lit(True))
    return fx.links(spark, d).join(scope, "spec", "left").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("held").isNull()).alias("n_unresolved"))


@query(f"""with {fx.SPANS}, a as (select distinct file, line from ranks where event_type = (select min(event_type) from events)),
 hit as (select file, span, "start", "end" from (select a.file, s.span, s."start", s."end", row_number() over (partition by a.file, a.line order by s."end" - s."start", s.span) as k from a join spans s on a.file = s.file and a.line between s."start" and s."end") where k = 1 group by all)
 select h.file, h.span from hit h where not exists (select 1 from hit o where o.file = h.file and o."start" <= h."start" and o."end" >= h."end" and o."end" - o."start" > h."end" - h."start")""")
def anchor_units(spark, d):
    """JN20: anchors to their innermost spans, nested ones dropped."""
    ranks, spans = fx.event_ranks(spark, d), fx.spans(spark, d)
    anchors = ranks.join(F.broadcast(ranks.agg(F.min("event_type").alias("least"))), F.col("event_type") == F.col("least")).select("file", "line")  # one row
    hit = intervals.innermost(anchors, spans).select("file", "span").distinct().join(spans, ["file", "span"])
    o = hit.select(F.col("file").alias("f2"), F.col("start").alias("os"), F.col("end").alias("oe"))
    nested = (F.col("file") == F.col("f2")) & (F.col("os") <= F.col("start")) & (F.col("oe") >= F.col("end")) & (F.col("oe") - F.col("os") > F.col("end") - F.col("start"))
    return hit.join(o, nested, "left_anti").select("file", "span")


@query(f"with {fx.ANSWERS} select source, count(*) filter (where p >= 0.8) as n_definite, count(*) filter (where p >= 0.5 and p < 0.8) as n_possible from answers group by 1")
def definite_possible_files(spark, d):
    p = F.col("p")
    return fx.answers(spark, d).groupBy("source").agg(F.count_if(p >= 0.8).alias("n_definite"), F.count_if((p >= 0.5) & (p < 0.8)).alias("n_possible"))


@query("select doc_id from labels where quality = 1 and toxic = 1")
def conflicts(spark, d):
    return fx.table(spark, d, "labels").where("quality = 1 and toxic = 1").select("doc_id")


@query("select conv_id, string_agg(role, '>' order by turn) as roles, count(*) as n from conversations group by 1")
def history_sections(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, count(*) over w as steps, cast(sum(length(text)) over w as bigint) as chars from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def history_prefix_curve(spark, d):
    """AG20: what each growing prefix of a history holds."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return fx.table(spark, d, "conversations").select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("steps"), F.sum(F.length("text")).over(w).alias("chars"))


@query("select user_id, event_id, coalesce(sum(value) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and 1 preceding), 0) + value <= 500 as kept from events")
def disk_budget_eviction(spark, d):
    """JD24: the oldest go first until each store's rest fits its budget."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("value").over(w), F.lit(0))
    return fx.table(spark, d, "events").select("user_id", "event_id", (before + F.col("value") <= 500).alias("kept"))


@query(f"""with {fx.LINES}, f as (select *, max(cast(contains(text, '@') as int)) over (partition by file order by line rows between 2 preceding and 2 following) as near from lines),
 i as (select file, line, line - row_number() over (partition by file order by line) as run from f where near = 1) select file, min(line) as "start", max(line) as "end" from i group by file, run""")
def excerpt_elision(spark, d):
    """JD18: the stretches that an excerpt keeps: matching lines with two around them; what lies between is elided."""
    near = intervals.context(fx.lines(spark, d), F.contains("text", F.lit("@")))
    return intervals.islands(near, F.lit(True)).select("file", "start", "end")


_WALK2 = f"""with {fx.NATION}, tot as (select src, sum(weight) as total from nation_edges group by 1), share as (select e.src, dst, weight / total as p from nation_edges e join tot t on e.src = t.src),
 nodes as (select src as node from nation_edges union select dst from nation_edges), start as (select node, case when node < 2 then 0.5::double else 0.0::double end as s from nodes), m0 as (select node, s as mass from start),
 m1 as ({_STEP.format(m="m0")}), m2 as ({_STEP.format(m="m1")}), walk as (select node, round(mass / power(greatest(1.0::double, coalesce(total, 0)), 0.5::double), 6) as mass, coalesce(total, 0) as score from m2 left join tot on node = src)
 select node, round(score / (select max(score) from walk) + 0.5::double * mass / (select max(mass) from walk), 5) as score from walk"""


@query(_WALK2)
def reranked_boost(spark, d):
    """GR5: a normalised score, boosted by a two-round walk over its maximum."""
    edges = fx.nation_edges(spark, d)
    seeds = fx.table(spark, d, "nation").where("n_nationkey < 2").select(F.col("n_nationkey").alias("node"), F.lit(1.0).alias("weight"))
    walk = graph.random_walk(edges, seeds, rounds=2, tolerance=0.0)
    score = graph.degrees(edges).select(F.col("src").alias("node"), F.col("weight").alias("score"))
    rows = walk.join(score, "node", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    most = rows.agg(F.max("score").alias("most"), F.max("mass").alias("heaviest"))  # one row
    return rows.join(F.broadcast(most)).select("node", F.round(F.col("score") / F.col("most") + 0.5 * F.col("mass") / F.col("heaviest"), 5).alias("score"))


@query("select distinct doc_id, regexp_extract(v, '[^=]*') as name from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]+ = \"')) as v from documents)")
def bound_names(spark, d):
    """SF16: the names that a text binds to quoted values."""
    found = F.explode(F.regexp_extract_all("text", F.lit('[A-Za-z_]+ = "'), F.lit(0))).alias("v")
    return fx.table(spark, d, "documents").select("doc_id", found).select("doc_id", F.regexp_extract("v", "[^=]*", 0).alias("name")).distinct()


@query()
def code_names(spark, d):
    """SF4: the code names that each page spells out."""
    return mentions.names_in(fx.table(spark, d, "pages").select("page_id", "html"), "page_id", "html")


@query()
def mentioned_paths(spark, d):
    """SF5: the path tokens of each document."""
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(mentions.paths_in(F.col("text"))).alias("ord", "path"))


@query()
def fact_spans(spark, d):
    """SF9: facts with their offsets and lines."""
    return mentions.facts_in(fx.table(spark, d, "documents"), "doc_id", "text", dict(text.FACTS))


@query()
def backbone_path(spark, d):
    """GR3: the shortest paths from the first part to its farthest ones."""
    edges = fx.part_edges(spark, d)
    roots = fx.table(spark, d, "lineitem").agg(F.min("l_partkey").alias("node"))
    reached = graph.reached(edges, roots)
    return search.backbone(edges, roots, reached.join(reached.agg(F.max("hop").alias("hop")), "hop", "left_semi").select("node"))


def _index(spark, d) -> search.Index:
    return search.Index.of(fx.files(spark, d).select(F.col("file").alias("path"), "text"))


@query()
def unit_listing(spark, d):
    """JD21: the units of all documents."""
    return _index(spark, d).units.select("unit", "path", "start", "end", "sha", "test")


@query()
def find_all_value(spark, d):
    """JD8 in order of value: two targets, 12 requests of 16."""
    targets = {"license": "license text", "address": "an example.com address"}
    return search.find_all(_index(spark, d), targets, search.Seeds(names=["license", "example"]), hashed, 12)[0]


@query()
def find_code_beam(spark, d):
    """JD6: best-first navigation from the first unit of the smallest path."""
    ix = _index(spark, d)
    start = ix.units.agg(F.min("unit")).first()[0]
    return search.find_code(ix, [start], hashed, beam=3, steps=6, yes=1.1)[0]


@query()
def agent_search(spark, d):
    """JD11: one hypothesis of two points in two rounds."""
    points = {"leak": {"mail": "an example.com address", "key": "a token = value"}}
    return search.agent_search(_index(spark, d), points, search.Seeds(names=["example", "token"], texts=["token license example"]), hashed, 8)[0]


@query()
def point_coverage(spark, d):
    """AG11/AG18: outcomes per target of a capped search."""
    rows, _ = search.find_all(_index(spark, d), {"license": "license text"}, search.Seeds(names=["license"]), hashed, 4, hops={})
    return search.point_results(rows)


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k between 5 and 12")
def next_places(spark, d):
    """TK6: what follows the best four."""
    docs = fx.table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ranking.best(docs, 12, [F.desc("n_chars"), F.col("doc_id")], ["source"]).where("rank >= 5").select("source", "doc_id")


@query("select source, doc_id, greatest(0, n - 8) as omitted from (select source, doc_id, row_number() over (partition by source order by doc_id) as k, count(*) over (partition by source) as n from documents) where k <= 8")
def capped_with_omissions(spark, d):
    """TK4/AG22: a cap per group, and how many it left out."""
    docs = fx.table(spark, d, "documents").select("source", "doc_id")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    kept = relate.newest(docs, "source", [F.col("doc_id")], 8)
    return kept.join(n, "source").select("source", "doc_id", F.greatest(F.lit(0), F.col("n") - 8).alias("omitted"))
