"""Queries of questions within an allowance and of bindings through modules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bindings, questions
from . import fixtures as fx
from .state import cut
from .catalogue import _MASKED, query
from .catalogue_places import _ESCAPED, CODE, _code

#: The roles that a piece may play for a point.
ROLES = ("decide", "guard", "value", "effect", "delegates", "satisfied")
SENT, BOX, SHARE = 200, 20_000, 10


def halves(batch: int, ids: list[str]) -> list[float]:
    return [0.5] * len(ids)


def lengths(batch: int, ids: list[str]) -> list[float]:
    """A client whose answers SQL can repeat."""
    return [len(i) % 10 / 10 for i in ids]


@query(f"""with r as (select d.doc_id as request, {_MASKED.replace('(text', "(coalesce(text, '')")} as state, lang as question, toxic from documents d left join labels l on l.doc_id = d.doc_id),
 known as (select state, question, max(toxic::double) as p from r where toxic is not null group by 1, 2),
 waiting as (select state, question, row_number() over (order by min(request)) as rn from r where not exists (select 1 from known k where k.state = r.state and k.question = r.question) group by 1, 2)
 select request, coalesce(k.p, case when rn <= {SENT} then 0.5::double end) as p, case when k.p is not null then 'stored' when rn <= {SENT} then 'sent' end as source from r left join known k using (state, question) left join waiting using (state, question)""")
def asked_within_allowance(spark, d):
    """JD2/JD5: labels are what is stored; 200 requests may be sent."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("request"), F.coalesce("text", F.lit("")).alias("state"), F.col("lang").alias("question"))
    clean = cut(questions.identified(docs, text.masked).select("request", "sha"))  # each text is hashed once, and none is written
    labels = fx.table(spark, d, "labels").where("toxic is not null").select(F.col("doc_id").alias("request"), F.col("toxic").cast("double").alias("p"))
    stored = clean.join(labels, "request").select("sha", "p")
    return questions.ask_identified(clean, halves, stored, questions.Allowance(SENT)).select("request", "p", "source")


_SHARES = """n as (select l_suppkey as request, l_returnflag as operation, l_linestatus as argument, count(*) as c from lineitem group by 1, 2, 3),
 route as (select request, operation, sum(c)::double / sum(sum(c)) over (partition by request) as p from n group by 1, 2),
 best as (select request, arg_min(operation, (-p, operation)) as choice, max(p) as m, count(*)::double as k from route group by 1),
 picks as (select request, choice, case when k < 2 then 1.0::double else (k * m - 1) / (k - 1) end as confidence from best)"""


def _routes(spark, d):
    n = fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("request"), F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("argument")).agg(F.count(F.lit(1)).alias("c"))
    by = n.groupBy("request", F.col("operation").alias("option")).agg(F.sum("c").alias("c"))
    total = n.groupBy("request").agg(F.sum("c").alias("all"))
    return n, by.join(total, "request").select("request", "option", (F.col("c").cast("double") / F.col("all")).alias("p"))


@query(f"with {_SHARES} select request, choice, round(confidence, 6) as confidence, confidence >= 0.1 as confident from picks")
def picks(spark, d):
    """JD3: each supplier's likeliest flag."""
    return questions.picked(_routes(spark, d)[1], ["request"], 0.1).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {_SHARES}, a as (select request, operation, argument, c::double / sum(c) over (partition by request, operation) as p from n),
 ab as (select request, operation, arg_min(argument, (-p, argument)) as argument, max(p) as m, count(*)::double as k from a group by 1, 2)
 select request, operation, argument, confidence >= 0.05 and case when k < 2 then 1.0::double else (k * m - 1) / (k - 1) end >= 0.05 as confident from picks join ab using (request) where operation = choice""")
def chosen_calls(spark, d):
    """JD3: a flag and its status, of one request."""
    n, routes = _routes(spark, d)
    total = n.groupBy("request", "operation").agg(F.sum("c").alias("all"))
    arguments = n.join(total, ["request", "operation"]).select("request", "operation", F.col("argument").alias("option"), (F.col("c").cast("double") / F.col("all")).alias("p"))
    return questions.chosen_call(routes, arguments, 0.05)


_PIECES = "pieces as (select source as hypothesis, doc_id as piece, coalesce(text, '') as text from documents), points as (select distinct source as hypothesis, lang as point from documents)"


def _pieces(spark, d):
    docs = fx.table(spark, d, "documents")
    pieces = docs.select(F.col("source").alias("hypothesis"), F.col("doc_id").alias("piece"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("code"))
    points = docs.select(F.col("source").alias("hypothesis"), F.col("lang").alias("point")).distinct().withColumn("question", F.col("point"))
    return pieces, points


@query(f"""with {_PIECES}, l as (select hypothesis, max(length(point)) + 2 as longest from points group by 1), s as (select hypothesis, piece, {_ESCAPED} as chars from pieces),
 k as (select hypothesis, sum(chars) over (partition by hypothesis order by piece desc rows unbounded preceding) + longest <= {BOX} as kept from s join l using (hypothesis)),
 g as (select hypothesis, count(*) filter (where kept) as n_shown, count(*) filter (where not kept) as n_evicted from k group by 1), r as (select *, row_number() over (order by hypothesis) as rn from g)
 select hypothesis, point, n_shown, n_evicted, case when rn <= {SHARE} then (length(hypothesis || ':' || point) % 10) / 10.0::double end as p from points join r using (hypothesis)""")
def existence_answers(spark, d):
    """JD12/JD5: a source's languages over its newest documents; a reserved share answers ten sources."""
    pieces, points = _pieces(spark, d)
    share = questions.Allowance(SENT).reserve({"existence": SHARE})["existence"]
    return questions.existence(pieces, points, lengths, BOX, share).select("hypothesis", "point", "n_shown", "n_evicted", "p")


@query(f"""with {_PIECES}, b as (select hypothesis, piece, cast(floor((row_number() over (partition by hypothesis order by piece) - 1) / 16) as bigint) as batch from pieces)
 select hypothesis, batch, piece, point, role, (length(hypothesis || ':' || piece || ':' || point || ':' || role) % 10) / 10.0::double as p from b join points using (hypothesis) cross join (select unnest(['{"', '".join(ROLES)}']) as role)""")
def role_labels(spark, d):
    """JD13: all documents of a source, 16 a request, six roles for each of its languages."""
    pieces, points = _pieces(spark, d)
    return questions.role_labels(pieces, points, lengths, ROLES)


_NEXT = "nx as (select s_suppkey as file, coalesce(lead(s_suppkey) over w, first_value(s_suppkey) over w) as next, s_acctbal from supplier window w as (partition by s_nationkey order by s_suppkey rows between unbounded preceding and unbounded following))"
_SOLD = "sold as (select distinct l_partkey as name, l_suppkey as file, l_returnflag as flag from lineitem)"


@query(f"""with recursive {CODE}, {_NEXT}, {_SOLD}, u as (select distinct l_suppkey as file, l_orderkey as line, l_partkey as name, case when l_linestatus = 'F' then l_returnflag end as receiver from lineitem where l_linenumber <= 3),
 given as (select l_suppkey as file, l_orderkey as line, l_partkey as name, min(l_returnflag) as state from lineitem where l_discount = 0.1 group by 1, 2, 3),
 loc as (select l_suppkey as file, l_partkey as name, min(l_orderkey) as first, max(l_orderkey) as last from lineitem where l_tax = 0.08 group by 1, 2),
 imp as (select file, name, lead(file) over (partition by name order by file) as target from (select distinct file, name from sold)),
 re as (select l_suppkey as path, l_partkey as name, lead(l_suppkey) over (partition by l_partkey order by l_suppkey) as next, min(l_linestatus) = 'F' as link, min(l_returnflag) as flag from lineitem group by 1, 2),
 rx as (select path, name, next, link from re where next is not null and flag = 'R' union all select file, null, next, true from nx where s_acctbal < 0 and next <> file),
 bad as (select file from nx where s_acctbal < -900), own as (select distinct file, name from defs),
 v as (select u.*, given.state as gs, case when given.state is not null then 'resolver' when loc.file is not null and receiver is null then 'local' when receiver = 'A' and nx.next is not null then 'module'
   when loc.file is null and receiver is null and imp.target is not null and own.file is null then 'import' else 'facts' end as via,
   case when receiver = 'A' then nx.next when receiver is null then imp.target end as target
   from u left join given on given.file = u.file and given.line = u.line and given.name = u.name left join loc on loc.file = u.file and loc.name = u.name and u.line between loc.first and loc.last
   left join nx on nx.file = u.file left join imp on imp.file = u.file and imp.name = u.name left join own on own.file = u.file and own.name = u.name),
 e as (select distinct target, name, target as path, true as proven from v where via in ('module', 'import') union select e.target, e.name, rx.next, e.proven and rx.link from e join rx on rx.path = e.path and (rx.name is null or rx.name = e.name)),
 ep as (select target, name, path, bool_or(proven) as proven from e group by 1, 2, 3), nd as (select file as path, name, count(*) as n from defs group by 1, 2),
 led as (select ep.target, ep.name, coalesce(sum(n), 0) as n_defs, max(case when n is not null then path end) as only_in, max(case when n is not null then proven::int end) = 1 as sure, bool_or(path in (select file from bad)) as hides from ep left join nd using (path, name) group by 1, 2),
 da as (select name, count(*) as n from defs group by 1), ds as (select name, file, count(*) as n from defs group by 1, 2)
 select v.file, v.line, v.name::varchar as name, v.receiver, v.via, case via when 'resolver' then gs when 'local' then 'candidate'
   when 'facts' then case when da.n is null and v.file in (select file from bad) then 'unknown' when da.n is null then 'unresolved' when v.receiver is not null then 'candidate' when ds.n = 1 then 'resolved' else 'candidate' end
   else case when hides then 'unknown' when n_defs = 1 and sure then 'resolved' else 'candidate' end end as state,
   case when via in ('module', 'import') and n_defs = 1 and sure and not hides then only_in when via = 'facts' and da.n is not null and v.receiver is null and ds.n = 1 then v.file end as defined_in
 from v left join led on led.target = v.target and led.name = v.name and via in ('module', 'import') left join da on da.name = v.name left join ds on ds.name = v.name and ds.file = v.file""")
def module_bindings(spark, d):
    """JN9/JN10/GR7: uses of parts by suppliers; a supplier whose sales of a part were all returned passes it on to the part's next one, one in debt passes on all to the next of the nation and round again."""
    li, definitions = fx.table(spark, d, "lineitem"), _code(spark, d)[2].withColumn("name", F.col("name").cast("string"))
    own = [F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), F.col("l_partkey").cast("string").alias("name")]
    uses = li.where("l_linenumber <= 3").select(*own, F.expr("case when l_linestatus = 'F' then l_returnflag end").alias("receiver"))
    given = li.where("l_discount = 0.1").groupBy(*own).agg(F.min("l_returnflag").alias("state")).withColumn("defined_in", F.lit(None).cast("long"))
    held = li.where("l_tax = 0.08").groupBy(own[0], own[2]).agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))
    in_nation = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = F.first("s_suppkey").over(in_nation.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.coalesce(F.lead("s_suppkey").over(in_nation), first).alias("next"), "s_acctbal")
    following = F.lead("file").over(Window.partitionBy("name").orderBy("file"))
    sold = li.groupBy(own[0], own[2]).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status")).withColumn("next", following)
    imported = sold.select("file", "name", F.col("next").alias("target"), F.col("name").alias("exported"))
    named = sold.where("next is not null and flag = 'R'").select(F.col("file").alias("path"), "name", "next", (F.col("status") == "F").alias("proven"))
    stars = after.where("s_acctbal < 0 and next <> file").select(F.col("file").alias("path"), F.lit(None).cast("string").alias("name"), "next", F.lit(True).alias("proven"))
    aliases = after.select("file", F.lit("A").alias("receiver"), F.col("next").alias("target"))
    unparsed = after.where("s_acctbal < -900").select("file")
    return bindings.bindings(uses, given, held, aliases, imported, named.unionByName(stars), definitions, unparsed)
