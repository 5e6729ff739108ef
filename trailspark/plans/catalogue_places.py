"""Queries of moves, places, lookups and request values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, values
from ..operators import places, relate
from ..sources import text as source
from . import fixtures as fx
from .catalogue import TERMS, query

CODE = """calls as (select l_suppkey as file, l_orderkey as line, l_partkey as name from lineitem where l_linenumber <= 3),
 refs as (select l_suppkey as file, l_orderkey as line, l_partkey as name, case l_returnflag when 'A' then 'argument' when 'N' then 'condition' else 'assignment' end as role from lineitem where l_linenumber between 4 and 6),
 defs as (select l_partkey as name, l_suppkey as file, min(l_orderkey) as start from lineitem where l_linenumber = 7 group by 1, 2), tests as (select s_suppkey as file from supplier where s_acctbal < 0)"""


def _code(spark, d):
    li = fx.table(spark, d, "lineitem")
    own = [F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("name")]
    role = F.when(F.col("l_returnflag") == "A", "argument").when(F.col("l_returnflag") == "N", "condition").otherwise("assignment")
    defs = li.where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file")).agg(F.min("l_orderkey").alias("start"))
    tests = fx.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("file"))
    return li.where("l_linenumber <= 3").select(*own), li.where("l_linenumber between 4 and 6").select(*own, role.alias("role")), defs, tests


@query(f"with {CODE}, s as (select distinct file, line, name from calls) select d.name, d.file as opened, s.file, s.line, row_number() over (partition by d.name, d.file order by (s.file in (select file from tests))::int, s.file, s.line) as rank from defs d join s on s.name = d.name")
def move_callers(spark, d):
    calls, _, defs, tests = _code(spark, d)
    return places.callers(defs.select("name", F.col("file").alias("opened")), calls, tests).select("name", "opened", "file", "line", "rank")


@query(f"""with {CODE}, n as (select name, count(*) as n_sites from calls group by 1), c as (select distinct file, name from calls),
 t as (select c.file, c.name, f.file as target, f.file = c.file as proven from c join defs f on f.name = c.name where f.file = c.file or not exists (select 1 from defs o where o.name = c.name and o.file = c.file)),
 r as (select t.*, n_sites, min((target in (select file from tests))::int) over (partition by t.file, t.name) as only_tests from t join n on n.name = t.name)
 select file, name, target, proven, n_sites, row_number() over (partition by file order by (not proven)::int, only_tests, n_sites, name, target) as rank from r""")
def move_callees(spark, d):
    calls, _, defs, tests = _code(spark, d)
    return places.callees(calls.select("file").distinct(), calls, defs, tests).select("file", "name", "target", "proven", "n_sites", "rank")


@query(f"with {CODE} select distinct d.name, d.file as opened, r.file, r.line, r.role from defs d join refs r on r.name = d.name")
def move_referenced_by(spark, d):
    _, refs, defs, _ = _code(spark, d)
    return places.referenced_by(defs.select("name", F.col("file").alias("opened")), refs)


@query(f"with {CODE} select distinct r.file, r.name, r.role, f.file as target from refs r join defs f on f.name = r.name where r.role in ('argument', 'assignment')")
def move_passed_on(spark, d):
    _, refs, defs, _ = _code(spark, d)
    return places.passed_on(refs.select("file").distinct(), refs, defs).select("file", "name", "role", "target")


@query(f"""with {CODE}, i as (select distinct l_suppkey as file, o_custkey as target, l_partkey as name from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1), n as (select p_partkey as file, p_size as n_lines from part)
 select i.file, i.target, i.name, coalesce(f.start, 1) as start, case when f.start is null then least(coalesce(n_lines, 40), 40) end as head_end from i left join defs f on f.file = i.target and f.name = i.name left join n on n.file = i.target""")
def move_imported(spark, d):
    _, _, defs, _ = _code(spark, d)
    rows = fx.table(spark, d, "lineitem").where("l_linenumber = 1").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    imports = rows.select(F.col("l_suppkey").alias("file"), F.col("o_custkey").alias("target"), F.col("l_partkey").alias("name")).distinct()
    return places.imported(imports, defs, fx.table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("n_lines")))


_BLOCKS = "blocks as (select distinct upper(n[1]) || substr(n, 2) as name from (select regexp_extract(url, '([a-z]+)[.](com|net|org)', 1) as n from pages) where n <> '')"


def _blocks(spark, d):
    n = F.regexp_extract("url", "([a-z]+)[.](com|net|org)", 1)
    return fx.table(spark, d, "pages").select(F.initcap(n).alias("name")).where("name <> ''").distinct()


@query(f"with {_BLOCKS} select name, page_id as key from blocks, pages where contains(url, '.' || lower(name) || '.')")
def move_client_calls(spark, d):
    return places.client_calls(_blocks(spark, d), fx.table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("text")))


@query(f"with {_BLOCKS} select page_id as key, count(*) as n_models, min(name) as first_model from blocks, pages where contains(url, '.' || lower(name) || '.') group by 1")
def move_queried_models(spark, d):
    return move_client_calls(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n_models"), F.min("name").alias("first_model"))


_DAYS = fx.SPANS + """, days as (select file, span, "start", "end" from spans where length(span) = 10)"""


def _days(spark, d):
    return fx.spans(spark, d).where(F.length("span") == 10)


@query(f"""with {_DAYS}, p as (select a.file, a.span, b.span as other, b."start" as bs, case when b."end" < a."start" then a."start" - b."end" else b."start" - a."end" end as distance from days a join days b on a.file = b.file and (b."end" < a."start" or b."start" > a."end"))
 select file, span, other, distance, rank from (select *, row_number() over (partition by file, span order by distance, bs, other) as rank from p) where rank <= 3""")
def move_same_file(spark, d):
    return places.same_file(_days(spark, d))


@query(f"""with {_DAYS}, n as (select file, max(line) as n_lines from ranks group by 1), m as (
 select file, span, 'lines_before' as move, greatest(1, "start" - 40) as "from", "start" - 1 as "to" from days
 union all select d.file, span, 'rest_of_file', "end" + 1, least(n_lines, "end" + 40) from days d join n on n.file = d.file) select * from m where "from" <= "to" """)
def move_lines_around(spark, d):
    counts = fx.event_ranks(spark, d).groupBy("file").agg(F.max("line").alias("n_lines"))
    return places.lines_around(_days(spark, d), counts)


_MAIL = "@[A-Za-z0-9-]+[.][A-Za-z0-9-]+"


@query(f"""with {fx.LINES}, m as (select distinct file, line, unnest(regexp_extract_all(text, '{_MAIL}')) as key from lines), own as (select file, key, count(*) as own from m group by 1, 2), tot as (select key, count(*) as total from m group by 1),
 u as (select file, o.key, total - own as hits from own o join tot t on t.key = o.key where total - own between 1 and 30)
 select u.file, u.key, hits, m.file as hit_file, m.line as hit_line, row_number() over (partition by u.file order by hits, u.key, m.file, m.line) as rank from u join m on m.key = u.key and m.file <> u.file""")
def move_keys_mentioned(spark, d):
    held = F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("key")
    return places.keys_mentioned(fx.lines(spark, d).select("file", "line", held))


@query(f"""with {fx.COMMITS}, recent as (select *, row_number() over (partition by path order by seq desc, commit desc) as k from commits), pairs as (select r.path, c.path as other, count(*) as n from recent r join commits c on r.commit = c.commit and r.path <> c.path where k <= 200 group by 1, 2)
 select path, other, n, rank, least(p_size, 40) as head_end from (select *, row_number() over (partition by path order by n desc, other) as rank from pairs) join part on p_partkey = other where rank <= 2""")
def move_co_changed(spark, d):
    near = relate.co_changed(fx.commits(spark, d)).where("rank <= 2")
    sizes = fx.table(spark, d, "part").select(F.col("p_partkey").alias("other"), F.least("p_size", F.lit(places.HEAD_LINES)).alias("head_end"))
    return near.join(sizes, "other").select("path", "other", "n", "rank", "head_end")


@query(f"with {CODE} select name, count(*) as n_sites from calls group by 1")
def call_site_counts(spark, d):
    return places.call_site_count(_code(spark, d)[0])


@query(f"with {CODE} select f.file as target, c.file, count(*) as n from calls c join (select distinct name, file from defs) f on f.name = c.name and f.file <> c.file group by 1, 2")
def callers_of_file(spark, d):
    calls, _, defs, _ = _code(spark, d)
    return places.callers_of_file(calls, defs)


@query(f"with {fx.LINES}, t as (select unnest(['{"','".join(TERMS)}']) as term) select term, file, min(line) as line from lines, t where contains(text, term) group by 1, 2")
def files_naming(spark, d):
    return places.files_naming(source.search(fx.lines(spark, d), list(TERMS)))


@query(f"with {fx.LINES} select distinct file from lines where contains(text, 'example.com')")
def files_with_matches(spark, d):
    """SC20: only the files."""
    return fx.lines(spark, d).where(F.contains("text", F.lit("example.com"))).select("file").distinct()


@query(f"with {fx.NATION}, b as (select src, dst from nation_edges where src <> dst union all select dst, src from nation_edges where src <> dst), n as (select src, dst, count(*) as connections from b group by 1, 2) select *, row_number() over (partition by src order by connections desc, dst) as rank from n")
def context_queues(spark, d):
    return places.context_queue(fx.nation_edges(spark, d))


@query(f"""with {_DAYS}, shown as (select * from spans where length(span) = 13 and right(span, 2) >= '08')
 select file, span from days i where not exists (select 1 from ranks r where r.file = i.file and r.line between i."start" and i."end" and not exists (select 1 from shown s where s.file = r.file and r.line between s."start" and s."end"))""")
def already_delivered(spark, d):
    shown = fx.spans(spark, d).where("length(span) = 13 and right(span, 2) >= '08'")
    return places.delivered(_days(spark, d), shown).select("file", "span")


_NOW = "replace(text, 'token', 'TOKEN')"


@query(f"with n as (select doc_id, {_NOW} as t from documents where lang <> 'fr') select d.doc_id as key, case when n.doc_id is null then 'gone' else 'changed' end as state from documents d left join n on n.doc_id = d.doc_id where n.doc_id is null or n.t <> d.text")
def changed_since(spark, d):
    docs = fx.table(spark, d, "documents").where("text is not null")
    now = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("key"), F.sha2(F.expr(_NOW), 256).alias("sha"))
    return places.changed_since(docs.select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("sha")), now)


@query("select l.doc_id from labels l where l.doc_id not in (select doc_id from documents where lang = 'en')")
def answers_outside_offer(spark, d):
    """ST5: labels of documents that were not offered."""
    return places.outside(fx.table(spark, d, "labels"), fx.table(spark, d, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


@query("select s_suppkey as id, round(case when m > 0 then (b - lo) / m else 0 end, 9) as normalized from (select s_suppkey, s_acctbal::double as b, least(min(s_acctbal::double) over (partition by s_nationkey), 0) as lo, max(s_acctbal::double) over (partition by s_nationkey) - least(min(s_acctbal::double) over (partition by s_nationkey), 0) as m from supplier)")
def normalized_scores(spark, d):
    rows = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.col("s_acctbal").cast("double").alias("b"))
    return places.normalized_scores(rows, "s_nationkey", "b").select("id", F.round("normalized", 9).alias("normalized"))


@query("select unit, score, best_piece from (select l_orderkey as unit, l_discount::double as score, l_linenumber as best_piece, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber) as k from lineitem) where k = 1")
def unit_scores(spark, d):
    return places.unit_scores(fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("piece"), F.col("l_discount").cast("double").alias("p")))


@query(f"""with {fx.SPANS}, h as (select r.file, r.line, s."start", s."end", row_number() over (partition by r.file, r.line order by s."end" - s."start", s.span) as k from ranks r join days s on r.file = s.file and r.line between s."start" and s."end"),
 p as (select file, line, case when "end" - "start" + 1 <= 4 then 'unit' else 'window' end as kind, case when "end" - "start" + 1 <= 4 then "start" else greatest(1, line - 10) end as "from", case when "end" - "start" + 1 <= 4 then "end" else line + 10 end as "to" from h where k = 1)
 select *, file || ':' || "from" || '-' || "to" as key from p""".replace("ranks r join days", "ranks r join (select * from spans where length(span) = 10)"))
def places_for_lines(spark, d):
    return places.place_for_line(fx.event_ranks(spark, d).select("file", "line"), _days(spark, d), most=4)


@query("select f, name, omitted, rank from (select l_suppkey as f, l_partkey as name, greatest(count(*) over (partition by l_suppkey) - 32, 0) as omitted, row_number() over (partition by l_suppkey order by l_partkey) as rank from (select distinct l_suppkey, l_partkey from lineitem)) where rank <= 32")
def outline_limits(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("f"), F.col("l_partkey").alias("name")).distinct()
    return places.outline(rows, "f", [F.col("name")], 32).select("f", "name", "omitted", "rank")


@query("with h as (select distinct sha256(text) as blob from documents where lang = 'en') select doc_id, sha256(text) as blob from documents where text is not null and sha256(text) not in (select blob from h where blob is not null)")
def name_table_add(spark, d):
    """SC21: what of all texts an index over the English ones lacks."""
    docs = fx.table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.sha2("text", 256).alias("blob"))
    return places.name_table_add(docs.where("lang = 'en'"), docs).select("doc_id", "blob")


@query("select l_suppkey as f, string_agg(distinct p_brand, ' ' order by p_brand) as query from lineitem join part on l_partkey = p_partkey group by 1")
def batch_query(spark, d):
    """AG21: the sorted distinct identifiers of a file as one text."""
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("f")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), " ").alias("query"))


_ESCAPED = """2 + length(text) + len(regexp_extract_all(text, '["\\\\\\n\\r\\t\\x08\\f]')) + 5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0b\\x0e-\\x1f\\x7f]')) + 5 * len(regexp_extract_all(text, '[\\x{80}-\\x{ffff}]')) + 11 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]'))"""


@query(f"select doc_id, {_ESCAPED} as n, {_ESCAPED} + 6 <= 4000 and strlen(text) + 4 <= 3500 as fits from documents where text is not null")
def request_sizes(spark, d):
    """SF10/FP18."""
    docs = fx.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", values.serialized_chars(F.col("text")).cast("long").alias("n"), values.fits(F.col("text"), F.lit("code"), 4000, 3500).alias("fits"))


@query("select doc_id, sha1('blob ' || strlen(text) || chr(0) || text) as blob from documents where text is not null")
def git_blob_ids(spark, d):
    return fx.table(spark, d, "documents").where("text is not null").select("doc_id", values.git_blob_id(F.col("text")).alias("blob"))


@query("select event_id, cast(floor(epoch(ts) / 86400) as int) as day from events")
def epoch_days(spark, d):
    return fx.table(spark, d, "events").select("event_id", values.day_of(F.col("ts").cast("timestamp")).alias("day"))


@query("select p_partkey, cast(p_size * case right(p_brand, 1) when '1' then 1000 when '2' then 1000000 when '3' then 1000000000 when '4' then 1000000000000 else 1 end as bigint) as bytes from part")
def byte_budgets(spark, d):
    """SF20."""
    unit = F.when(F.col("p_brand").endswith("1"), " kb").when(F.col("p_brand").endswith("2"), "MB").when(F.col("p_brand").endswith("3"), "GB ").when(F.col("p_brand").endswith("4"), "TB").otherwise("")
    return fx.table(spark, d, "part").select("p_partkey", values.byte_budget(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("select n_nationkey, n_name as name from nation")
def dotted_lookup(spark, d):
    """SF19."""
    held = F.to_json(F.struct(F.struct(F.col("n_name").alias("name")).alias("nation")))
    return fx.table(spark, d, "nation").select("n_nationkey", values.dotted(held, "nation.name").alias("name"))


_PLACED = "case lang when 'en' then 'docs/' when 'fr' then 'tests/' when 'de' then 'vendor/' else 'dist/' end || source || '/' || doc_id || case when n_chars > 2000 then '.py' when n_chars > 1000 then '.test.ts' when n_chars > 500 then '.md' else '.lock' end"


@query(f"""with f as (select {_PLACED} as file, lang, n_chars from documents)
 select file, case when n_chars > 2000 then 'python' when n_chars > 1000 then 'typescript' end as language, lang = 'fr' or n_chars > 1000 and n_chars <= 2000 as test, lang = 'en' or n_chars > 500 and n_chars <= 1000 as docs, lang = 'de' as vendored, lang not in ('en', 'fr', 'de') as output,
 n_chars > 1000 and lang not in ('en', 'fr', 'de') and n_chars > 2000 as kept from f""")
def path_kinds(spark, d):
    """FP1, FP2, FP4-FP6 on paths made of the documents' columns."""
    path = F.col("file")
    made = fx.table(spark, d, "documents").select(F.expr(_PLACED).alias("file"))
    kept = paths.kept(path, exclude=["vendor"], with_tests=False)
    return made.select("file", paths.language_of(path).alias("language"), paths.is_test(path).alias("test"), paths.is_docs(path).alias("docs"), paths.is_vendored(path).alias("vendored"), paths.in_output(path).alias("output"), kept.alias("kept"))


@query("""with t as (select p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z_$][a-z0-9_$]*')) as w from part), k as (select p_partkey, w from t where length(w) > 2 and w not in ('and', 'are', 'for', 'from', 'the', 'with'))
 select p_partkey, case when length(w) > 4 and ends_with(w, 'ies') then left(w, -3) || 'y' when length(w) > 4 and regexp_matches(w, '(ches|shes|xes|zes)$') then left(w, -2) when length(w) > 3 and regexp_matches(w, '[^sui]s$') then left(w, -1) else w end as word, count(*) as n from k group by 1, 2""")
def identifier_words(spark, d):
    """SF1/SF2."""
    text = F.concat_ws(" ", "p_name", "p_type")
    return fx.table(spark, d, "part").select("p_partkey", F.explode(values.identifier_words(text)).alias("word")).groupBy("p_partkey", "word").agg(F.count(F.lit(1)).alias("n"))
