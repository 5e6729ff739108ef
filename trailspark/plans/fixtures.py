
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import dealt
from ..sources.text import lines as split_lines
from .state import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("file"), "text", "doc_id", "source", "lang")


def lines(spark, d) -> DataFrame:
    return split_lines(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


def event_ranks(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("file"), "ts", "event_type", "event_id", F.row_number().over(w).alias("line"))


def spans(spark, d) -> DataFrame:
    """Days of a user holding hours, in event ranks."""
    ranks = event_ranks(spark, d)
    day = ranks.groupBy("file", F.date_format("ts", "yyyy-MM-dd").alias("span")).agg(F.min("line").alias("start"), F.max("line").alias("end"))
    hour = ranks.groupBy("file", F.date_format("ts", "yyyy-MM-dd HH").alias("span")).agg(F.min("line").alias("start"), F.max("line").alias("end"))
    return day.unionByName(hour)


def commits(spark, d) -> DataFrame:
    """An order is a commit, its parts are the paths."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("seq"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return dealt(rows, rows.count(), "commit").distinct().join(orders, "commit")


def links(spark, d) -> DataFrame:
    """Pages and the paths that they name."""
    pages = table(spark, d, "pages")
    return pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), F.lit(1))).alias("spec")).distinct()


def nation_edges(spark, d) -> DataFrame:
    """Which nations' customers bought from which nations' suppliers, with how many lines."""
    li, orders, cust, supp = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def part_edges(spark, d) -> DataFrame:
    """A sparse directed graph: a supplier's parts in the order of their keys, each to the next."""
    own = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    w = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    return own.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null").distinct().withColumn("weight", F.lit(1.0))


def answers(spark, d) -> DataFrame:
    """Labels as probabilities; a document without a label is unanswered."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    p = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.1)
    return docs.join(labels, "doc_id", "left").select("doc_id", p.alias("p"), F.col("toxic"), "source", "text")


LINES = "lines as (select doc_id as file, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) as text from documents)"
RANKS = "ranks as (select user_id as file, ts, event_type, event_id, row_number() over (partition by user_id order by ts, event_id) as line from events)"
SPANS = RANKS + """, spans as (
  select file, strftime(ts, '%Y-%m-%d') as span, min(line) as "start", max(line) as "end" from ranks group by 1, 2
  union all select file, strftime(ts, '%Y-%m-%d %H'), min(line), max(line) from ranks group by 1, 2)"""
COMMITS = "commits as (select distinct l_orderkey as commit, l_partkey as path, o_orderdate as seq from lineitem join orders on l_orderkey = o_orderkey)"
LINKS = """links as (select distinct page_id as src, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)', 1)) as spec from pages)"""
NATION = "nation_edges as (select c_nationkey as src, s_nationkey as dst, cast(count(*) as double) as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"
PART = "part_edges as (select distinct src, dst, 1.0::double as weight from (select l_partkey as src, lead(l_partkey) over (partition by l_suppkey order by l_partkey) as dst from (select distinct l_suppkey, l_partkey from lineitem)) where dst is not null)"
ANSWERS = "answers as (select d.doc_id, case quality when 1 then 0.9::double when 0 then 0.1::double end as p, toxic, source, text from documents d left join labels l on d.doc_id = l.doc_id)"
