"""The queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, line_dedup, media, minhash, packing, pii, token_counts, toxicity, url_filter
from .common import read

WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"), F.round("__score", 6).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select doc_id, pos, line, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
from keyed left join frequent f on keyed.k = f.k group by doc_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)
    count = [pii.count_kind(F.col("spans"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *count, F.sha2(pii.span_text(F.col("spans")), 256).alias("base_sha256"), pii.span_text(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_url_filter": op1_url_filter, "op2_toxicity": op2_toxicity, "op3_minhash": op3_minhash, "op4_line_dedup": op4_line_dedup, "op5_bpe": op5_bpe, "op6_packing": op6_packing, "op7_pii": op7_pii, "op8_hnsw": op8_hnsw, "op9_media": op9_media, "op10_token_counts": op10_token_counts, "pipeline": pipeline}
ORACLES = {"op4_line_dedup": OP4_SQL}
