"""Corpus preparation: toxicity, line dedup, MinHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for all stages: a null text is empty, is not toxic and stays null; empty and very long texts are handled
whole; repeated rows stay or go together, but near copies of other rows leave one; extra columns, whatever their names,
come through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import line_dedup, minhash, packing, pii, toxicity
from trailspark.llm.common import drop_path, free, read, shared_dir, ship

#: Documents at or above this chance of being toxic go.
TOXIC = 0.3
#: Lines that so many documents hold go. The pipeline links near copies from the general threshold for word shingles, 80 %; the query op3 takes its contract's 85 %.
MIN_LINE_DOCS, PERCENT = 10, 80


def _with_text(done: DataFrame, docs: DataFrame, new: str) -> DataFrame:
    """done in the columns of docs, with text replaced by the column that the operator calls new, and n_chars as it is then."""
    text = F.col(free(docs, new))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text)).cast(kind)
    return done.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels but those that are held out."""
    ship(spark)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.drop_toxic(docs, model, TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go; the documents stay."""
    ship(spark)
    return _with_text(line_dedup.dedup_lines(docs, MIN_LINE_DOCS), docs, "__kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    ship(spark)
    return minhash.drop_copies(docs, percent=PERCENT)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are replaced by labels."""
    ship(spark)
    return _with_text(pii.redact(docs), docs, "__redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences, mixed by source."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash", drop_near_copies), ("pii", hide_private), ("packing", pack)]
#: Tokenizers, the classifier and the kernel are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_path(spark, f"{folder}/{before}")
        before = name
    return docs
