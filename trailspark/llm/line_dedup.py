"""Operator 4, line dedup: levelled sorted runs of line hashes.

Every line is hashed once: the *lines* table holds a row (row, id, th, pos, h1, h2) for each, dealt into batches of
documents. A *run* is a table (h1, h2, n): a line key's two 64-bit hashes and the number of documents that hold it,
bucketed and sorted by hash. A batch is merge-anti-joined with each run: a key that a run already counts in
``min_docs`` documents is settled and needs no more counting. What is left is added as the batch's own run on level 0.
When a level holds ``fanout`` runs they are compacted, by summing, into one run of the next level. All runs have the
same buckets, so that neither the anti-joins nor compactions move a run's rows.

After the last batch the settled keys are semi-joined with the lines table; the lines that they name are taken out by
position, so that line texts are never shuffled and a document's text moves once. Time is linear in the lines, also
within one document.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points stay; a line
repeated inside one document counts once; repeated rows count as documents of their own; ties do not arise, as a key
goes or stays with all its lines; an empty table gives an empty table; a row's identity is (id, text), compared
null-safely; other columns are left alone, and where they have the names of the new ones, those get more underscores.
Native: DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, boxed, column, drop_path, drop_work, free, hub_join, let, shared_dir, text_hash, unboxed, work_table

#: Runs of a level, batches of a table, and lines of all documents for each bucket of a run.
FANOUT, BATCHES, BUCKET_LINES = 2, 4, 1_000_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def line_table(docs: DataFrame, batches: int = 1, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with a key of min_chars or more. row names the document among repeated ones; it holds in this table only."""
    text = column(text_col)
    # numbered before lines are made of it: each document gets one number
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("id"), text_hash(text).alias("th"), text.alias("text"))
    rows = rows.select("row", "id", "th", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    key = line_key(F.col("line"))
    batch = F.pmod(F.xxhash64("id", "th"), F.lit(batches)).cast("int").alias("batch")
    hashed = rows.select("row", "id", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"), F.length(key).alias("n"), batch)
    return work_table(hashed.where(F.col("n") >= min_chars).drop("n"), "lines")


class LineRuns:
    """The levelled runs; ``add`` takes a batch of lines, ``frequent`` gives the settled keys. ``close`` deletes them."""

    def __init__(self, min_docs: int = 10, fanout: int = FANOUT, buckets: int = 8):
        self.min_docs, self.fanout, self.buckets, self.levels = min_docs, fanout, buckets, [[]]

    def add(self, lines: DataFrame) -> None:
        """lines: rows (row, h1, h2) of documents that no earlier batch held."""
        mine = lines.groupBy("h1", "h2").agg(F.count_distinct("row").alias("n"))
        for run in self.runs():
            mine = mine.join(run.where(F.col("n") >= self.min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(mine))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, counts: DataFrame) -> DataFrame:
        spark = counts.sparkSession
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        dealt = counts.select("h1", "h2", "n").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(name)
        run = spark.table(name)
        run._work_path, run._work_name = path, name
        return run

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._merged(runs)))
            self._drop(runs)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Merge joins: the runs are sorted and have the same buckets."""
        merged = runs[0].select("h1", "h2", "n")
        for run in runs[1:]:
            both = merged.join(run.select("h1", "h2", F.col("n").alias("n2")), ["h1", "h2"], "full")
            merged = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
        return merged

    def frequent(self) -> DataFrame:
        runs = self.runs()
        merged = runs[0] if len(runs) == 1 else self._merged(runs)
        return merged.where(F.col("n") >= self.min_docs)

    @staticmethod
    def _drop(runs: list[DataFrame]) -> None:
        for run in runs:
            run.sparkSession.sql(f"drop table if exists {run._work_name}")
            drop_path(run.sparkSession, run._work_path)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = [[]]


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id2, th2, gone): the positions of the lines that go, for each document that loses any."""
    lines = line_table(docs, batches, min_chars, id_col, text_col)
    runs = LineRuns(min_docs, buckets=max(8, lines.count() // BUCKET_LINES))
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    # one row per key: the join is a semi-join, and a line of very many documents is settled where it lies
    frequent = work_table(runs.frequent().select("h1", F.col("h2").alias("other"), F.col("n").alias("c")), "lines-frequent")
    hit = hub_join(lines, frequent, "h1").where(F.col("h2") == F.col("other"))
    gone = work_table(hit.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set("pos").alias("gone")), "lines-gone")
    runs.close()
    drop_work(lines)
    return gone


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with __n_lines, __n_dropped and __kept: what is left without the lines whose key is in min_docs documents or more (null where the text is null)."""
    gone = dropped_lines(docs, min_docs, min_chars, batches, id_col, text_col)
    # the positions are the side that is hashed, so that texts are not sorted
    joined = boxed(docs, id_col, text_col).join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    text = F.col(free(docs, "box")).getField(text_col)
    full = F.coalesce(text, F.lit(""))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split_lines(text)) - 1), F.col("gone"))
    left = let(split_lines(text), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.octet_length(full) - F.octet_length(F.replace(full, F.lit("\n"), F.lit(""))) + 1
    return unboxed(
        joined,
        docs,
        __n_lines=n_lines.cast("long"),
        __n_dropped=F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        __kept=F.when(F.col("gone").isNull(), text).otherwise(left),
    )
