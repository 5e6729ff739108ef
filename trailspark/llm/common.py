"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="package-"), "trailspark_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_table(df: DataFrame, name: str, sort: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """df written once as Parquet into the shared folder and read again: lineage is cut, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._work_path = path
    return back


#: A hub holds more than one in so many of all rows: so there are fewer hubs than this, whatever the input.
HUBS = 10_000


def hub_join(rows: DataFrame, facts: DataFrame, key: str, least: int = 256) -> DataFrame:
    """rows with the columns of facts, a work table that has one row per key, and in c the number of its rows.

    The facts of hubs, fewer than HUBS, are broadcast to their rows; no other key has enough rows to burden a task.
    """
    total = facts.agg(F.sum("c")).first()[0] or 0
    facts = facts.withColumnRenamed(key, "key2")
    hub = F.col("c") > max(least, total // HUBS)
    same = F.col(key) == F.col("key2")
    hubs = facts.where(hub)
    if hubs.isEmpty():
        return rows.join(facts, same).drop("key2")
    others = rows.join(F.broadcast(hubs.select("key2")), same, "left_anti").join(facts.where(~hub), same)
    return rows.join(F.broadcast(hubs), same).unionByName(others).drop("key2")


def drop_work(df: DataFrame) -> None:
    """Deletes a work table that nothing reads any more."""
    if path := getattr(df, "_work_path", None):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; lower() is far faster and the same where all is ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores put before it as make it new among the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(box, id, th): all columns of docs in one struct, so that no name of theirs can clash with an operator's own, and
    the row's identity: its id and its text's hash, so that a null or repeated id does not mix rows of different texts.
    """
    return docs.select(F.struct(*map(column, docs.columns)).alias(free(docs, "box")), column(id_col).alias("id"), text_hash(column(text_col)).alias("th"))


def unboxed(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of their box in df, and the new ones under names that are free."""
    box = free(docs, "box")
    made = df.select(box, *(value.alias(f"{box}_{i}") for i, value in enumerate(new.values())))
    return made.select(*(F.col(box).getField(c).alias(c) for c in docs.columns), *(F.col(f"{box}_{i}").alias(free(docs, name)) for i, name in enumerate(new)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often, and in whatever lambda, use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tidy(*forget) -> None:
    """Gives memory back at the end of a Python task: its worker is used again, by other operators too."""
    import gc

    for f in forget:
        f()
    gc.collect()
    release()


def release() -> None:
    """Gives back what the allocators keep of freed memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: nothing to trim
        pass


def parts_of(batch, place: int, size: int = 4 << 20):
    """Slices of a batch whose texts have about size bytes."""
    import numpy as np
    import pyarrow.compute as pc

    until = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(until)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
