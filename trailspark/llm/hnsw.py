"""Operator 8, embedding near-dedup: sampled vectors as an upper level that leads to cells, each cell compared whole.

Equal vectors are one class. A bounded sample of the classes, about one in ``CELL`` and fewer once there are many, is the
upper level, as the nodes that a navigable small world draws for its upper levels. Every class lies in the cell of its
nearest sample and visits the cells of all samples that are within a margin of the nearest; it is compared there with
all who lie there, so a pair is missed only if neither visits the other's cell. An audit compares up to ``AUDITED``
classes with all rows by brute force, and the margin is the least that covers ``AUDIT`` of the links it found, and ``MADE`` of
partners made exactly at the threshold in random directions (the hardest links, in data without structure). Cosines near
the threshold are verified in double precision. A cell sends each class's link count and a spanning forest of the links
it found, never all pairs; components are united over the forests.

Memory and disk are bounded by bytes: a cell's rows are dealt to chunks of ``CHUNK_BYTES`` and its visitors to blocks of ``BLOCK_BYTES``,
each of which meets each; cells come in waves, so that no more than about the table's own size is exchanged at once. Work
grows with rows times visited cells times a cell's rows, plus rows times samples (rows to the power 1.5 from 10 million on);
a group of vectors that all link with each other is compared pair by pair.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of another length are compared among themselves; copies link with each other; repeated
ids are vectors of their own; a null id is never a component's name unless all are null.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work, hub_join, work_table
from .graph import components

#: CELL classes to a cell, or sqrt(classes / SPREAD) where that is more; all samples together have SAMPLE_BYTES at most.
CELL, SPREAD, SAMPLE_BYTES = 1_000, 10, 32_000_000
CHUNK_BYTES, BLOCK_BYTES, WAVE_BYTES = 8_000_000, 16_000_000, 100_000_000
AUDIT, AUDITED, MADE, STEP = 0.9999, 1_024, 0.95, 0.002
#: Similarities that are computed at once.
AT_ONCE = 2_000_000


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _slack(dim: int) -> float:
    """More than single precision can be off in a cosine."""
    return max(1e-4, dim * 2.5e-7)


def _units(raws: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of keyed()'s raw, which holds floats where they are exact, else doubles."""
    if all(len(r) == 4 * dim for r in raws):
        return _unit(np.frombuffer(b"".join(raws), dtype=np.float32).reshape(len(raws), dim).astype(np.float64))
    return _unit(np.stack([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raws]))


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, node (16 bytes that stand for the vector; null where it links with nothing), dim, raw (its floats where they are exact, else its doubles)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, dims, raws = [], [], []
            for v in batch.column(1):
                v = v.as_py()
                x = np.array(v, dtype=np.float64) if v and None not in v else np.empty(0)
                with np.errstate(over="ignore", under="ignore"):
                    length = float((x * x).sum()) if len(x) and np.isfinite(x).all() else 0.0
                if length > 0 and not math.isfinite(length) or len(x) and np.isfinite(x).all() and x.any() and length < 1e-200:
                    x = x / np.abs(x).max()  # the same direction, in a range where squares are safe
                    length = float((x * x).sum())
                good = length > 0
                nodes.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                dims.append(len(x) if good else None)
                with np.errstate(over="ignore", under="ignore"):
                    single = x.astype(np.float32)
                raws.append((single if np.array_equal(single, x) else x).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "node", "dim", "raw"])

    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, f"vec_id {kind}, node binary, dim int, raw binary")


def _over(margin: np.ndarray, count: np.ndarray, query: np.ndarray) -> float:
    """The least margin that covers AUDIT of all links, and of each query's on average."""
    order = np.argsort(margin, kind="stable")
    margin, count, query = margin[order], count[order], query[order]
    _, of = np.unique(query, return_inverse=True)
    share = count / np.bincount(of, count)[of]
    least = np.minimum(np.cumsum(count) / count.sum(), np.cumsum(share) / share.sum())
    return float(margin[min(len(margin) - 1, int(np.searchsorted(least, AUDIT - 1e-9)))])


def _covered(margin: np.ndarray, count: np.ndarray, query: np.ndarray, within: float) -> float:
    """The share of links that a margin covers: of all, or of each query's on average if that is less."""
    _, of = np.unique(query, return_inverse=True)
    inside = count * (margin <= within)
    return float(min(inside.sum() / count.sum(), (np.bincount(of, inside) / np.bincount(of, count)).mean()))


def _gaps(x: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest sample and the similarity to it."""
    home, best = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.float32)
    size = max(1, AT_ONCE // len(samples))
    for a in range(0, len(x), size):
        sims = x[a : a + size] @ samples.T
        home[a : a + size] = sims.argmax(axis=1)
        best[a : a + size] = sims.max(axis=1)
    return home, best


def _made(q: np.ndarray, samples: np.ndarray, threshold: float) -> float:
    """The margin that covers MADE of partners at the threshold, each in a random direction from its query."""
    q = q.astype(np.float64)
    w = np.random.default_rng(13).normal(size=q.shape)
    w -= (w * q).sum(axis=1, keepdims=True) * q
    w /= np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1e-12)
    v = (threshold * q + math.sqrt(max(0.0, 1 - threshold * threshold)) * w).astype(np.float32)
    q = q.astype(np.float32)
    (hq, bq), (hv, bv) = _gaps(q, samples), _gaps(v, samples)
    need = np.minimum(bq - (q * samples[hv]).sum(axis=1), bv - (v * samples[hq]).sum(axis=1))
    return float(np.quantile(need, MADE, method="higher"))


def _links(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float):
    """(i, j) of all pairs of a row of x and one of y at or above threshold, in parts; x32, y32: the same in single precision."""
    slack, size, pairs = _slack(x.shape[1]), max(1, AT_ONCE // max(1, len(y))), max(1, AT_ONCE // x.shape[1])
    for a in range(0, len(x), size):
        sims = x32[a : a + size] @ y32.T
        i, j = np.nonzero(sims >= threshold - slack)
        if not len(i):
            continue
        near = np.flatnonzero(sims[i, j] < threshold + slack)
        i += a
        keep = np.ones(len(i), dtype=bool)
        for b in range(0, len(near), pairs):
            at = near[b : b + pairs]
            keep[at] = np.einsum("pd,pd->p", x[i[at]], y[j[at]]) >= threshold
        yield i[keep], j[keep]


def _by_dim(batch):
    """(dim, rows, unit vectors) of the rows of an Arrow batch with columns dim and raw."""
    dims, raws = batch.column("dim").to_numpy(zero_copy_only=False), batch.column("raw")
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        size = max(1, BLOCK_BYTES // (8 * dim))
        for a in range(0, len(rows), size):
            part = rows[a : a + size]
            yield dim, part, _units(raws.take(part).to_pylist(), dim)


def _audit(levels: dict, threshold: float):
    """Rows to (dim, query, step, count): of the audited queries' links to rows, the margins that cover them, in steps."""

    def run(batches):
        import pyarrow as pa

        homes = {dim: _gaps(q.astype(np.float32), samples) for dim, (samples, q, _) in levels.items()}
        for batch in batches:
            out = []
            nodes = batch.column("node").to_pylist()
            for dim, rows, x in _by_dim(batch):
                samples, q, names = levels[dim]
                hq, bq = homes[dim]
                own = {n: k for k, n in enumerate(names)}
                own = np.array([own.get(nodes[r], -1) for r in rows])
                x32, q32, size = x.astype(np.float32), q.astype(np.float32), max(1, AT_ONCE // dim)
                for i, j in _links(x, q, x32, q32, threshold):
                    i, j = i[own[i] != j], j[own[i] != j]
                    of, at = np.unique(i, return_inverse=True)
                    hv, bv = _gaps(x32[of], samples)
                    for a in range(0, len(i), size):
                        ii, jj, aa = i[a : a + size], j[a : a + size], at[a : a + size]
                        need = np.minimum(bq[jj] - np.einsum("pd,pd->p", q32[jj], samples[hv[aa]]), bv[aa] - np.einsum("pd,pd->p", x32[ii], samples[hq[jj]]))
                        step = np.maximum(0, np.ceil(need / STEP)).astype(np.int64) + 1
                        keys, counts = np.unique(jj * 10_000 + step, return_counts=True)
                        out.append((np.full(len(keys), dim), keys // 10_000, keys % 10_000, counts))
            dim, query, step, count = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.empty(0, dtype=np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(query, pa.int32()), pa.array(step, pa.int32()), pa.array(count, pa.int64())], ["dim", "query", "step", "count"])

    return run


def _route(levels: dict):
    """Adds home, the cell of the nearest sample, and cells, all that a class visits, its home too; levels: (samples, margin) by dim."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            home, cells = np.zeros(batch.num_rows, dtype=np.int64), [[0]] * batch.num_rows
            for dim, rows, x in _by_dim(batch):
                if dim not in levels:
                    continue
                samples, margin = levels[dim]
                x, size = x.astype(np.float32), max(1, AT_ONCE // len(samples))
                for a in range(0, len(rows), size):
                    sims = x[a : a + size] @ samples.T
                    home[rows[a : a + size]] = sims.argmax(axis=1)
                    i, j = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - margin)
                    for r, c in zip(rows[a : a + size], np.split(j, np.cumsum(np.bincount(i, minlength=len(sims)))[:-1]), strict=True):
                        cells[r] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "home", "cells"])

    return run


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: of each node its component's least node; a, b: links."""
    while len(a):
        la, lb = label[a], label[b]
        a, b, la, lb = (c[la != lb] for c in (a, b, la, lb))
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _compare(threshold: float):
    """Of a chunk of a cell's classes and a block of its visitors: (u, null, links) and a forest (u, v, 0) of the links.

    A link of two cells is counted for the visitor, and for the other too unless that one visits the visitor's cell.
    """

    def compare(key, residents, visitors):
        import pandas as pd

        empty = pd.DataFrame({"u": pd.Series(dtype=object), "v": pd.Series(dtype=object), "links": pd.Series(dtype="int64")})
        if not len(residents) or not len(visitors):
            return empty
        dim, cell = int(key[0]), int(key[1])
        names, guests = residents["node"].tolist(), visitors["node"].tolist()
        r, v = _units(residents["raw"].tolist(), dim), _units(visitors["raw"].tolist(), dim)
        place = {n: k for k, n in enumerate(names)}
        own = np.array([place.get(n, -1) for n in guests])
        node = np.where(own < 0, len(names) + np.arange(len(guests)), own)
        home, copies, guest_copies = visitors["home"].to_numpy(np.int64), residents["copies"].to_numpy(np.int64), visitors["copies"].to_numpy(np.int64)
        visits = residents["cells"].tolist()
        visits = np.repeat(np.arange(len(names)) << 32, [len(c) for c in visits]) + np.concatenate(visits)
        count, guest_count, label = np.zeros(len(names)), np.zeros(len(guests)), np.arange(len(names) + len(guests))
        for i, j in _links(v, r, v.astype(np.float32), r.astype(np.float32), threshold):
            other = own[i] != j
            i, j = i[other], j[other]
            guest_count += np.bincount(i, copies[j], len(guests))
            _unite(label, node[i], j)
            i, j = i[home[i] != cell], j[home[i] != cell]
            alone = ~np.isin((j << 32) + home[i], visits)
            count += np.bincount(j[alone], guest_copies[i[alone]], len(names))
        every = names + guests
        forest = np.flatnonzero(label != np.arange(len(label))).tolist()
        rows = [(names[k], None, int(count[k])) for k in np.flatnonzero(count)] + [(guests[k], None, int(guest_count[k])) for k in np.flatnonzero(guest_count)]
        rows += [(every[k], every[label[k]], 0) for k in forest]
        return pd.DataFrame(rows, columns=["u", "v", "links"]).astype({"links": "int64"}) if rows else empty

    return compare


def _upper(whole: DataFrame, threshold: float, cell: int) -> dict[int, tuple[np.ndarray, float, float | None]]:
    """By dim, where there are more classes than fit one cell: unit samples, the margin, and the recall that the audit measured (null without links).

    Recall is measured on the half of the queries that did not choose the margin, and the lower of both ways.
    """
    spark, good = whole.sparkSession, whole.where("node is not null")
    sizes = {d: n for d, n in good.groupBy("dim").agg(F.approx_count_distinct("node").alias("n")).where(F.col("n") > cell).collect()}
    if not sizes:
        return {}
    wanted = {d: n / max(cell, math.sqrt(n / SPREAD)) for d, n in sizes.items()}
    fits = min(1.0, SAMPLE_BYTES / sum(4 * d * k for d, k in wanted.items()))
    asked = min(AUDITED, SAMPLE_BYTES / (8 * max(sizes))) / sum(sizes.values())
    shares = spark.createDataFrame([(d, (wanted[d] * fits + 1) / n, asked) for d, n in sizes.items()], "dim int, sample double, query double")
    good = good.join(F.broadcast(shares), "dim")
    drawn = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1 << 40)) / float(1 << 40)
    good_draw = good.withColumns({"is_sample": drawn("sample") < F.col("sample"), "is_query": drawn("query") < F.col("query")}).where("is_sample or is_query")
    picked = good_draw.select("dim", "node", "raw", "is_sample", "is_query").dropDuplicates(["node"]).collect()
    levels = {}
    for dim in sizes:
        mine = [sorted((bytes(r["node"]), bytes(r["raw"])) for r in picked if r["dim"] == dim and r[what]) for what in ("is_sample", "is_query")]
        if len(mine[0]) < 2:
            continue
        x, q = (_units([raw for _, raw in rows], dim) if rows else np.empty((0, dim)) for rows in mine)
        levels[dim] = (x.astype(np.float32), q, [n for n, _ in mine[1]])
    seen = good.where(F.col("dim").isin([d for d, (_, q, _) in levels.items() if len(q)])).select("dim", "node", "raw").mapInArrow(_audit(levels, threshold), "dim int, query int, step int, count long")
    seen = seen.groupBy("dim", "query", "step").agg(F.sum("count")).collect()
    out = {}
    for dim, (samples, q, _) in levels.items():
        margin, recall = _made(q if len(q) else samples, samples, threshold), None
        rows = np.array([r[1:] for r in seen if r["dim"] == dim], dtype=np.float64).reshape(-1, 3)
        if len(rows):
            query, need, count = rows[:, 0], rows[:, 1] * STEP, rows[:, 2]
            even = query % 2 == 0
            halves = [(a, b) for a, b in ((even, ~even), (~even, even)) if b.any()]
            recall = min(_covered(need[b], count[b], query[b], max(margin, _over(need[a], count[a], query[a]) if a.any() else 0)) for a, b in halves)
            margin = max(margin, _over(need, count, query))
        out[dim] = (samples, margin, recall)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, and recall, which an audit measured for vectors of its length (1 where all were compared, null where the audit had no link to find)."""
    spark = vectors.sparkSession
    whole = work_table(keyed(vectors, id_col, vector_col), "vectors")
    ids = work_table(whole.select("vec_id", "node"), "ids")
    levels = _upper(whole, threshold, CELL)
    classes = whole.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    routed = classes.mapInArrow(_route({d: (x, m) for d, (x, m, _) in levels.items()}), classes.schema.simpleString()[7:-1].replace(":", " ") + ", home int, cells array<int>")
    routed = work_table(routed, "classes")
    drop_work(whole)
    found = _meet(routed, threshold)
    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node2")
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "node3")
    named = routed.select("node", "first_id").join(roots, F.col("node") == F.col("node3"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = work_table(named, "roots")
    least = work_table(named.groupBy("root").agg(F.min("first_id").alias("component"), F.count(F.lit(1)).alias("c")), "least")
    recalls = spark.createDataFrame([(d, True, recall) for d, (_, _, recall) in levels.items()], "dim int, audited boolean, recall double")
    facts = routed.select(F.col("node").alias("node4"), "copies", "dim").join(F.broadcast(recalls), "dim", "left").withColumn("recall", F.when(F.col("audited"), F.col("recall")).otherwise(F.lit(1.0)))
    owners = hub_join(named, least, "root").join(counts, F.col("node") == F.col("node2"), "left").join(facts, F.col("node") == F.col("node4"))
    owners = work_table(owners.select(F.col("node").alias("node5"), "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "recall"), "owners")
    out = ids.join(owners, F.col("node") == F.col("node5"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), "recall")


def _meet(routed: DataFrame, threshold: float) -> DataFrame:
    """All cells compared, in waves: u, v and links as _compare() returns them."""
    spark = routed.sparkSession
    loads = routed.select("dim", "home", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("cell") == F.col("home"), 1)).alias("r"))
    row = F.col("dim") * F.lit(8.0)
    loads = work_table(loads.select("dim", "cell", "v", "r", F.ceil(F.col("r") * row / CHUNK_BYTES).cast("int").alias("chunks"), F.ceil(F.col("v") * row / BLOCK_BYTES).cast("int").alias("blocks")).where("r > 0"), "loads")
    moved = loads.agg(F.sum((F.col("v") * F.col("chunks") + F.col("r") * F.col("blocks")) * row / 2)).first()[0] or 0
    table = routed.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    waves = max(1, math.ceil(moved / max(WAVE_BYTES, table)))
    crowded = loads.where("chunks > 1 or blocks > 1").select(F.col("dim").alias("dim2"), F.col("cell").alias("cell2"), "chunks", "blocks")
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    parts = []
    for wave in range(waves):
        now = lambda rows: rows.where(F.pmod(F.xxhash64("dim", "cell"), F.lit(waves)) == wave).join(F.broadcast(crowded), (F.col("dim") == F.col("dim2")) & (F.col("cell") == F.col("cell2")), "left")  # noqa: B023, E731
        lying = now(routed.withColumn("cell", F.col("home"))).select("dim", "cell", "node", "raw", "copies", "cells", dealt("chunk", F.col("chunks")).alias("chunk"), every(F.col("blocks")).alias("block"))
        guests = now(routed.withColumn("cell", F.explode("cells"))).select("dim", "cell", "node", "raw", "copies", "home", dealt("block", F.col("blocks")).alias("block"), every(F.col("chunks")).alias("chunk"))
        guests = guests.toDF(*guests.columns)  # columns of its own: both sides are of one table
        key = ["dim", "cell", "chunk", "block"]
        parts.append(work_table(lying.groupBy(*key).cogroup(guests.groupBy(*key)).applyInPandas(_compare(threshold), "u binary, v binary, links long"), "found"))
        if waves > 1:  # a wave's shuffle files go once nothing in the driver refers to them
            del lying, guests
            gc.collect()
            spark._jvm.System.gc()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
