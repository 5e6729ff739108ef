"""Operator 3, MinHash near-dedup with tensored banding.

A document's set is its distinct ``WORDS``-word shingles (lower-cased A-Z; words are runs without blanks). Two
collections of ``M`` small bands are taken from 2 x M x K minhashes; table (i, j) is keyed by band i of the first
collection with band j of the second, so M x M tables of 2K hashes cost 2MK minhashes, not 2MMK. At similarity .85 a
pair shares a table with a chance over .9998.

From keys to links, without all pairs of a group:
1. Rows with equal sets are one class (copies are never paired). Classes that share no band of one collection, or
   none of the other, can share no table and are left out before the tables' keys are made.
2. Each table bucket pairs its members with its smallest one only; these pairs are verified on the full sets.
3. Buckets that still hold several components: those members outside the largest component are compared with all
   of other components, if they are ``SMALL`` or fewer, so that the comparisons stay in proportion to the bucket; else
   members are compared where they share a token of their prefix in one order of all tokens, which misses no pair at the
   threshold. Pairs already in one component are not compared again.
Verification moves a class's set once per pair, in groups of ``GROUP`` around a pivot, streamed. Before that, a pair
is ruled out where sizes or parity bitmaps alone show that it cannot reach the threshold: every bit in which the
bitmaps differ is a shingle that only one of the sets has.

Defined cases: a text with fewer words is one shingle, the whole sequence; a text without words, or null, has an
empty set and links with nothing; repeated rows are one class; component_id is the smallest id, nulls aside (null if
all are). Extra columns are left out of the work.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, column, drop_work, hub_join, parts_of, text_hash, tidy, unboxed, work_table
from .graph import components

WORDS, M, K = 5, 10, 3
#: MEMORY: distinct words that a worker remembers; PART_BYTES: bytes of text whose sets it holds at once.
SMALL, GROUP, MEMORY, PART_BYTES = 16, 256, 200_000, 1 << 20
#: Holders of a token that are compared in one task; a token with more is split into pairs of such blocks.
TOKEN_BLOCK = 256
#: Slots by which tokens are ordered, and nodes whose tokens are counted for that.
SLOTS, ORDER_NODES = 1 << 14, 20_000
#: Parity bitmaps of 256 bits, as columns of 64.
BITS = ("b0", "b1", "b2", "b3")
#: Up to so many candidate classes (16 bytes each) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20_240_607)
_MULT = _rng.integers(1 << 32, 1 << 63, 2 * M * K, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 2 * M * K, dtype=np.uint64)
_MIX = _rng.integers(1 << 32, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _final(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Texts to sets of 64-bit shingle hashes, as sorted arrays."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def set_of(self, text: str | None) -> np.ndarray:
        found = _WORD.findall((text or "").translate(_LOWER))
        if not found:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        n = min(self.words, len(h))
        total = np.full(len(h) - n + 1, np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)), dtype=np.uint64)
        for i in range(n):
            total += h[i : len(h) - n + 1 + i] * _MIX[i % 64] + (np.uint64(i // 64))
        return np.unique(_final(total))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2 M K) minhashes of sets that are not empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_MULT)), dtype=np.uint64)
    for k in range(len(_MULT)):
        out[:, k] = np.minimum.reduceat(joined * _MULT[k] + _ADD[k], starts)
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """(rows, 2 M) band hashes: the first M of one collection, the others of the other."""
    grouped = mins.reshape(len(mins), 2 * M, K)
    total = np.broadcast_to(np.arange(2 * M, dtype=np.uint64), grouped.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(K):
        total = total + grouped[:, :, k] * _MIX[k]
    return _final(total)


def bitmap(mine: np.ndarray) -> list[int]:
    """For each of 256 values of the low bits, whether an odd number of the set's hashes has it."""
    odd = np.bincount((mine & np.uint64(64 * len(BITS) - 1)).astype(np.int64), minlength=64 * len(BITS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of docs (doc_id, text, text_hash): doc_id, n_shingles, node (16 bytes that stand for the set; null for an empty set), a and b (bands), text_hash."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for whole in batches:
            for batch in parts_of(whole, 1, PART_BYTES):
                sets = [shingler.set_of(t.as_py()) for t in batch.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(_signed(bands(minhashes(full))).tolist() if full else [])
                made = [next(keys) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([m and m[:M] for m in made], pa.list_(pa.int64())),
                        pa.array([m and m[M:] for m in made], pa.list_(pa.int64())),
                        batch.column(2),
                    ],
                    ["doc_id", "n_shingles", "node", "a", "b", "text_hash"],
                )
        tidy(shingler.known.clear)

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, a array<long>, b array<long>, text_hash long")


def _sharing(nodes: DataFrame, column: str) -> DataFrame:
    """The nodes that share a band of a collection with another node."""
    each = nodes.select("node", F.posexplode(column).alias("i", "h"))
    shared = each.groupBy("i", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "h")
    return each.join(shared, ["i", "h"], "left_semi").select("node").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, set and its bitmap) for wanted (node, doc_id)."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for whole in batches:
            for batch in parts_of(whole, 1, PART_BYTES):
                sets = [shingler.set_of(t.as_py()) for t in batch.column(1)]
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                keep = [i for i, node in enumerate(nodes) if node == batch.column(0)[i].as_py()]
                bits = list(zip(*[bitmap(sets[i]) for i in keep], strict=True)) or [()] * len(BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in keep], pa.binary()), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary()), *(pa.array(b, pa.int64()) for b in bits)],
                    ["node", "n", "set", *BITS],
                )
        tidy(shingler.known.clear)

    few = wanted.count() <= BROADCAST_ROWS
    picked = wanted.select("node", F.col("doc_id").alias("id2"))
    picked = F.broadcast(picked) if few else picked
    joined = docs.join(picked, F.col("doc_id").eqNullSafe(F.col("id2")))
    return joined.select("node", "text").mapInArrow(run, "node binary, n long, set binary, " + ", ".join(f"{b} long" for b in BITS)).dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those with 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        at, pivot = None, None
        for whole in batches:
            out: tuple[list, list] = ([], [])
            for i in range(whole.num_rows):
                key = (whole.column(0)[i].as_py(), whole.column(1)[i].as_py())
                mine = np.frombuffer(whole.column(4)[i].as_py(), dtype=np.uint64)
                if whole.column(2)[i].as_py() == 0:
                    at, pivot = key, mine
                    continue
                if at != key:
                    raise RuntimeError("a member came before its pivot")
                where = np.searchsorted(pivot, mine)
                where[where == len(pivot)] = 0
                common = int((pivot[where] == mine).sum())
                if 100 * common >= percent * (len(pivot) + len(mine) - common):
                    out[0].append(key[0])
                    out[1].append(whole.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["u", "v"])

    # a pivot with many partners is many groups, each with the pivot's set
    degrees = work_table(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("c")), "degrees")
    salted = hub_join(pairs, degrees, "u", GROUP).select("u", "v", F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("c") / GROUP)).cast("int").alias("g"))
    salted = work_table(salted, "pairs")
    heads = salted.select("u", "g").distinct().select("u", "g", F.lit(0).alias("o"), F.col("u").alias("v"))
    rows = salted.select("u", "g", F.lit(1).alias("o"), "v").union(heads)
    with_sets = rows.join(sets.select(F.col("node").alias("v2"), "set"), F.col("v") == F.col("v2")).select("u", "g", "o", "v", "set")
    dealt = with_sets.repartition("u", "g").sortWithinPartitions("u", "g", "o")
    links = work_table(dealt.mapInArrow(run, "u binary, v binary"), "links")
    drop_work(salted)
    drop_work(degrees)
    return links


def _like(percent: int, n: str, m: str):
    """Sizes so different that the similarity cannot reach the threshold are ruled out."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _differ(percent: int, n: str, m: str, other: str = "other_"):
    """Whether so few bits differ that the similarity can reach the threshold: what only one set has is at least those."""
    bits = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(other + b))) for b in BITS), F.lit(0))
    return (F.col(n) + F.col(m) - bits) * (100 + percent) >= 2 * percent * (F.col(n) + F.col(m))


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) that neither sizes nor bitmaps rule out."""
    one = sets.select(F.col("node").alias("u2"), "n", *BITS)
    other = sets.select(F.col("node").alias("v2"), F.col("n").alias("m"), *(F.col(b).alias(f"other_{b}") for b in BITS))
    both = pairs.join(one, F.col("u") == F.col("u2")).join(other, F.col("v") == F.col("v2"))
    return both.where(_like(percent, "n", "m") & _differ(percent, "n", "m")).select("u", "v")


def _common_slots(sets: DataFrame, nodes: int) -> np.ndarray:
    """How often tokens fall into each of SLOTS, over ORDER_NODES of the nodes at most: it only decides which tokens make prefixes, so what is found does not depend on it."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.bincount((np.frombuffer(one.as_buffer(), dtype=np.int64) & (SLOTS - 1)), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    unit = F.pmod(F.xxhash64(F.lit("order"), "node"), F.lit(1 << 20)) / float(1 << 20)
    sample = work_table(sets.where(unit < min(1.0, ORDER_NODES / max(nodes, 1))).select("set"), "order")
    rows = sample.mapInArrow(count, "total binary").collect()
    drop_work(sample)
    return sum((np.frombuffer(r["total"], dtype=np.int64) for r in rows), np.zeros(SLOTS, dtype=np.int64))


def _prefix_pairs(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of hot nodes (node, root) in different components that share a token of both prefixes.

    In any one order of all tokens, sets that are similar enough share one of their first n - ceil(percent n) + 1; here
    tokens from rarer slots come first.
    """
    marked = work_table(sets.join(hot.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2")).select("node", "n", "root", *BITS, "set"), "marked")
    common = _common_slots(marked, hot.count())

    def prefixes(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, tokens, places = [], [], []
                for i, one in enumerate(batch.column(7)):
                    mine = np.frombuffer(one.as_buffer(), dtype=np.int64)
                    k = len(mine) + percent * len(mine) // -100 + 1
                    first = np.lexsort((mine, common[mine & (SLOTS - 1)]))[:k]
                    rows.append(np.full(k, i))
                    tokens.append(mine[first])
                    places.append(np.arange(k))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places)), *(batch.column(c).take(take) for c in range(7))], ["t", "pos", "node", "n", "root", *BITS])

    held = work_table(marked.mapInArrow(prefixes, "t long, pos long, node binary, n long, root binary, " + ", ".join(f"{b} long" for b in BITS)), "prefixes")
    drop_work(marked)
    split = held.groupBy("t").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("h")).where("r1 <> r2")
    # the holders of a token are dealt into blocks, and pairs of blocks are compared, each in its own group
    blocks = F.ceil(F.col("h") / TOKEN_BLOCK).cast("int")
    x = held.join(split.select(F.col("t").alias("t2"), blocks.alias("blocks")), F.col("t") == F.col("t2")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = work_table(x.select("t", "node", "n", "root", "pos", "blocks", "mine", *BITS), "prefixes")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    y = x.select("t", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("root2"), F.col("pos").alias("pos2"), F.col("mine").alias("other"), every.alias("mine"), *(F.col(b).alias(f"other_{b}") for b in BITS))
    x = x.withColumn("other", every)
    # what follows the first common token in either order bounds what they can share; later common tokens only bound it more
    reach = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2")) * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    return x.join(y, ["t", "mine", "other"]).where((F.col("node") < F.col("v")) & (F.col("root") != F.col("root2")) & _like(percent, "n", "m") & reach & _differ(percent, "n", "m")).select(F.col("node").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash of every row. Made for thresholds of .8 and more."""
    docs = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), text_hash(column(text_col)).alias("text_hash"))
    signed = work_table(signatures(docs, words), "signatures")
    first = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = work_table(first.select("node", "doc_id", "n", "a", "b"), "classes")
    some = classes.join(work_table(_sharing(classes, "a"), "sharing"), "node", "left_semi")
    some = work_table(some.join(_sharing(some, "b"), "node", "left_semi"), "sharing")
    keys = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y)))))
    each = some.select("node", "n", keys.alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low")).where("size > 1")
    shared = work_table(shared.withColumnRenamed("key", "key2"), "buckets")
    members = work_table(each.join(shared, F.col("key") == F.col("key2")).select("key", "node", "n", "size", "low"), "members")
    ids = classes.select("node", "doc_id").join(members.select("node").distinct(), "node", "left_semi")
    sets = work_table(_sets(docs, work_table(ids, "candidates"), words), "sets")
    pairs = members.where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    pairs = work_table(_plausible(pairs, sets, percent), "pairs")
    links = _verify(pairs, sets, percent)
    drop_work(shared)
    roots = work_table(components(links), "roots").withColumnRenamed("node", "node2")
    rooted = members.join(roots, F.col("node") == F.col("node2"), "left").select("key", "node", "n", "size", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    still = work_table(rooted.join(open_keys, "key", "left_semi"), "open")
    # all members are compared with those outside the bucket's largest component, where these are few
    parts = still.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("most"))
    parts = work_table(parts.select(F.col("key").alias("key2"), F.col("most.root").alias("main"), (F.col("all") - F.col("most.c")).alias("others")), "parts")
    still_parts = still.join(parts, F.col("key") == F.col("key2")).drop("key2")
    one = sets.select(F.col("node").alias("node3"), *BITS)
    few = work_table(still_parts.where(F.col("others") <= SMALL).join(one, F.col("node") == F.col("node3")).select("key", "node", "n", "root", (F.col("root") != F.col("main")).alias("apart"), *BITS), "few")
    x = few.where("apart")
    y = few.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("root2"), F.col("apart").alias("apart2"), *(F.col(c).alias(f"other_{c}") for c in BITS))
    more = x.join(y, "key").where((F.col("root") != F.col("root2")) & (~F.col("apart2") | (F.col("node") < F.col("v"))) & _like(percent, "n", "m") & _differ(percent, "n", "m"))
    more = more.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
    hot = work_table(still_parts.where(F.col("others") > SMALL).select("node", "root").distinct(), "hot")
    if not hot.isEmpty():
        more = more.union(_prefix_pairs(hot, sets, percent))
    more = more.distinct().join(pairs, ["u", "v"], "left_anti")
    late = _verify(work_table(more, "pairs"), sets, percent)
    if not late.isEmpty():
        known = roots.select(F.col("node2").alias("u"), F.col("root").alias("v"))
        drop_work(still)
        roots = work_table(components(known.union(late)), "roots").withColumnRenamed("node", "node2")
    named = classes.select("node", "doc_id").join(roots, F.col("node") == F.col("node2")).select("node", "root", "doc_id")
    named = work_table(named, "named")
    least = work_table(named.groupBy("root").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("c")), "least")
    linked = work_table(hub_join(named, least, "root").select(F.col("node").alias("node2"), "component"), "components")
    owners = classes.select(F.col("node").alias("node3"), F.col("doc_id").alias("first_id")).join(linked, F.col("node3") == F.col("node2"), "left")
    owners = work_table(owners.select("node3", F.coalesce("component", "first_id").alias("component")), "owners")
    out = signed.select("doc_id", "n_shingles", "node", "text_hash").join(owners, F.col("node") == F.col("node3"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs without the rows that are not kept. A row is known by its id and text; rows that repeat both stay or go together."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("th2")).distinct()
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    return unboxed(boxed(docs, id_col, text_col).join(gone.hint("shuffle_hash"), same, "left_anti"), docs)
