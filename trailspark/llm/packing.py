"""Operator 6, packing: mixture-controlled, by deficit round-robin over source queues.

Every source is a queue of ids, the documents of its tasks laid end to end. In each round every queue's credit grows by
its quantum, its target share of one window, and the queue sends as many ids as its credit covers; what is below one id
(below ``GRAIN`` ids where the quantum is smaller than that) is its deficit, carried to the next round, and so across
windows and partitions. As a queue's credit only depends on the round, what all queues have sent before any round is
known from their lengths and quanta alone: the place of every id is computed where its document lies, without a
sequential pass and without moving ids. The rounds laid end to end are cut into sequences of ``WINDOW`` ids, so that
only the very last one can be short; a document is cut where a round or a sequence ends. A full window differs from
the targets of the queues that still hold ids by the grain, and one id a queue, at most.

Targets default to each source's share of all ids; given targets hold until a source runs dry, and every document is
packed in any case. Sources under 1 / ``TAIL`` of the ids share ``TAIL`` tail queues, dealt by hash: so there are no more
than 2 x ``TAIL`` queues (and one for each given target), however many sources there are. Prefix sums have two levels
(task, then tasks), so no queue is gathered anywhere: a source with a third of all rows is as many partial sums as tasks.
Ids are computed once and written with their documents.

Defined cases: a null text is empty (one closing id); a null source is a queue of its own; repeated rows are packed
each by itself; ties do not arise, as queues are ordered by name and documents by their place in the input; a very
long text is cut like any other; an empty table gives no pieces. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, parts_of, release, tidy, work_table

WINDOW, GRAIN, TAIL, END_ID = 2048, 16, 64, 1
#: Pieces of words whose ids a worker remembers.
MEMORY = 300_000
#: Bytes of texts, and of ids, that a worker has in hand at once: it needs several times as many for them.
TEXT_BYTES, IDS_BYTES = 2 << 20, 1 << 20
#: Letters whose lower case is one letter and that normalisation leaves alone, and signs that may close them (no apostrophe, and none that special tokens begin with).
SIMPLE = "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)(?P<mark>[!-&(-/:;=?@\\[-`{}~]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by the tokenizers library, for each distinct blank-separated word once: its vocabulary drops blanks, and no token spans one.

    The library splits letters from what follows them and reads them in lower case, so a word of letters and closing
    punctuation is put together from both; the letters of many new words are encoded as one text, whose ids part where
    a token ends a word. ``pool`` holds the ids of all known pieces, each at ``starts`` for ``lengths``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        import pyarrow as pa

        # pieces stay in Arrow: as Python strings in a dict they take several times the bytes
        self.known = pa.array([], pa.large_string())
        self.starts, self.lengths, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _alone(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, dtype=np.uint32) for got in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str], letters: bool) -> None:
        ids, lengths = [], []
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            if letters:
                joined = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cuts = np.flatnonzero(self.ends[joined]) + 1
                if len(cuts) == len(part) and cuts[-1] == len(joined):
                    ids.append(joined)
                    lengths.append(np.diff(cuts, prepend=0))
                    continue
            made = self._alone(part)
            ids += made
            lengths.append(np.array([len(x) for x in made], dtype=np.int64))
        if pieces:
            n = np.concatenate(lengths)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(n) - n])
            self.lengths = np.concatenate([self.lengths, n])
            self.pool = np.concatenate([self.pool, *ids])

    def _numbers(self, pieces, letters: bool) -> np.ndarray:
        """The numbers of pieces, an Arrow array of distinct strings: their places among the known ones."""
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = pieces.cast(pa.large_string())
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        numbers = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        numbers[numbers < 0] = len(self.known) + np.arange(len(new))
        self._learn(new.to_pylist(), letters)
        self.known = pa.concat_arrays([self.known, new])
        return numbers

    def _ids(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, laid end to end."""
        n = self.lengths[pieces]
        until = np.cumsum(n)
        return self.pool[np.repeat(self.starts[pieces] - until + n, n) + np.arange(n.sum())]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow array of texts: all their ids, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > MEMORY:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        word_ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        del split
        parts = pc.extract_regex(words.dictionary, SIMPLE)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(parts.field("stem").filter(pa.array(plain))).dictionary_encode()
        # each word is two known pieces, the second often empty: a stem and what closes it, or the word and nothing
        others = pa.concat_arrays([parts.field("mark").filter(pa.array(plain)), words.dictionary.filter(pa.array(~plain)), pa.array([""], words.dictionary.type)]).dictionary_encode()
        n = stems.indices.to_numpy(), self._numbers(others.dictionary, False)[others.indices.to_numpy()]
        both = np.empty((len(plain), 2), np.int64)
        both[plain, 0], both[plain, 1] = self._numbers(stems.dictionary, True)[n[0]], n[1][: len(n[0])]
        both[~plain, 0], both[~plain, 1] = n[1][len(n[0]) : -1], n[1][-1]
        # the ids of each distinct word once, as bytes that Arrow lays end to end: no index for each id
        until = np.cumsum(self.lengths[both].sum(axis=1))
        once = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(np.r_[0, 4 * until]), pa.py_buffer(self._ids(both.ravel()))])
        if not len(words):
            return np.empty(0, np.uint32), np.diff(word_ends)
        _, ends, ids = once.take(words.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[word_ends] // 4
        return np.frombuffer(ids or b"", np.uint32)[: ends[-1]], np.diff(ends)


_encoders: dict[str, WordIds] = {}


def encoder(path: str | None) -> WordIds:
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _encoded(docs: DataFrame, path: str | None, end_id: int) -> DataFrame:
    """One row per document: task, source, doc_id, its ids, their number, and the source's ids up to its end within the task."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc, task = encoder(path), TaskContext.get().partitionId()
        ends: dict[str | None, int] = {}
        for whole in batches:
            for batch in parts_of(whole, 1, TEXT_BYTES):
                release()
                ids, lengths = enc.encode(batch.column(1))
                until = np.cumsum(lengths)
                closed = np.insert(ids, until, end_id).astype("<u4", copy=False)
                del ids
                until += np.arange(1, len(until) + 1)
                mine = []
                for source, n in zip(batch.column(2).to_pylist(), (lengths + 1).tolist(), strict=True):
                    ends[source] = end = ends.get(source, 0) + n
                    mine.append(end)
                offsets = pa.py_buffer(np.concatenate([[0], 4 * until]).astype("<i4"))
                binary = pa.Array.from_buffers(pa.binary(), len(until), [None, offsets, pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(until), pa.int32()), batch.column(2), batch.column(0), binary, pa.array(lengths + 1, pa.int64()), pa.array(mine, pa.int64())], ["task", "source", "doc_id", "ids", "doc_tokens", "end"])
        tidy(enc.forget)

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"task int, source string, doc_id {kind}, ids binary, doc_tokens long, end long")


class Schedule:
    """What deficit round-robin sends when: queues in order, with their lengths and quanta (in 1 / 65,536 of an id)."""

    def __init__(self, tokens: list[int], shares: list[float]):
        self.tokens = np.array(tokens, dtype=np.int64)
        total = sum(shares) or 1.0
        self.quantum = np.array([max(1, round(x / total * WINDOW * 65_536)) for x in shares], dtype=np.int64)
        self.grain = np.where(self.quantum >= GRAIN << 16, 1, GRAIN)
        # credits to begin with, all below a grain and spread evenly, so that small queues do not send in the same rounds
        self.credit = (np.arange(len(tokens)) * 0.6180339887498949 % 1 * self.grain * 65_536).astype(np.int64)

    def sent(self, queue, rounds) -> np.ndarray:
        """Ids that a queue has sent before a round."""
        grain = self.grain[queue]
        return np.minimum(self.tokens[queue], (rounds * self.quantum[queue] + self.credit[queue] >> 16) // grain * grain)

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round in which the id at a place of its queue is sent."""
        grain = self.grain[queue]
        need = np.minimum(at // grain + 1, -(-self.tokens[queue] // grain)) * grain
        return -(((self.credit[queue] - (need << 16)) // self.quantum[queue])) - 1

    def cut(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of ids of queues, cut where rounds and windows end: (number of the run, start inside it, length, place in all)."""
        first, last = self.round_of(queue, start), self.round_of(queue, start + length - 1)
        run = np.repeat(np.arange(len(queue)), last - first + 1)
        at_round = np.arange(len(run)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[run]
        q = queue[run]
        begin = np.maximum(start[run], self.sent(q, at_round))
        end = np.minimum((start + length)[run], self.sent(q, at_round + 1))
        rounds, of_round = np.unique(at_round, return_inverse=True)
        every = np.arange(len(self.tokens))
        before, after = self.sent(every, rounds[:, None]), self.sent(every, rounds[:, None] + 1)
        ahead = before.sum(axis=1, keepdims=True) + np.cumsum(after - before, axis=1) - (after - before)
        place = ahead[of_round, q] + begin - self.sent(q, at_round)
        # a piece is no longer than a window, so that it is cut once at most
        here = np.minimum(end - begin, WINDOW - place % WINDOW)
        rest = end - begin - here
        twice = np.repeat(np.arange(len(run)), 1 + (rest > 0))
        second = np.r_[False, twice[1:] == twice[:-1]]
        skip = np.where(second, here[twice], 0)
        return run[twice], (begin - start[run])[twice] + skip, np.where(second, rest[twice], here[twice]), place[twice] + skip


def _placed(schedule: Schedule, kind: str):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in parts_of(whole, 1, IDS_BYTES):
                queue, end, tokens = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
                row, start, length, place = schedule.cut(queue, end - tokens, tokens)
                views = [memoryview(x.as_buffer()) for x in batch.column(1)]
                crc = [zlib.crc32(views[r][a:b]) for r, a, b in zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(place // WINDOW), pa.array(place % WINDOW)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        tidy()

    return run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence; targets: source -> share of a window."""
    picked = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(source_col).cast("string").alias("source"))
    encoded = work_table(_encoded(picked, path, end_id), "packing-ids")
    # first level: ids of each source in each task; second level: what the tasks before it hold
    sums = work_table(encoded.groupBy("source", "task").agg(F.sum("doc_tokens").alias("tokens")), "packing-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    share, own = F.col("tokens") / float(total), F.col("tokens") * TAIL >= total
    if targets:
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v) / sum(targets.values()))])
        share, own = F.coalesce(given[F.col("source")], share), own | given[F.col("source")].isNotNull()
    tail = F.format_string("tail %d", F.pmod(F.xxhash64("source"), F.lit(TAIL)))
    name = F.when(own & F.col("source").isNull(), F.lit("no source")).when(own, F.concat(F.lit("source "), F.col("source"))).otherwise(tail)
    sources = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).select(F.col("source").alias("source2"), name.alias("name"), share.alias("share"), "tokens")
    sources = work_table(sources, "packing-sources")
    queues = sources.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.sum("share").alias("share")).orderBy("name").collect()
    schedule = Schedule([r["tokens"] for r in queues], [r["share"] for r in queues])
    number = F.array_position(F.lit([r["name"] for r in queues]), F.col("name")).cast("int") - 1
    named = sums.join(sources.drop("tokens"), F.col("source").eqNullSafe(F.col("source2"))).select("source", "task", "tokens", number.alias("queue"))
    before = F.sum("tokens").over(Window.partitionBy("queue").orderBy("task", "source")) - F.col("tokens")
    bases = work_table(named.select(F.col("source").alias("source3"), F.col("task").alias("task3"), "queue", before.alias("before")), "packing-bases")
    ready = encoded.join(bases, (F.col("task") == F.col("task3")) & F.col("source").eqNullSafe(F.col("source3")))
    run, schema = _placed(schedule, picked.schema[0].dataType.simpleString())
    return ready.select("doc_id", "ids", "queue", (F.col("before") + F.col("end")).alias("end"), "doc_tokens").mapInArrow(run, schema)
