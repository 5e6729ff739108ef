"""Operator 5, BPE encoding and decoding with a pair occurrence index.

A block's distinct pre-tokens are laid out as one array of symbols, and an index maps each adjacent pair that has a
rank to the places where it stands. A heap hands out the active ranks in ascending order; applying one merges all its
places at once and updates the lists of the pairs on both sides. Ranks whose new symbol could form a pair of a lower
rank (the same string can come from two merges) are applied one place per pre-token at a time, which keeps the order
of a word-by-word encoder. Every pre-token is encoded once per block and remembered, within a bound, by its worker.

Pre-tokens are cut by the library's pattern. Characters that Python's own tables do not know may belong to another
class in the library's; a text with any of them gets its pre-tokens from the library's pre-tokenizer itself.

The vocabulary file's path is a parameter, opened on the executors. Special tokens written out in a text are their
ids, as the public library does by default. Whole texts are encoded; a null or empty text has no ids; repeated rows are
encoded alike; of pairs with equal ranks (places of one pair) the leftmost is merged first; an empty table gives no rows;
extra columns are left out, and the others are taken by position, so that clashing names do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import parts_of, tidy

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Remembered pre-tokens of one worker, and characters of text that are encoded together.
MEMORY, BLOCK_CHARS = 300_000, 8_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _unassigned_below() -> re.Pattern:
    """A character of the basic plane without a category in Python's Unicode tables (a set of this plane is one table to look up)."""
    ranges, begin = [], None
    for c in range(0x10001):
        if (c < 0x10000 and unicodedata.category(chr(c)) == "Cn") != (begin is not None):
            if begin is None:
                begin = c
            else:
                ranges.append((begin, c - 1))
                begin = None
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]")


_ABOVE = re.compile("[\U00010000-\U0010ffff]")


def has_unassigned(text: str) -> bool:
    return not text.isascii() and (_unassigned_below().search(text) is not None or any(unicodedata.category(c) == "Cn" for c in _ABOVE.findall(text)))


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letter = byte_alphabet()
        back = {c: b for b, c in letter.items()}
        self.of_byte = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pair: list[tuple[int, int]] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.pair.append((vocab[a], vocab[b]))
            self.made.append(vocab[a + b])
        lowest: dict[int, int] = {}
        for rank, (a, b) in enumerate(self.pair):
            lowest.setdefault(a, rank)
            lowest.setdefault(b, rank)
        #: True: all places can be merged at once, as what it makes only has pairs of higher ranks.
        self.at_once = [lowest.get(made, rank + 1) > rank for rank, made in enumerate(self.made)]
        keys = np.array(sorted(self.rank), dtype=np.int64)
        self.keys, self.ranks = keys, np.array([self.rank[k] for k in keys.tolist()], dtype=np.int64)

    def _rank_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, pairs)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pairs, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (a pre-token's bytes)."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        word = np.repeat(np.arange(len(words)), lengths)
        following = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(lengths) - 1
        following[ends[lengths > 0]] = -1
        starts = ends - lengths + 1
        before[starts[lengths > 0]] = -1
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enters the pairs that begin at places into the index."""
            places = places[following[places] >= 0]
            if not len(places):
                return
            ranks = self._rank_of(ids[places] << 32 | ids[following[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heapq.heappush(heap, rank)

        note(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            groups = index.pop(rank)
            places = np.unique(np.concatenate(groups)) if len(groups) > 1 else np.sort(groups[0])
            a, b = self.pair[rank]
            right = following[places]
            good = alive[places] & (ids[places] == a) & (right >= 0) & (ids[right] == b)
            places, right = places[good], right[good]
            if a == b and len(places) > 1:  # in a run of the same symbol every second pair is taken, from the left
                chained = np.r_[False, places[1:] == right[:-1]]
                first = np.flatnonzero(~chained)
                position = np.arange(len(places)) - np.repeat(first, np.diff(np.r_[first, len(places)]))
                keep = position % 2 == 0
                places, right = places[keep], right[keep]
            if not len(places):
                continue
            if not self.at_once[rank]:
                first = np.r_[True, np.diff(word[places]) > 0]
                if not first.all():
                    index[rank] = [places[~first]]
                    heapq.heappush(heap, rank)
                    places, right = places[first], right[first]
            ids[places] = self.made[rank]
            alive[right] = False
            beyond = following[right]
            following[places] = beyond
            before[beyond[beyond >= 0]] = places[beyond >= 0]
            left = before[places]
            note(np.unique(np.concatenate([left[left >= 0], places])))
        kept = ids[alive]
        counts = np.bincount(word[alive], minlength=len(words))
        return [x.tolist() for x in np.split(kept, np.cumsum(counts)[:-1])]


class Encoder:
    """Whole texts to ids, with a memory of pre-tokens."""

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.path, self.library = path, None
        special = sorted(self.bpe.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = {s: (str(i), 1, s.encode()) for s, i in self.bpe.special.items()}

    def _pretokens(self, text: str) -> list[str]:
        if not has_unassigned(text):
            return SPLIT.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
            self.back = {c: b for b, c in byte_alphabet().items()}
        return [bytes(map(self.back.__getitem__, piece)).decode() for piece, _ in self.library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.marks):
            return self._pretokens(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.marks else self._pretokens(part) if part else []
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by commas, decoded text) of each text."""
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        split = [self.pieces(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in known and p not in self.marks})
        of = self.bpe.bytes_of
        for piece, ids in zip(new, self.bpe.encode_words([p.encode() for p in new]), strict=True):
            known[piece] = (",".join(map(str, ids)), len(ids), b"".join(map(of.__getitem__, ids)))
        known.update(self.marks)
        out = []
        for pieces in split:
            got = [known[p] for p in pieces]
            out.append((sum(x[1] for x in got), ",".join([x[0] for x in got]), b"".join([x[2] for x in got]).decode("utf-8", "replace")))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about BLOCK_CHARS characters; a longer text is a run of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in (part for whole in batches for part in parts_of(whole, 1, BLOCK_CHARS)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in blocks(texts):
                rows += [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for n, ids, text in enc.encode(texts[a:b])]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids = [[int(i) for i in joined.split(",")] if joined else [] for a, b in blocks(texts) for _, joined, _ in enc.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; a null list is an empty text."""

    def run(batches):
        import pyarrow as pa

        of = encoder(path).bpe.bytes_of
        for batch in batches:
            texts = [b"".join(of.get(i, b"") for i in ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.select("doc_id").schema[0].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
