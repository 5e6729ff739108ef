"""Operator 10, token counts: unigram segmentation by dynamic programming over a trie of pre-tokens.

The pieces of a sentencepiece vocabulary are read with their scores and taken as a unigram model: a pre-token (a
word with the mark of the blank before it) is segmented into the pieces of the highest total score, and of equal ones
into the fewest tokens. The distinct pre-tokens of a block are sorted into a trie, whose nodes are their distinct
prefixes; the forward score and token count of a prefix are computed once, however many pre-tokens share it, level by
level from the scores of its own prefixes, and read off at each pre-token's last node. Characters outside the vocabulary
cost their UTF-8 bytes as tokens at ``UNKNOWN`` below the lowest score.

Defined cases: a null or empty text has no tokens; runs of blanks (what str.split() parts at) count as one and a text
begins as if after a blank; repeated rows get equal counts; very long pre-tokens are handled whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

MARK, UNKNOWN = "▁", 10.0
MEMORY, BLOCK_WORDS = 400_000, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> dict[str, float]:
    """Normal pieces and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        keys: dict[int, tuple[float, str]] = {}
        for piece, score in pieces.items():
            if not piece:
                continue
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            if h in keys:
                raise ValueError("two pieces have one hash")
            keys[h] = (score, piece)
        order = sorted(keys)
        self.keys = np.array(order, dtype=np.uint64)
        self.scores = np.array([keys[h][0] for h in order], dtype=np.float64)
        self.lengths = np.array([len(keys[h][1]) for h in order], dtype=np.int64)
        self.by_length = {n: (self.keys[self.lengths == n], self.scores[self.lengths == n]) for n in set(self.lengths.tolist())}
        self.powers = np.ones(self.longest + 1, dtype=np.uint64)
        for i in range(1, self.longest + 1):
            self.powers[i] = np.uint64(int(self.powers[i - 1]) * int(_BASE) % (1 << 64))
        self.known: dict[str, int] = {}

    def trie(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """words sorted: for each depth the nodes' parents and characters, and each word's last node at its depth."""
        parents, letters = [], []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        joined = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        last = np.zeros(len(words), dtype=np.int64)
        at = np.arange(len(words))
        node = np.zeros(len(words), dtype=np.int64)
        depth = 0
        while len(at):
            c = joined[starts[at] + depth]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
            parents.append(node[new])
            letters.append(c[new])
            node = np.cumsum(new) - 1
            last[at] = node
            depth += 1
            going = lengths[at] > depth
            at, node = at[going], node[going]
        return parents, letters, last

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word; words are distinct and sorted."""
        if not words:
            return []
        parents, letters, last = self.trie(words)
        one = np.zeros(1)
        # what earlier depths need: hash of the prefix, forward score, token count, and how to reach ancestors
        hashes, best, tokens = [one.astype(np.uint64)], [one], [one.astype(np.int64)]
        out = np.zeros(len(words), dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        ends = np.searchsorted(lengths[order], np.arange(len(parents) + 2))
        for depth, (parent, letter) in enumerate(zip(parents, letters, strict=True), 1):
            h = hashes[depth - 1][parent] * _BASE + letter.astype(np.uint64) + np.uint64(1)
            width = np.where(letter < 0x80, 1, np.where(letter < 0x800, 2, np.where(letter < 0x10000, 3, 4)))
            score = best[depth - 1][parent] + self.unknown
            count = tokens[depth - 1][parent] + width
            ancestor = np.arange(len(parent))
            for n in range(1, min(self.longest, depth) + 1):
                ancestor = (parent if n == 1 else parents[depth - n][ancestor]) if depth - n >= 0 else ancestor
                if n not in self.by_length:
                    continue
                keys, scores = self.by_length[n]
                piece = h - hashes[depth - n][ancestor] * self.powers[n]
                where = np.searchsorted(keys, piece)
                where[where == len(keys)] = 0
                hit = np.flatnonzero(keys[where] == piece)
                if not len(hit):
                    continue
                s = best[depth - n][ancestor[hit]] + scores[where[hit]]
                c = tokens[depth - n][ancestor[hit]] + 1
                better = (s > score[hit]) | ((s == score[hit]) & (c < count[hit]))
                score[hit[better]], count[hit[better]] = s[better], c[better]
            hashes.append(h)
            best.append(score)
            tokens.append(count)
            if depth > self.longest:
                hashes[depth - self.longest - 1] = best[depth - self.longest - 1] = tokens[depth - self.longest - 1] = one
            here = order[ends[depth] : ends[depth + 1]]
            out[here] = count[last[here]]
        return out.tolist()

    def count_texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [(t or "").split() for t in texts]
        got = [list(map(self.known.get, words)) for words in split]
        new = sorted({w for words, g in zip(split, got, strict=True) for w, x in zip(words, g, strict=True) if x is None})
        for i in range(0, len(new), BLOCK_WORDS):
            part = new[i : i + BLOCK_WORDS]
            self.known.update(zip(part, self.counts([MARK + w for w in part]), strict=True))
        return [(len(words), sum(map(self.known.__getitem__, words)) if None in g else sum(g)) for words, g in zip(split, got, strict=True)]


_counters: dict[str, TrieCounter] = {}


def counter(path: str | None) -> TrieCounter:
    path = path or default_path()
    if path not in _counters:
        _counters[path] = TrieCounter(read_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row's whole text."""

    def run(batches):
        import pyarrow as pa

        count = counter(path)
        for batch in batches:
            rows = [x for at in range(0, batch.num_rows, 2000) for x in count.count_texts(batch.column(1).slice(at, 2000).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
