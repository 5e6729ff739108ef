"""Operator 2, toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of ``ORDER`` letters, weighed by DECAY per letter that they span in either
string, and is normalised; so it tolerates gaps and inserted characters ("i.d.i.o.t", "idioot"), and endings put to a
known stem. It is applied to units: words in lower case without what is no letter or digit, runs of single letters
read as one word, and windows of longer words. A document is as toxic as its most toxic unit (multiple-instance
learning: its label says that some unit of some sentence is toxic, not which).

Training takes a sample of labelled documents bounded by ``MAX_DOCS`` (by a hash of the id, copies of a text once).
Units that documents labelled 1 hold far oftener are positive instances, a hashed sample of the other units and
those nearest to the positive ones are negative. Landmarks are picked from the positives by mutual distance; the
squared-hinge machine is fitted in the Nystroem space, and its document maxima are mapped to 0..1 by a logistic fit.
Everything but the fit covers all rows: every unit of every whole text is scored.

Defined cases: a null or empty text has no unit and gets the score of "no evidence"; without labels of both kinds
every score is the share of label 1 (0 with no labels); repeated rows get equal scores; ids may be null.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, tidy, work_table

MAX_DOCS, MAX_POSITIVE, MAX_NEGATIVE = 12_000, 600, 40_000
#: A positive unit is in this share of the documents labelled 1 at least: near copies of one document are not enough.
MIN_SHARE = 0.01
HARD_NEGATIVE = 1_000
ORDER, DECAY, LANDMARKS, LONGEST = 3, 0.4, 80, 20
MEMORY, BLOCK = 200_000, 1_000
#: Bytes of text that are scored at once.
PART_BYTES = 2 << 20
_NOT_ALNUM = re.compile(r"[\W_]+")
_SINGLES = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][\s.\-_*]{1,2}){2,}[^\W_](?=\s|$)")


def units_of(word: str) -> list[str]:
    """What is scored of one blank-separated word in lower case."""
    plain = _NOT_ALNUM.sub("", word)
    if len(plain) < 3:
        return []
    if len(plain) <= LONGEST:
        return [plain]
    return [plain[i : i + LONGEST] for i in range(0, len(plain) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return low.split() + [m.group() for m in _SINGLES.finditer(low)]


def _codes(strings: list[str]) -> np.ndarray:
    """Code points, padded with zeros."""
    width = max(map(len, strings))
    return np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le"), dtype=np.uint32).reshape(len(strings), width)


def _raw_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """s: (rows, n) of one length; t: (rows or 1, m, k) padded with zeros. Sums over orders up to ORDER: (rows, m)."""
    rows, n = s.shape
    m, k = t.shape[1:]
    shape = (rows, m)
    before = None
    for order in range(1, ORDER + 1):
        total = np.zeros(shape, dtype=np.float32)
        column = [np.zeros(shape, dtype=np.float32) for _ in range(k + 1)]
        table = []
        for i in range(n):
            fresh = [column[0]]
            for j in range(k):
                same = s[:, i, None] == t[:, :, j]
                reach = (same & (t[:, :, j] > 0)).astype(np.float32) if before is None else same * (before[i - 1][j] if i else 0)
                reach = reach * np.float32(DECAY * DECAY)
                total += reach
                fresh.append(reach + DECAY * (column[j + 1] + fresh[j]) - (DECAY * DECAY) * column[j])
            # before[i][j]: weighted matches of prefixes that end before i + 1 and j
            table.append(fresh)
            column = fresh
        before = table
    return total


def self_kernel(strings: list[str]) -> np.ndarray:
    out = np.empty(len(strings), dtype=np.float32)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for rows in by_length.values():
        for a in range(0, len(rows), BLOCK * 8):
            part = rows[a : a + BLOCK * 8]
            codes = _codes([strings[i] for i in part])
            out[part] = _raw_kernel(codes, codes[:, None, :])[:, 0]
    return out


def letters_of(landmarks: list[str]) -> str:
    return "".join(sorted(set("".join(landmarks))))


def feature_table(landmark: str, letters: str) -> np.ndarray:
    """The landmark's features: the weight of each subsequence of three letters, by (len(letters) + 1) ** 3 cells."""
    base = len(letters) + 1
    table = np.zeros(base**3, dtype=np.float64)
    code = np.array([letters.index(c) + 1 for c in landmark])
    for cell, span in zip(*_cells(code[None], base), strict=True):
        table[cell] += DECAY**span
    return table


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    keep = (i < j) & (j < k)
    return i[keep], j[keep], k[keep]


def _cells(code: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    i, j, k = _triples(code.shape[1])
    return (code[0, i] * base + code[0, j]) * base + code[0, k], k - i + 1


def against(strings: list[str], tables: np.ndarray, letters: str) -> np.ndarray:
    """(strings, tables): inner products of the strings' normalised features with each table; letters that no landmark has weigh nothing."""
    out = np.zeros((len(strings), len(tables)), dtype=np.float32)
    if not strings:
        return out
    base = len(letters) + 1
    tables = np.ascontiguousarray(tables, dtype=np.float32)
    known = np.array([ord(c) for c in letters] + [0xFFFFFFFF], dtype=np.uint32)
    own = np.sqrt(np.maximum(self_kernel(strings), 1e-12))
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for n, rows in by_length.items():
        i, j, k = _triples(n)
        decay = np.float32(DECAY) ** (k - i + 1).astype(np.float32)
        size = max(1, BLOCK * 50 // max(len(i), 1))
        for a in range(0, len(rows), size):
            part = rows[a : a + size]
            codes = _codes([strings[r] for r in part])
            at = np.searchsorted(known, codes)
            cell = np.where(known[at] == codes, at + 1, 0)
            cells = (cell[:, i] * base + cell[:, j]) * base + cell[:, k]
            for t, table in enumerate(tables):
                out[part, t] = table[cells] @ decay
    return out / own[:, None]


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """(strings, landmarks) normalised kernel values."""
    letters = letters_of(landmarks)
    norm = np.sqrt(np.maximum(self_kernel(landmarks), 1e-12)) if landmarks else np.empty(0)
    tables = np.array([feature_table(m, letters) / x for m, x in zip(landmarks, norm, strict=True)]).reshape(len(landmarks), -1)
    return against(strings, tables, letters)


class Model:
    def __init__(self, landmarks: list[str], alpha: np.ndarray, bias: float, slope: float, offset: float):
        self.landmarks, self.alpha, self.bias, self.slope, self.offset = landmarks, alpha, bias, slope, offset
        self.letters = letters_of(landmarks)
        #: The machine's weights are one table: the landmarks' features, each by its coefficient.
        norm = np.sqrt(np.maximum(self_kernel(landmarks), 1e-12)) if landmarks else []
        self.table = sum((feature_table(m, self.letters) * (a / x) for m, a, x in zip(landmarks, alpha, norm, strict=True)), np.zeros(1))
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def units(self, strings: list[str]) -> np.ndarray:
        return against(strings, self.table[None], self.letters)[:, 0] + self.bias

    def margins(self, texts: list[str | None]) -> list[float]:
        """The highest unit margin of each text."""
        if not self.landmarks:
            return [self.bias] * len(texts)
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        units = [units_of(w) for w in new]
        distinct = list({u for us in units for u in us})
        score = dict(zip(distinct, self.units(distinct).tolist(), strict=True)) if distinct else {}
        for word, us in zip(new, units, strict=True):
            known[word] = max([score[u] for u in us], default=self.bias)
        return [max(map(known.__getitem__, words), default=self.bias) for words in split]

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def fit_svm(phi: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge, by Newton steps over the rows inside the margin; y is 1 or -1."""
    x = np.hstack([phi, np.ones((len(phi), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], c[inside]
        after = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, (xi * ci[:, None]).T @ y[inside])
        if np.allclose(after, w, atol=1e-6):
            break
        w = after
    return w[:-1], float(w[-1])


def fit_logistic(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    a, b = 1.0, 0.0
    smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((smooth - p) * z).sum() - 1e-3 * a, (smooth - p).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return a, b


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, all of which may be learned from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return Model([], np.empty(0), 0.0, 1.0, -50.0)
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # about max_docs rows of 12 bytes, whatever the table's size: broadcast
    picked = work_table(known.where(unit < min(1.0, max_docs / n)).withColumnRenamed("doc_id", "id2"), "toxic-labels")
    sample = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("id2")).groupBy(F.xxhash64("text").alias("th")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    sample = work_table(sample, "toxic-sample")

    def units(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: tuple[list, list] = ([], [])
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = list({u for w in set(words_of(text)) for u in units_of(w)})
                    out[0].extend(found)
                    out[1].extend([int(toxic)] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["unit", "toxic"])

    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    positive, negative = int(totals[0] or 0), int(totals[1] - (totals[0] or 0))
    if not positive or not negative:
        share = positive / max(positive + negative, 1)
        return Model([], np.empty(0), 0.0, 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counts = sample.select("text", "toxic").mapInArrow(units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / F.lit(positive + 1.0)) - F.log((F.col("n") + 0.5) / F.lit(negative + 1.0))
    counts = work_table(counts.withColumn("odds", odds), "toxic-units")
    best = counts.where((F.col("p") >= max(3, positive * MIN_SHARE)) & (F.col("odds") > 2)).orderBy(F.desc(F.col("odds") * F.log1p("p")), "unit").limit(MAX_POSITIVE).collect()
    if not best:
        share = positive / (positive + negative)
        return Model([], np.empty(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    others = counts.where("n > 0 and odds < 1")
    below = min(1.0, MAX_NEGATIVE / max(others.count(), 1))
    bad = [r["unit"] for r in best]
    good = [r["unit"] for r in others.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) / float(1 << 20) < below).select("unit").orderBy("unit").collect()]
    among = kernel(bad, bad)
    chosen = [0]
    while len(chosen) < min(LANDMARKS, len(bad)):
        far = among[:, chosen].max(axis=1)
        far[chosen] = 2
        chosen.append(int(far.argmin()))
    marks = [bad[i] for i in chosen]
    values, vectors = np.linalg.eigh(among[np.ix_(chosen, chosen)].astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    k = np.vstack([among[:, chosen], kernel(good, marks)]).astype(np.float64)
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    weight = np.r_[np.array([np.log1p(r["p"]) for r in best]), np.ones(len(good))]
    weight[y > 0] *= 0.1 * max(len(good), 1) / max(weight[y > 0].sum(), 1e-9)
    w, bias = fit_svm(k @ root, y, weight)
    first = Model(marks, root @ w, bias, 1.0, 0.0)

    def rated(batches):
        import pyarrow as pa

        for batch in batches:
            z = first.units(batch.column(0).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(z, dtype=np.float64))], ["unit", "z"])

    # the other units that the first fit takes for positive ones: a second fit learns them
    near = others.select("unit").mapInArrow(rated, "unit string, z double").orderBy(F.desc("z"), "unit").limit(HARD_NEGATIVE).collect()
    seen_before = set(good)
    hard = [r["unit"] for r in near if r["unit"] not in seen_before]
    k = np.vstack([k, kernel(hard, marks).astype(np.float64)])
    w, bias = fit_svm(k @ root, np.r_[y, -np.ones(len(hard))], np.r_[weight, np.ones(len(hard))])
    model = Model(marks, root @ w, bias, 1.0, 0.0)

    def maxima(batches):
        import pyarrow as pa

        for batch in batches:
            z = [m for at in range(0, batch.num_rows, 500) for m in model.margins(batch.column(0).slice(at, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(1)], ["z", "toxic"])

    seen = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(maxima, "z double, toxic int").collect()
    z, toxic = np.array([r["z"] for r in seen]), np.array([float(r["toxic"]) for r in seen])
    order = np.lexsort((toxic, z))
    model.slope, model.offset = fit_logistic(z[order], toxic[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row's whole text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in parts_of(whole, 1, PART_BYTES):
                scores = [model.score(m) for m in model.margins(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
        tidy(model.known.clear)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in parts_of(whole, place, PART_BYTES):
                yield part.filter(pa.array([model.score(m) < threshold for m in model.margins(part.column(place).to_pylist())], pa.bool_()))
        tidy(model.known.clear)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
