"""Line dedup, BPE, media, packing, PII and token counts against brute force, with the edge cases of their docstrings."""

import hashlib
import os
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter

import pytest

from trailspark.llm import bpe, line_dedup, media, packing, pii, token_counts

SCHEMA = "doc_id long, text string, source string, n int, node string, terms string"
LONG = "Very long line of words and more words. " * 2500
EDGES = [
    (1, "Hello there\nCommon line\n  COMMON LINE \nend", "a", 1, "x", "t"),
    (2, "Common line", "a", 2, "x", "t"),
    (3, None, None, None, None, None),
    (4, "", "b", 1, "x", "t"),
    (None, "common line\nown <|endoftext|> text é ñ 日本", "b", 1, "x", "t"),
    (6, LONG, "b", 1, "x", "t"),
    (6, LONG, "b", 1, "x", "t"),
    (7, "\n\n \t \n", "c", 1, "x", "t"),
    (8, "mail a.b@x.com, b@y.org_x@d.e ip 1.2.3.4.5.6.7.8 and 999.1.1.1 card 4111 1111 1111 1111 phone +1 (415) 555-0000 x", "c", 1, "x", "t"),
    (9, "9" * 6000 + " +" + "1 " * 3000 + "." * 4000 + "a" * 4000, "c", 1, "x", "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, empty):
    got = sorted((str(r["doc_id"]), r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in line_dedup.dedup_lines(docs, min_docs=3).collect())
    held, keys = Counter(), lambda t: [x.strip(" \t\n\x0b\x0c\r").lower() for x in (t or "").split("\n")]
    for r in EDGES:
        held.update({k for k in keys(r[1]) if k})
    want = []
    for r in EDGES:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if held[k] < 3 or not k]
        want.append((str(r[0]), len(lines), len(lines) - len(kept), None if r[1] is None else "\n".join(kept)))
    assert got == sorted(want, key=str)
    assert "Common" not in "".join(x[3] or "" for x in got)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_long_texts_and_clashing_names(spark):
    names = "id th pos line row gone h1 h2 n batch id2 th2 __kept __n_lines".split()
    rows = [(i, "shared\n" + "\n".join(f"own {i} {j}" for j in range(20_000 if i == 0 else 3)), *[str(i)] * len(names)) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert all(got[i]["___kept"] == rows[i][1][7:] and got[i]["__n_dropped"] == 1 and got[i]["id"] == str(i) and got[i]["__kept"] == str(i) for i in range(12))
    assert got[0]["___n_lines"] == 20_001
    often = spark.createDataFrame([(i, "twice here\n" * 9) for i in range(9)], "doc_id long, text string")
    assert {r["__n_dropped"] for r in line_dedup.dedup_lines(often).collect()} == {0}


def test_levels_compact(spark):
    runs = line_dedup.LineRuns(min_docs=5, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(10 * i + j, f"shared\nhot {min(i, 1)}\nown {i} {j}") for j in range(1 if i else 6)], "doc_id long, text string")
        runs.add(line_dedup.line_table(batch))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    # the first batch settles two keys, which later batches do not count again; one more comes only to four
    assert sorted(r["n"] for run in runs.runs() for r in run.collect() if r["n"] > 1) == [3, 6, 6]
    assert runs.frequent().count() == 2
    runs.close()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base(docs, empty):
    from pyspark.sql import functions as F

    found = pii.find_pii(docs).select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["s"]) for r in found) == sorted((str(r[0]), base_spans(r[1])) for r in EDGES)
    assert pii.find_pii(empty).count() == 0
    kept = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert kept[3]["__redacted"] is None and "[EMAIL]" in kept[8]["__redacted"] and "@" not in kept[8]["__redacted"] and kept[2]["__redacted"] == "Common line" and kept[2]["terms"] == "t"


def test_pii_disclosing_terms(spark):
    rows = [(i, f"word{i} contact quixotic77 person mail joe@x.com about thing{i}" if i < 6 else f"plain text number {i} about person") for i in range(60)]
    rows += [(200 + i, "copied note zebra9 ann@x.com") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {(r["entity"], r["term"]) for r in pii.disclosing_terms(d, pii.found_table(d)).collect()}
    assert ("0:joe@x.com", "quixotic77") in terms and not any(t == "about" or e == "0:ann@x.com" for e, t in terms)
    hidden = {r["doc_id"]: r["__redacted"] for r in pii.redact(d).collect()}
    assert hidden[0] == "word0 [TERM] [TERM] person [TERM] [EMAIL] about thing0" and hidden[30] == "plain text number 30 about person" and hidden[200] == "copied note zebra9 [EMAIL]"


def test_pii_rare_entities_have_terms(spark):
    rows = [(i, f"plain text number {i} about person") for i in range(800)]
    rows += [(1000, "person zorblax one 10.1.2.3 about"), (1001, "about two zorblax 10.1.2.3 person")]
    rows += [(1010 + i, "copied qwertle 10.7.7.7 about") for i in range(2)]
    rows += [(1020 + i, f"own{i} acmeworks person {name}@acme.example about") for i, name in enumerate(["ann", "bob", "cy"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = {r["doc_id"]: r["__redacted"] for r in pii.redact(d).collect()}
    assert hidden[1000] == "person [TERM] one [IP] about" and hidden[1001] == "about two [TERM] [IP] person"
    assert hidden[1010] == "copied qwertle [IP] about"
    assert [hidden[1020 + i] for i in range(3)] == [f"own{i} [TERM] person [EMAIL] about" for i in range(3)]


def redacted_by_hand(text, spans):
    out, at = "", 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += text[at:a] + list(pii.LABELS.values())[k]
        at = max(at, b)
    return out + text[at:]


def test_pii_many_matches_long_gaps_and_clashing_names(spark):
    """Linear in a text's matches; overlaps, block borders and wide characters against plain Python."""
    import random
    import time

    draw = random.Random(9)
    many = " ".join(f"é😀 {draw.choice(['x', 'word' * 9])} u{i}@m{i % 7}.example.com 10.0.{i % 256}.{i % 300}" for i in range(4000))
    overlap = "a1@2.3.4.5.6 " * 300 + "é" * 5000 + " b@c.de " + "+1 (415) 555-0000" + "x" * 9000
    names = "id th near opaque contexts box hide id2 th2 __redacted".split()
    rows = [(1, many, *["c"] * len(names)), (2, overlap, *["c"] * len(names)), (3, 'token = "04dbebab91ab85687d33eeaaf9ac" and averylongwordwithoutadigitinside', *["c"] * len(names))]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    began = time.time()
    pii.redact(d).collect()
    took = time.time() - began
    assert took < 60, took
    got = {r["doc_id"]: r for r in pii.redact(d, min_disclosure=2).collect()}
    for i, text in ((1, many), (2, overlap)):
        spans = [(int(a), list(BASE).index(k), int(b)) for k, a, b in (s.split(":") for s in base_spans(text).split(","))]
        assert got[i]["___redacted"] == redacted_by_hand(text, spans) and got[i]["__redacted"] == got[i]["box"] == "c"
    assert got[3]["___redacted"] == 'token = "[TERM]" and averylongwordwithoutadigitinside'


def test_pii_disclosure_by_hand(spark):
    """Every disclosure against counts of documents in plain Python."""
    import math
    import random

    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices("one two three four five six seven".split(), k=12)) + (f" {draw.choice(['zed', 'qux', 'one'])} p{i % 5}@d{i % 2}.example two" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing_terms(d, pii.found_table(d), min_disclosure=0.05).collect()}
    near, docs_of, held = {}, {}, Counter()
    for i, text in rows:
        held.update({w for w in re.findall(r"[^\W_]+", text)})
        for m in re.finditer(BASE["email"], text):
            words = [*re.findall(r"[^\W_]+", text[: m.start()])[-8:], *re.findall(r"[^\W_]+", text[m.end() :])[:8]]
            for e in (f"0:{m[0]}", "0:@" + m[0].split("@")[1]):
                docs_of.setdefault(e, set()).add(i)
                for w in set(words):
                    near.setdefault((e, w), []).append((i, tuple(words)))
    want = {}
    for (e, w), seen in near.items():
        both, n_e = len({i for i, _ in seen}), len(docs_of[e])
        support = len({c for _, c in seen})
        pmi = math.log(both * len(rows) / (held[w] * n_e)) - (0 if support >= pii.MIN_SUPPORT else pii.SURE / math.sqrt(support))
        if (x := pmi / math.log(len(rows) / n_e)) >= 0.05:
            want[e, w] = x
    assert want and got == pytest.approx(want)


def test_bpe(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = sorted((str(r[0]), ",".join(map(str, library.encode(r[1] or "", add_special_tokens=False).ids))) for r in EDGES)
    got = bpe.encode(docs)
    assert sorted((str(r["doc_id"]), ",".join(map(str, r["ids"]))) for r in got.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(got).collect()) == sorted((str(r[0]), r[1] or "") for r in EDGES)
    digests = {(str(r["doc_id"]), r["ids_sha256"]) for r in bpe.encode_digests(docs).collect()}
    assert digests == {(i, hashlib.sha256(x.encode()).hexdigest()) for i, x in want}
    assert bpe.encode_digests(empty).count() == 0


def test_bpe_words():
    import random

    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    draw = random.Random(3)
    texts = ["".join(draw.choices("aaabcdeé ñ \n\t '.,;0123日😀the ing hello", k=draw.randint(0, 150))) for _ in range(500)] + ["a" * 3000, "ab" * 999, " " * 50]
    assert [g[1] for g in own.encode(texts)] == [",".join(map(str, x.ids)) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_characters_of_other_unicode_tables():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    plain = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0x2A6D0, 0x2A710)) + list(range(0x31340, 0x323C0)) + list(range(0xE0000, 0xE0200))
    texts = [f"{c}'s 1{c}1 {c}!a{c} {c}" for c in map(chr, plain)]
    assert all(a[1] == ",".join(map(str, b.ids)) for at in range(0, len(texts), 20_000) for a, b in zip(own.encode(texts[at : at + 20_000]), library.encode_batch(texts[at : at + 20_000], add_special_tokens=False), strict=True))


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    rows = packing.pack(docs).collect()
    ids = {}
    for r in EDGES:
        ids.setdefault(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [1])
    pieces = Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        for at in range(r["start"], r["start"] + r["length"]):
            pieces[r["doc_id"], at] += 1
    copies = Counter(r[0] for r in EDGES)
    assert pieces == {(d, at): copies[d] for d in ids for at in range(len(ids[d]))}
    place = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(place) == list(range(len(place))) and all(place[i] == 2048 for i in range(len(place) - 1))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("targets", [None, {"big": 1, "small": 3}])
def test_packing_mixture(spark, targets):
    """While no queue is dry, each window holds each source's share, within two points."""
    rows = [(i, "word " * (40 + i % 90), "big" if i % 3 else f"tiny{i % 7}" if i % 5 == 0 else "small") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(d, targets=targets).collect()
    source = {r[0]: r[2] for r in rows}
    total = Counter(source[r["doc_id"]] for r in got for _ in range(r["length"]))
    if targets:
        n = sum(total.values())
        share = {"big": 0.25, "small": 0.75} | {s: total[s] / n for s in total if s.startswith("tiny")}
        whole = sum(share.values())
        dry = min(int(total[s] / (share[s] / whole)) // 2048 for s in ("big", "small"))
    else:
        whole, share, dry = sum(total.values()), total, max(r["sequence_id"] for r in got)
    by = Counter()
    for r in got:
        by[r["sequence_id"], source[r["doc_id"]]] += r["length"]
    assert dry > 5 and all(abs(by[w, s] / 2048 - share[s] / whole) <= 0.02 for w in range(1, dry) for s in share if share[s] / whole > 0.02)


def test_packing_edges_of_encoding():
    import random

    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(packing.default_path()), packing.WordIds(packing.default_path())
    draw = random.Random(5)
    texts = ["".join(draw.choices("aaBcdeÉéŐß \n\t\x1c\u00a0\u2003 '.,;0123日😀İK!?", k=draw.randint(0, 80))) for _ in range(1500)] + [" ", "", " a", "a ", None, "it's don't", "<|endoftext|> x<|endoftext|>"]
    ids, lengths = own.encode(pa.array(texts).slice(3))
    ends = lengths.cumsum().tolist()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths.tolist(), strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[3:]]


#: Prints by how many MB a worker grows at most while it encodes a task's 14 MB, and cuts its ids for 128 queues.
GROWTH = """
import random, resource, types
import numpy as np, pyarrow as pa, pyspark
from trailspark.llm import packing
from trailspark.llm.common import tidy

draw = random.Random(0)
words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(200_000)]
texts = [" ".join(draw.choices(words, k=500)) for _ in range(4_300)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["s"] * len(texts))], ["doc_id", "text", "source"])
del texts, words
pyspark.TaskContext.get = staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0))
field = types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "long"))
encode = packing._encoded(types.SimpleNamespace(schema=[field], mapInArrow=lambda run, schema: run), None, 1)
place, _ = packing._placed(packing.Schedule([30_000_000] * 128, [1 / 128] * 128), "long")
for _ in encode([batch.slice(0, 1)]):  # loads the tokenizer
    pass
n = 8_000
tokens = np.random.default_rng(0).integers(200, 2_000, n)
ends = np.random.default_rng(1).integers(2_000, 30_000_000, n)
ids = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([b"\\0" * 4 * int(t) for t in tokens]), pa.array(np.arange(n) % 128), pa.array(ends), pa.array(tokens)], ["doc_id", "ids", "queue", "end", "doc_tokens"])
for name, run, given in ("encode", encode, batch), ("place", place, ids):
    tidy()
    open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
    value = lambda key: int(next(x for x in open("/proc/self/status") if x.startswith(key)).split()[1]) // 1024
    before, rows = value("VmRSS"), 0
    for out in run([given]):
        rows += out.num_rows
    print(name, value("VmHWM") - before, rows)
"""


def test_packing_memory():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "RAYON_NUM_THREADS": "1", "TOKENIZERS_PARALLELISM": "false", "OMP_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", GROWTH], env=env, capture_output=True, text=True, timeout=120)
    got = {x.split()[0]: list(map(int, x.split()[1:])) for x in done.stdout.splitlines()}
    assert got["encode"][1] == 4_300 and got["encode"][0] < 100, done.stdout + done.stderr
    assert got["place"][1] > 8_000 and got["place"][0] < 150, done.stdout + done.stderr


def test_media(docs, empty):
    want = {}
    for r in EDGES:
        raw = (r[1] or "").encode()
        want[str(r[0])] = (len(raw), hashlib.sha256(raw.ljust(max(192, -(-len(raw) // 192) * 192))).hexdigest())
    rows = media.text_media(docs).collect()
    assert {str(r["doc_id"]): (r["n_bytes"], r["payload_sha256"]) for r in rows} == want and len(rows) == len(EDGES)
    assert media.text_media(empty).count() == 0


def test_media_columns(spark):
    whole = media.write_file(bytes(192 * 130))
    files = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:300])), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    rows = {r["id"]: r for r in media.media_columns(files).collect()}
    assert rows["a"]["codec"] == "raw" and rows["a"]["n_samples"] == 130 and rows["a"]["duration"] == 130 and len(rows["a"]["keyframes"]) == 3
    assert rows["a"]["keyframes"][1]["begin"] - rows["a"]["keyframes"][0]["begin"] == 64 * 192
    assert rows["b"]["problem"] and rows["c"]["problem"] == "no moov box" and rows["d"]["codec"] is None


def test_media_malformed_files_are_problems(spark):
    """Every cut and many changed bytes of a file, and tables that contradict the file: a problem or columns, never a failure."""
    import random

    whole = media.write_file(bytes(192 * 3))

    def changed(kind, at, value):
        place = whole.index(kind) + 4 + at
        return whole[:place] + value + whole[place + len(value) :]

    nested = b""
    for _ in range(3000):
        nested = media._box(b"moov", nested)
    bad = [nested, changed(b"stsz", 8, b"\xff\xff\xff\xff"), changed(b"stsc", 8, bytes(4)), changed(b"stsc", 12, b"\xff" * 4), changed(b"stco", 8, b"\xff" * 4), changed(b"stts", 4, b"\xff" * 4), whole[: whole.index(b"mdat") - 4] + media._box(b"moof")]
    for data in bad:
        with pytest.raises(media.Malformed):
            media.parse(data)
    draw = random.Random(8)
    files = [whole[:i] for i in range(0, len(whole), 3)]
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(draw.randint(1, 3)):
            data[draw.randrange(whole.index(b"mdat"))] = draw.choice([0, 1, 255, draw.randrange(256)])
        files.append(bytes(data))
    for data in files:
        try:
            info = media.parse(data)
            assert sum(b - a for a, b in info["keyframes"]) <= info["media_bytes"] * len(info["keyframes"])
        except (media.Malformed, struct.error):
            pass
    rows = media.media_columns(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad + files[:200])], "path int, content binary")).collect()
    assert len(rows) == len(bad) + 200 and all(r["problem"] for r in rows[: len(bad)])


def test_token_counts(docs, empty):
    counter = token_counts.counter(None)
    pieces = token_counts.read_pieces(token_counts.default_path())

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = [(best[i - 1][0] + counter.unknown, -best[i - 1][1] - len(word[i - 1].encode()))]
            options += [(best[j][0] + pieces[word[j:i]], -best[j][1] - 1) for j in range(max(0, i - counter.longest), i) if word[j:i] in pieces]
            score, tokens = max(options)
            best.append((score, -tokens))
        return best[-1][1]

    memo = {w: brute("▁" + w) for r in EDGES for w in (r[1] or "").split()}
    want = sorted((str(r[0]), len((r[1] or "").split()), sum(memo[w] for w in (r[1] or "").split())) for r in EDGES)
    assert sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0
