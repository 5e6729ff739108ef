"""Operator 9, media columns of ISO base media files (MP4, MOV).

``media_columns`` walks a file's nested boxes and decodes its first track's sample tables (sizes, chunks, times, sync
samples) into columns: codec, duration and the byte ranges of keyframes. The payload (mdat) is stepped over, never
decoded. ``text_media`` is the query's form: each text is stored losslessly as uncompressed 8-bit grey frames of
16 x 12 pixels (192 bytes a sample) in such a file, which is then read back through its sample tables.

Defined cases: a null or empty file has no columns and the problem "no moov box"; any malformed file (a box or table
that is cut off, tables that contradict each other or the file's length, boxes nested deeper than ``DEPTH``) gives nulls
and a problem, not a failure, and costs no more memory than a file of its length may; sizes of 0 (to the end) and 64-bit
sizes are followed; of boxes of one kind the first counts; a track without a sync table has keyframes only; fragmented
files, whose samples are in movie fragments, have the problem "fragmented". A null text is empty and is padded to one
sample of blanks; an empty table gives no rows. Every row is handled by itself, so repeated rows get equal values. Extra
columns are left out, and the others are taken by position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import parts_of

WIDTH, HEIGHT, RATE, CHUNK = 16, 12, 25, 64
SAMPLE = WIDTH * HEIGHT
#: Containers may be nested so deep; real files use eight levels.
DEPTH = 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _table(kind: bytes, rows: list[tuple[int, ...]], form: str) -> bytes:
    return _box(kind, struct.pack(">II", 0, len(rows)), b"".join(struct.pack(form, *r) for r in rows))


def write_file(payload: bytes) -> bytes:
    """A file whose only track holds payload (a positive multiple of SAMPLE bytes) as raw grey frames."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    spans = [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1)] + ([(chunks, last, 1)] if last != CHUNK else [])

    def moov(first: int) -> bytes:
        places = [(first + i * CHUNK * SAMPLE,) for i in range(chunks)]
        wide = places[-1][0] >= 1 << 32
        stbl = _box(
            b"stbl",
            _box(b"stsd", struct.pack(">II", 0, 1), entry),
            _table(b"stts", [(n, 1)], ">II"),
            _table(b"stss", [(i * CHUNK + 1,) for i in range(chunks)], ">I"),
            _table(b"stsc", spans, ">III"),
            _box(b"stsz", struct.pack(">III", 0, SAMPLE, n)),
            _table(b"co64", places, ">Q") if wide else _table(b"stco", places, ">I"),
        )
        minf = _box(b"minf", _box(b"vmhd", struct.pack(">IHHHH", 1, 0, 0, 0, 0)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
        mdhd = _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, RATE, n, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"vide"), b"\0"), minf)
        tkhd = _box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(0)) + head
    made = moov(first)
    if len(made) != len(moov(0)):  # the places did not fit 32 bits
        first = len(ftyp) + len(made) + head
        made = moov(first)
    return ftyp + made + _box(b"mdat", payload)


class Malformed(ValueError):
    pass


def walk(data: memoryview, begin: int, end: int):
    """(path, body begin, body end) of every box, in order; payload boxes are stepped over."""
    stack: list[tuple[int, int, tuple[bytes, ...]]] = [(begin, end, ())]
    while stack:
        at, end, path = stack.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("cut off box")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"cut off box {kind!r}")
        yield (*path, kind), at + head, at + size
        stack.append((at + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise Malformed("boxes nested too deep")
            stack.append((at + head, at + size, (*path, kind)))


def _need(begin: int, end: int, size: int, name: str) -> None:
    if end - begin < size:
        raise Malformed(f"short {name}")


def _rows(data: memoryview, span: tuple[int, int], name: str, *kinds: str) -> np.ndarray:
    """A counted table of big-endian numbers, one row per entry."""
    begin, end = span
    _need(begin, end, 8, name)
    n, kind = struct.unpack_from(">I", data, begin + 4)[0], np.dtype([(f"f{i}", k) for i, k in enumerate(kinds)])
    _need(begin, end, 8 + n * kind.itemsize, name)
    table = np.frombuffer(data, dtype=kind, count=n, offset=begin + 8)
    return np.stack([table[f"f{i}"].astype(np.int64) for i in range(len(kinds))], axis=1) if n else np.empty((0, len(kinds)), dtype=np.int64)


def parse(data: bytes) -> dict:
    """codec, timescale, duration, width, height, n_samples, media_bytes, places and sizes of samples (arrays) and keyframes (begin, end)."""
    view = memoryview(data)
    found: dict[bytes, tuple[int, int]] = {}
    track, fragmented = 0, False
    for path, begin, end in walk(view, 0, len(view)):
        fragmented |= path == (b"moof",)
        if path == (b"moov", b"trak"):
            track += 1
        if path[0] == b"moov" and (len(path) < 2 or path[1] != b"trak" or track == 1):
            found.setdefault(path[-1], (begin, end))
    if b"moov" not in found:
        raise Malformed("no moov box")
    if fragmented:
        raise Malformed("fragmented")
    if missing := [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in found]:
        raise Malformed("no " + ", ".join(missing))
    begin, end = found[b"mdhd"]
    _need(begin, end, 20, "mdhd")
    if view[begin] == 1:
        _need(begin, end, 32, "mdhd")
    timescale, duration = struct.unpack_from(">IQ", view, begin + 20) if view[begin] == 1 else struct.unpack_from(">II", view, begin + 12)
    begin, end = found[b"stsd"]
    _need(begin, end, 16, "stsd")
    codec = bytes(view[begin + 12 : begin + 16])
    width, height = struct.unpack_from(">HH", view, begin + 40) if end - begin >= 44 else (0, 0)
    begin, end = found[b"stsz"]
    _need(begin, end, 12, "stsz")
    uniform, n = struct.unpack_from(">II", view, begin + 4)
    if not uniform:
        _need(begin, end, 12 + 4 * n, "stsz")
    elif uniform * n > len(view):
        raise Malformed("samples beyond the end")
    sizes = np.full(n, uniform, dtype=np.int64) if uniform else np.frombuffer(view, dtype=">u4", count=n, offset=begin + 12).astype(np.int64)
    wide = b"co64" in found
    if not wide and b"stco" not in found:
        raise Malformed("no stco")
    chunks = _rows(view, found[b"co64" if wide else b"stco"], "stco", ">u8" if wide else ">u4")[:, 0]
    spans = _rows(view, found[b"stsc"], "stsc", ">u4", ">u4", ">u4")
    first, each = spans[:, 0], spans[:, 1]
    if len(first) and (first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > len(chunks)):
        raise Malformed("chunks out of order")
    per_chunk = np.repeat(each, np.diff(np.append(first, len(chunks) + 1))) if len(first) else np.empty(0, dtype=np.int64)
    if per_chunk.sum() != n:
        raise Malformed("chunks and sizes tell different numbers of samples")
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    until = np.cumsum(sizes) - sizes
    head = np.cumsum(per_chunk) - per_chunk
    places = chunks[: len(per_chunk)][chunk] + until - until[np.minimum(head, n - 1)][chunk] if n else np.empty(0, dtype=np.int64)
    if n and ((places < 0).any() or (places + sizes > len(view)).any()):
        raise Malformed("samples beyond the end")
    times = _rows(view, found[b"stts"], "stts", ">u4", ">u4")
    total = sum(count * delta for count, delta in times.tolist())
    sync = _rows(view, found[b"stss"], "stss", ">u4")[:, 0] if b"stss" in found else np.arange(1, n + 1)
    at = sync[(sync >= 1) & (sync <= n)] - 1
    keys = list(zip(places[at].tolist(), (places + sizes)[at].tolist(), strict=True))
    return {"codec": codec.decode("latin-1").strip(), "timescale": timescale, "duration": min(total or duration, 2**63 - 1), "width": width, "height": height, "n_samples": n, "media_bytes": int(sizes.sum()), "places": places, "sizes": sizes, "keyframes": keys}


def read_back(stored: bytes, info: dict) -> bytes:
    """The samples' bytes; runs of samples that lie end to end are read at once."""
    places, sizes = info["places"], info["sizes"]
    starts = np.flatnonzero(np.r_[True, places[1:] != (places + sizes)[:-1]]) if len(places) else np.empty(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(places)] - 1 if len(starts) else starts
    return b"".join([stored[a:b] for a, b in zip(places[starts].tolist(), (places + sizes)[ends].tolist(), strict=True)])


def feature(info: dict) -> str:
    keys = ";".join(f"{a}-{b}" for a, b in info["keyframes"])
    return f"codec={info['codec']} size={info['width']}x{info['height']} seconds={info['duration']}/{info['timescale']} samples={info['n_samples']} keyframes={keys}"


COLUMNS = "codec string, timescale long, duration long, width int, height int, n_samples long, media_bytes long, keyframes array<struct<begin:long,end:long>>, problem string"


def media_columns(files: DataFrame, id_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """The columns of each file; files may come from spark.read.format("binaryFile")."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ["codec", "timescale", "duration", "width", "height", "n_samples", "media_bytes", "keyframes"]
        for batch in batches:
            rows = []
            for data in batch.column(1):
                try:
                    info = parse(data.as_py() or b"")
                    info["keyframes"] = [{"begin": a, "end": b} for a, b in info["keyframes"]]
                    rows.append([*(info[k] for k in names), None])
                except (Malformed, struct.error) as e:
                    rows.append([None] * len(names) + [str(e) or "cut off"])
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names, "problem"])

    kind = files.select(id_col).schema[0].dataType.simpleString()
    return files.select(id_col, bytes_col).mapInArrow(run, f"id {kind}, {COLUMNS}")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a file, read back through its tables, with digests and the columns as one string."""

    def run(batches):
        import pyarrow as pa

        fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                padded = raw.ljust(max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE), b" ")
                stored = write_file(padded)
                info = parse(stored)
                back = read_back(stored, info)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(info)))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
