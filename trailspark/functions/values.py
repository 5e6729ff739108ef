"""Scalar functions over values and requests (SF1, SF10, SF11, SF17, SF19, SF20, FP18), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import spelling_variants

# Fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")
BYTE_UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12}


def singular(w: Column) -> Column:
    """SF2 with its length bounds."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & w.rlike("(?:ches|shes|xes|zes)$"), cut(2)).when((n > 3) & w.rlike("(?<![sui])s$"), cut(1)).otherwise(w)


def identifier_words(text: Column) -> Column:
    """SF1: the words of identifiers: the whole, its parts between cases, acronyms and underscores, singular, in reading order."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))

    def parts(token: Column) -> Column:
        spaced = F.regexp_replace(token, "(?<![A-Z])([A-Z]+)([A-Z][a-z])", "$1_$2")
        each = F.array_distinct(F.flatten(F.transform(spelling_variants(spaced), lambda v: F.split(F.lower(v), "_"))))
        return F.transform(F.filter(each, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)), singular)

    return F.flatten(F.transform(tokens, parts))


def serialized_chars(text: Column) -> Column:
    """SF10: the length of a string as ASCII-escaped JSON."""
    more = lambda pattern, n: n * F.regexp_count(text, F.lit(pattern))
    return F.length(text) + 2 + more(r'["\\\n\r\t\x08\f]', 1) + more(r"[\x00-\x07\x0b\x0e-\x1f\x7f]", 5) + more(r"[\x{80}-\x{ffff}]", 5) + more(r"[\x{10000}-\x{10ffff}]", 11)


def json_quoted(text: Column) -> Column:
    """A string as ASCII-escaped JSON."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    short = text
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        short = F.replace(short, F.lit(plain), F.lit(mark))

    def escaped(run: Column) -> Column:
        """Of printable characters, which stay, or of one other."""
        n = F.ascii(run).cast("long")  # the code point of the first
        pair = F.concat(unit(F.floor((n - 0x10000) / 0x400) + 0xD800), unit((n - 0x10000) % 0x400 + 0xDC00))
        return F.when((n >= 32) & (n < 127), run).when(n < 0x10000, unit(n)).otherwise(pair)

    runs = F.array_join(F.transform(F.regexp_extract_all(short, F.lit("[ -~]+|[^ -~]"), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(short.rlike("[^ -~]"), runs).otherwise(short), F.lit('"'))


def content_hash(text: Column) -> Column:
    """SF11: of a string value, as canonical JSON."""
    return F.sha2(json_quoted(text), 256)


def request_sha256(state: dict[str, Column], questions: dict[str, Column]) -> Column:
    """SF11: a request's identity, whatever the order of its keys; values are strings."""

    def shown(values: dict[str, Column]) -> Column:
        pairs = [F.concat(json_quoted(F.lit(k)), F.lit(": "), json_quoted(v)) for k, v in sorted(values.items())]
        return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))

    return F.sha2(F.concat(F.lit('{"questions": '), shown(questions), F.lit(', "state": '), shown(state), F.lit("}")), 256)


def git_blob_id(text: Column) -> Column:
    """SF11: the id under which git keeps a text."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")))


def fits(text: Column, question: Column, box: int, body: int) -> Column:
    """FP18: state and longest question within the box, and the whole within the request's bytes."""
    size = serialized_chars(text) + serialized_chars(question)
    return (size <= box) & (F.octet_length(text) + F.octet_length(question) <= body)


def day_of(ts: Column) -> Column:
    """SF17: the UTC day, counted from the epoch."""
    return F.floor(F.unix_seconds(ts) / 86_400).cast("int")


def dotted(json: Column, path: str) -> Column:
    """SF19: what lies at a dotted path of a JSON text."""
    return F.get_json_object(json, "$." + path)


def byte_budget(text: Column) -> Column:
    """SF20: bytes of 5GB, 750MB, 1024; null where it is no size."""
    shape = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([KMGT]?B)?\s*$"
    unit = F.create_map(*[F.lit(x) for pair in BYTE_UNITS.items() for x in pair])[F.upper(F.regexp_extract(text, shape, 2))]
    return F.when(text.rlike(shape), (F.regexp_extract(text, shape, 1).cast("double") * unit).cast("long"))
