r"""Operator 7, PII: pattern spans, and terms that give protected entities away.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern. The method is
information-theoretic sanitisation: every found entity is protected, and a term near it (``WINDOW`` words on either
side, as far as the next entity of its kind) *discloses* it by PMI(entity; term) / IC(entity), with probabilities that
are shares of all documents: 1 means that who reads the term knows the entity. Terms at or above ``min_disclosure`` are
treated like the entity itself in the documents that hold it. With ``min_support`` different contexts the estimate
counts as it is; with fewer, as for an entity that stands once or twice, PMI's lower bound at 95 % does (log counts have
variance 1 / contexts). An entity's group (an address's domain, a card's issuer, a number's prefix) is protected with it
and rated in the same way over all its members, so that rare members share their evidence. An *opaque* term, ``OPAQUE``
or more letters and digits in one run with both among them, is a key, a token or a number of some account: it bears
more information than any word and names one entity by itself, so it is a term span wherever it stands.

Contexts that are the same count once as support, so that copies of one document prove nothing. Patterns are
possessive forms of those of the contract, with a start test, so that they match the same spans in linear time and
without recursion; places come from prefix sums in blocks, so that a text with many matches costs little more than one
with few. Offsets are code points, end exclusive.

Defined cases: a null text is empty and has no spans; repeated rows get the same spans; a row's identity is (id,
text), null-safe; spans that begin at one place are in the order of the kinds; an empty table gives no rows. Spans of
different kinds may overlap; ``redact`` joins overlapping ones. Extra columns are kept by ``redact``; where they have
the new column's name, that gets more underscores.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, column, free, let, text_hash, unboxed, work_table

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[\p{L}\p{N}]++"
WINDOW, OPAQUE, BLOCK = 8, 20, 256
OPAQUE_TERM = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{{{OPAQUE},}}+"
#: Code points in a block of a text that is cut in many places.
PAGE = 4096
MIN_SUPPORT, MIN_DISCLOSURE = 3, 0.8
#: Standard errors from an estimate to its one-sided lower bound at 95 %.
SURE = 1.645
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.try_to_number(F.substring(back, i, F.lit(1)), F.lit("9")).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 3) | F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


SPAN = "struct<kind:int,start:int,end:int,value:string>"
NEAR = "struct<kind:int,start:int,end:int,value:string,near:array<string>>"


def prefix(values: Column, first: Column, add) -> Column:
    """For each element what add makes of first and all elements before it. In blocks: arrays grow by copying."""
    zero = F.array(first)
    grow = lambda acc, v: F.concat(acc, F.array(add(F.element_at(acc, -1), v)))
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))

    def summed(parts: Column) -> Column:
        offsets = F.aggregate(parts, zero, lambda acc, p: F.concat(acc, F.array(add(F.element_at(acc, -1), F.element_at(p, -1)))))
        return F.flatten(F.zip_with(parts, F.slice(offsets, 1, F.size(parts)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: add(o, x))))

    return F.when(F.size(values) > 0, let(values, lambda xs: let(F.transform(blocks(xs), lambda x: F.aggregate(x, zero, grow)), summed))).otherwise(F.slice(zero, 1, 0))


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: int, near: bool = False) -> Column:
    """All leftmost matches as spans: what stands between them gives their places, and the words near them if asked."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{NEAR if near else SPAN}>")

    def spans(fs: Column, gs: Column) -> Column:
        lengths = F.zip_with(F.slice(gs, 1, F.size(fs)), fs, lambda g, f: F.length(g) + F.length(f))
        words = F.transform(gs, lambda g: F.regexp_extract_all(g, F.lit(WORD), F.lit(0))) if near else F.array(F.lit(0))

        def span(i: Column, ps: Column, ws: Column) -> Column:
            start = F.get(ps, i) + F.length(F.get(gs, i))
            parts = [F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(F.get(fs, i))).alias("end"), F.get(fs, i).alias("value")]
            if near:
                left, right = F.get(ws, i), F.get(ws, i + 1)
                both = F.concat(F.slice(left, F.greatest(F.size(left) - WINDOW + 1, F.lit(1)), WINDOW), F.slice(right, 1, WINDOW))
                parts.append(F.transform(both, lambda w: F.lower(w)).alias("near"))
            return F.struct(*parts)

        return let(prefix(lengths, F.lit(0), lambda a, b: a + b), lambda ps: let(words, lambda ws: F.transform(_numbers(F.size(fs)), lambda i: span(i, ps, ws))))

    return let(found, lambda fs: F.when(F.size(fs) > 0, let(between, lambda gs: spans(fs, gs))).otherwise(none))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column, near: bool = False) -> Column:
    """Spans by start, then kind."""
    text, none = F.coalesce(text, F.lit("")), F.array().cast(f"array<{NEAR if near else SPAN}>")
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        spans = _kept(matches(text, PATTERNS[kind], k, near), kind)
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if NEEDS[kind] else spans)
    return ordered(F.concat(*parts))


def opaque_spans(text: Column) -> Column:
    text, none = F.coalesce(text, F.lit("")), F.array().cast(f"array<{SPAN}>")
    return F.when(F.rlike(text, F.lit(f"[A-Za-z0-9]{{{OPAQUE}}}")), matches(text, OPAQUE_TERM, 4)).otherwise(none)


def ordered(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] == b["start"], a["kind"] - b["kind"]).otherwise(a["start"] - b["start"]))


def span_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _group(s: Column) -> Column:
    """What a span's value shares with its kin; never itself a value of the kind."""
    value, digits = F.lower(s["value"]), _digits(s["value"])
    network = F.concat(F.substring_index(value, ".", 3), F.lit("."))
    number = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 4), F.lit(".."))
    return F.when(s["kind"] == 0, F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(s["kind"] == 1, network).when(s["kind"] == 2, F.concat(F.substring(digits, 1, 6), F.lit(".."))).otherwise(number)


def found_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identity, base spans, opaque terms, and for each base span its entity, its group and the words near it. Written once."""
    text = column(text_col)
    rows = docs.select(column(id_col).alias("id"), text_hash(text).alias("th"), base_spans(text, near=True).alias("near"), opaque_spans(text).alias("opaque"))
    contexts = F.transform("near", lambda s: F.struct(F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])).alias("entity"), F.concat_ws(":", s["kind"].cast("string"), _group(s)).alias("group"), s["near"].alias("near")))
    spans = F.transform("near", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "value"))))
    return work_table(rows.select("id", "th", spans.alias("spans"), "opaque", contexts.alias("contexts")), "pii-found")


def _disclosure(both: str, n_term: str, n_entity: str, n_docs: int, min_support: int) -> Column:
    """PMI(entity; term) / IC(entity); of a pair with fewer than min_support contexts (column support) PMI's lower bound."""
    n, both, term, entity = F.lit(float(n_docs)), *(F.col(c).cast("double") for c in (both, n_term, n_entity))
    unsure = F.when(F.col("support") >= min_support, 0.0).otherwise(SURE / F.sqrt("support"))
    return F.when(entity < n, (F.log(both * n / (term * entity)) - unsure) / F.log(n / entity)).otherwise(0.0)


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, min_disclosure: float = MIN_DISCLOSURE) -> DataFrame:
    """(entity, term, disclosure): the terms that give an entity, or an entity's group, away.

    Probabilities are shares of documents; min_support counts different contexts, in which copies are one. A term is in
    at least the documents where it stands near an entity, which bounds its disclosure from above: only pairs whose
    bound reaches min_disclosure have their term counted in the whole corpus.
    """
    contexts = found.select(F.xxhash64("id", "th").alias("doc"), F.explode("contexts").alias("c")).select("doc", F.explode(F.array("c.entity", "c.group")).alias("entity"), "c.near")
    each = contexts.select("doc", "entity", F.xxhash64("near").alias("ctx"), F.explode(F.array_distinct("near")).alias("term"))
    each = work_table(each, "pii-near")
    n_docs = found.count()
    count = lambda df, *by: df.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    support = count(each.select("entity", "term", "ctx"), "entity", "term").withColumnRenamed("n", "support")
    both = count(each.select("entity", "term", "doc"), "entity", "term").withColumnRenamed("n", "both")
    n_entity = count(each.select("entity", "doc"), "entity").withColumnRenamed("n", "n_entity")
    n_near = count(each.select("term", "doc"), "term").withColumnRenamed("n", "n_near")
    pairs = both.join(support, ["entity", "term"]).join(n_entity, "entity").join(n_near, "term")
    pairs = work_table(pairs.where(_disclosure("both", "n_near", "n_entity", n_docs, min_support) >= min_disclosure), "pii-pairs")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(column(text_col), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    # every term is counted, combined in each task, before the few wanted ones are picked: frequent terms make no rows
    n_term = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    rated = pairs.join(n_term, "term").withColumn("n_term", F.greatest("held", "n_near"))
    return rated.select("entity", "term", _disclosure("both", "n_term", "n_entity", n_docs, min_support).alias("disclosure")).where(F.col("disclosure") >= min_disclosure)


def term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id2, th2, found_terms): the spans of disclosing terms in the documents that hold their entity."""
    held = found.select("id", "th", F.explode(F.array_distinct(F.concat("contexts.entity", "contexts.group"))).alias("entity"))
    flagged = held.join(terms, "entity").groupBy("id", "th").agg(F.collect_set("term").alias("terms"))
    flagged = work_table(flagged, "pii-flagged").withColumnsRenamed({"id": "id2", "th": "th2"})
    keyed = docs.select(column(id_col).alias("id"), text_hash(column(text_col)).alias("th"), F.coalesce(column(text_col), F.lit("")).alias("t"))
    hit = keyed.join(flagged, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).dropDuplicates(["id", "th"])
    # places by a running sum over the document's words: a document is one window, and only flagged ones come here
    found_words, between = F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0)), F.split("t", WORD, -1)
    words = hit.select("id", "th", "terms", F.posexplode(F.arrays_zip(found_words.alias("w"), between.alias("gap"))).alias("at", "e"))
    words = words.select("id", "th", "terms", "at", F.col("e.w").alias("w"), F.length("e.gap").alias("gap"))
    end = F.sum(F.col("gap") + F.coalesce(F.length("w"), F.lit(0))).over(Window.partitionBy("id", "th").orderBy("at"))
    words = words.withColumn("end", end.cast("int")).where(F.array_contains("terms", F.lower("w")))
    span = F.struct(F.lit(4).alias("kind"), (F.col("end") - F.length("w")).alias("start"), F.col("end").alias("end"), F.col("w").alias("value"))
    return words.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_list(span).alias("found_terms"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per document: its id, th (its text's hash), spans (base) and all_spans (with disclosing and opaque terms that no base span covers)."""
    found = found_table(docs, id_col, text_col)
    extra = term_spans(docs, found, disclosing_terms(docs, found, text_col, **thresholds), id_col, text_col)
    joined = found.join(extra, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    return joined.select(F.col("id").alias(id_col), "th", "spans", all_spans(F.col("spans"), F.col("opaque"), F.col("found_terms")).alias("all_spans"))


def all_spans(spans: Column, opaque: Column, terms: Column) -> Column:
    """Base spans, and the terms that overlap none and no earlier term: in order of their starts, the spans before and after tell."""
    none = F.array().cast(f"array<{SPAN}>")
    far = F.lit(2**31 - 1)

    def apart(xs: Column) -> Column:
        base = lambda s: s["kind"] < 4
        ends = prefix(F.transform(xs, lambda s: s["end"]), F.lit(0), F.greatest)
        starts = F.reverse(prefix(F.reverse(F.transform(xs, lambda s: F.when(base(s), s["start"]).otherwise(far))), far, F.least))
        rated = F.arrays_zip(xs.alias("s"), ends.alias("before"), starts.alias("after"))
        good = F.filter(rated, lambda r: base(r["s"]) | (r["before"] <= r["s"]["start"]) & (r["after"] >= r["s"]["end"]))
        return F.transform(good, lambda r: r["s"])

    opaque, terms = F.coalesce(opaque, none), F.coalesce(terms, none)
    return F.when(F.size(opaque) + F.size(terms) > 0, let(ordered(F.concat(spans, opaque, terms)), apart)).otherwise(spans)


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind's label; a span that begins inside the one before is joined to it."""
    label = F.array(*[F.lit(LABELS[k]) for k in KINDS])

    def piece(pages: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text in pages."""
        first, last = F.floor(a / PAGE).cast("int"), F.floor((b - 1) / PAGE).cast("int")
        one = F.substring(F.get(pages, first), a % PAGE + 1, b - a)
        more = F.concat(F.substring(F.get(pages, first), a % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, first + 2, last - first - 1), ""), F.substring(F.get(pages, last), F.lit(1), b - last * PAGE))
        return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(more)

    def cut(pages: Column, xs: Column) -> Column:
        ends = prefix(F.transform(xs, lambda s: s["end"]), F.lit(0), F.greatest)
        parts = lambda before: F.transform(F.arrays_zip(xs.alias("s"), before.alias("at")), lambda r: F.when(r["s"]["start"] < r["at"], F.lit("")).otherwise(F.concat(piece(pages, r["at"], r["s"]["start"]), F.get(label, r["s"]["kind"]))))
        last = F.array_max(F.transform(xs, lambda s: s["end"]))
        return F.concat(let(ends, lambda before: F.array_join(parts(before), "")), piece(pages, last, F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(p))))

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return let(spans, lambda xs: let(pages, lambda ps: cut(ps, xs)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with __redacted: the text with all spans generalised to their labels; null texts stay null."""
    found = find_pii(docs, id_col, text_col, **thresholds).select(F.col(id_col).alias("id2"), F.col("th").alias("th2"), F.col("all_spans").alias("hide")).where(F.size("hide") > 0)
    found = work_table(found.dropDuplicates(["id2", "th2"]), "pii-hide")
    joined = boxed(docs, id_col, text_col).join(found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    text = F.col(free(docs, "box")).getField(text_col)
    return unboxed(joined, docs, __redacted=F.when(F.col("hide").isNull(), text).otherwise(redacted(text, F.col("hide"))))
