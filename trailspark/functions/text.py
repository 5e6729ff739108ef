
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = ("the", "and", "for", "from", "that", "this", "with", "was", "are", "not")
#: (kind, pattern) of values that must never leave the corpus.
SECRETS = [("token", r'(?:token|secret|password|key)\s*=\s*"?[0-9A-Za-z_\-]{16,}"?'), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")]
FACTS = [("todo", r"TODO"), ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("ticket", r"[A-Z]{2,}-[0-9]+"), ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")]


def words(text: Column, least: int = 3) -> Column:
    """SF1: lower-case letter runs of at least ``least`` letters without stop words, in reading order, each singular."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.transform(F.filter(found, lambda w: ~w.isin(*STOP)), singular)


def singular(w: Column) -> Column:
    """SF2: ies -> y, ches/shes/xes/zes -> without es, s dropped unless ss, us or is."""
    n = F.length(w)
    return (
        F.when(w.rlike("ies$") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.rlike("(ches|shes|xes|zes)$"), F.substring(w, F.lit(1), n - 2))
        .when(w.rlike("s$") & ~w.rlike("(ss|us|is)$"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def spelling_variants(name: Column) -> Column:
    """SF3: the name, its snake, camel and upper forms and its parts of three letters or more, first come first kept."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    parts = F.filter(F.split(spaced, "_"), lambda p: F.length(p) > 0)
    camel = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.initcap(p))), "")
    snake = F.array_join(parts, "_")
    return F.array_distinct(F.concat(F.array(name, snake, camel, F.upper(snake)), F.filter(parts, lambda p: F.length(p) >= 3)))


def paths_in(text: Column) -> Column:
    """SF5: path tokens: slashes, and no scheme before them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'href="(/[^"#?]*)'), F.lit(1))


def masked(text: Column) -> Column:
    """FP21: every secret value replaced by its kind."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern in SECRETS:
        out = out | text.rlike(pattern)
    return out


def cut_long_line(text: Column, limit: int = 240, mark: str = " [cut]") -> Column:
    """SF12: what is over the limit goes, visibly."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)
