"""Operator 1, URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs alone: those that a rule decides, or a given table of labels. As most rules
say block, both labels get the same total weight. Training is
histogram boosting written as DataFrame aggregations: the labelled sample is binned and grouped to distinct binned
vectors, and each level of each tree is one aggregation of gradients by (node, feature, bin), of which at most
nodes x features x bins rows reach the driver. The finished trees are a CASE expression over the scanned rows.

``MAX_LABELLED`` bounds the sample that the trees are fitted on: labelled URLs, each once, are kept where their hash
falls below MAX_LABELLED / n, so about that many stay at most, whatever the size of the table. The suffix statistics count all labelled
rows. Suffixes with 1 / ``HOT`` of them or more, which are HOT at most, are joined by broadcast; the others by a shuffle,
in which none is large.

Defined cases: a null URL, or one without ``://``, has an empty host and path; with no labelled URLs of both kinds
everything that no rule decides is allowed; repeated rows are judged alike; of rules that fit, the longest decides, and
of equally long ones the first by name; a score of the threshold blocks; an empty table gives no rows; extra columns are
kept, and where they have the names of new ones, those get more underscores.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, drop_work, free, unboxed, work_table

#: (verdict, host and path); the longest that fits wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MAX_LABELLED, BINS, TREES, DEPTH, RATE, RIDGE = 20_000, 12, 12, 3, 0.3, 1.0
HOT = 10_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_seen")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def _count(text: Column, chars: str) -> Column:
    """How many of text's characters are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """All features but the suffix statistics."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": _count(path, "/"), "host_labels": _count(host, "."),
        "digit_ratio": _count(url, "0123456789") / n, "digits": _count(path, "0123456789"), "entropy": F.round(entropy, 9), "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0), "hyphens": _count(url, "-"),
    }


def with_features(pages: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """Adds __host, __path (needed before) and __f_<feature>; suffixes as train() returns them."""
    columns = ["__suffix", "__rate", "__seen"]
    hot = suffixes.where("__hot").select(*columns)
    rare = suffixes.where("not __hot").select(F.col("__suffix").alias("__key"), F.col("__rate").alias("__rate2"), F.col("__seen").alias("__seen2"))
    out = pages.withColumn("__suffix", suffix_of(F.col("__host"))).join(F.broadcast(hot), "__suffix", "left")
    rate, seen = F.col("__rate"), F.col("__seen")
    if not rare.isEmpty():
        # rows that are served get keys of their own, which match nothing and are dealt evenly
        key = F.when(seen.isNull(), F.col("__suffix")).otherwise(F.concat(F.lit("\0"), F.xxhash64("__url", F.monotonically_increasing_id()).cast("string")))
        out = out.withColumn("__key", key).join(rare.hint("shuffle_merge"), "__key", "left").drop("__key")
        rate, seen = F.coalesce(rate, "__rate2"), F.coalesce(seen, "__seen2")
    made = lexical(F.col("__url"), F.col("__host"), F.col("__path"))
    made |= {"suffix_rate": F.coalesce(rate, F.lit(prior)), "suffix_seen": F.log1p(F.coalesce(seen, F.lit(0)).cast("double"))}
    return out.withColumns({f"__f_{k}": v.cast("double") for k, v in made.items()})


class Trees:
    """Fitted trees: cuts[f] are ascending thresholds (bin = how many are below the value); trees are lists of nodes."""

    def __init__(self, cuts: list[list[float]], trees: list[dict], bias: float):
        self.cuts, self.trees, self.bias = cuts, trees, bias

    def bin(self, f: int, value: Column) -> Column:
        out = F.lit(len(self.cuts[f]))
        for i in reversed(range(len(self.cuts[f]))):
            out = F.when(value <= self.cuts[f][i], i).otherwise(out)
        return out

    @staticmethod
    def leaf(tree: dict, bins: list[Column], value) -> Column:
        """tree: node -> (feature, bin) or a weight; node n's children are 2n and 2n+1. value(node, tree) makes a leaf."""

        def at(node: int) -> Column:
            split = tree.get(node)
            if not isinstance(split, tuple):
                return value(node, split)
            return F.when(bins[split[0]] <= split[1], at(2 * node)).otherwise(at(2 * node + 1))

        return at(1)

    def margin(self, bins: list[Column]) -> Column:
        total = F.lit(float(self.bias))
        for tree in self.trees:
            total = total + self.leaf(tree, bins, lambda _, weight: F.lit(float(weight or 0.0)))
        return total

    def score(self, values: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.margin([self.bin(f, v) for f, v in enumerate(values)])))


def _gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def grow(binned: DataFrame, cuts: list[list[float]], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """binned: b0..bk, y and w, one row per distinct vector and label."""
    model = Trees(cuts, [], 0.0)
    bins = [F.col(f"b{f}") for f in range(len(cuts))]
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin(bins)))
        g, h = F.col("w") * (F.col("y") - p), F.col("w") * p * (1 - p)
        tree: dict = {}
        open_nodes = [1]
        for level in range(depth):
            node = Trees.leaf(tree, bins, lambda n, _: F.lit(n))
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), b.cast("int").alias("b")) for f, b in enumerate(bins)]))
            rows = binned.select(node.alias("node"), g.alias("g"), h.alias("h"), each.alias("e")).groupBy("node", "e.f", "e.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums = {(r["node"], r["f"], r["b"]): (r["g"], r["h"]) for r in rows}
            following = []
            for n in open_nodes:
                total_g = sum(sums.get((n, 0, b), (0, 0))[0] for b in range(len(cuts[0]) + 1))
                total_h = sum(sums.get((n, 0, b), (0, 0))[1] for b in range(len(cuts[0]) + 1))
                best = (1e-6, None)
                for f in range(len(cuts)):
                    left_g = left_h = 0.0
                    for b in range(len(cuts[f])):
                        dg, dh = sums.get((n, f, b), (0.0, 0.0))
                        left_g, left_h = left_g + dg, left_h + dh
                        if left_h < 1e-3 or total_h - left_h < 1e-3:
                            continue
                        gain = _gain(left_g, left_h) + _gain(total_g - left_g, total_h - left_h) - _gain(total_g, total_h)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, b, left_g, left_h))
                if best[1] is None:
                    tree.setdefault(n, RATE * total_g / (total_h + RIDGE))
                    continue
                f, b, left_g, left_h = best[1]
                tree[n] = (f, b)
                tree[2 * n] = RATE * left_g / (left_h + RIDGE)
                tree[2 * n + 1] = RATE * (total_g - left_g) / (total_h - left_h + RIDGE)
                following += [2 * n, 2 * n + 1]
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(tree)
        if tree.keys() == {1} and abs(tree[1]) < 1e-9:
            break
    return model


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Trees | None, DataFrame, float]:
    """labelled: __url, __host, __path, __y (1: block). The model (None without both labels), the statistics of all suffixes, prior."""
    spark = labelled.sparkSession
    counts = labelled.groupBy(suffix_of(F.col("__host")).alias("__suffix")).agg(F.count(F.lit(1)).alias("__seen"), F.sum("__y").alias("y"))
    counts = work_table(counts, "url-suffixes")
    n, blocked = counts.agg(F.sum("__seen"), F.sum("y")).first()
    empty = spark.createDataFrame([], "__suffix string, __rate double, __seen long, __hot boolean")
    if not n or not blocked or blocked == n:
        return None, empty, 0.5
    prior, heavy, light = 0.5, n / (2 * blocked), n / (2 * (n - blocked))
    block, allow = F.col("y") * heavy, (F.col("__seen") - F.col("y")) * light
    suffixes = counts.select("__suffix", ((block + 4 * prior) / (block + allow + 4)).alias("__rate"), "__seen", (F.col("__seen") * HOT >= n).alias("__hot"))
    below = min(1.0, max_labelled / n)
    unit = F.pmod(F.xxhash64("__url"), F.lit(1 << 20)) / float(1 << 20)
    weighed = labelled.where(unit < below).groupBy("__url", "__host", "__path", "__y").agg(F.count(F.lit(1)).alias("c"))
    sample = work_table(weighed.withColumn("__w", F.col("c") * F.when(F.col("__y") == 1, heavy).otherwise(light)).drop("c"), "url-labelled")
    taken, taken_blocked = sample.agg(F.count(F.lit(1)), F.sum("__y")).first()
    if not taken or not taken_blocked or taken_blocked == taken:
        return None, empty, 0.5
    featured = with_features(sample, suffixes, prior)
    steps = [i / BINS for i in range(1, BINS)]
    cuts = featured.agg(*[F.percentile_approx(f"__f_{k}", steps, 10_000).alias(k) for k in FEATURES]).first()
    cuts = [sorted(set(cuts[k])) for k in FEATURES]
    shape = Trees(cuts, [], 0.0)
    bins = [shape.bin(f, F.col(f"__f_{k}")).cast("int").alias(f"b{f}") for f, k in enumerate(FEATURES)]
    binned = featured.select(*bins, F.col("__y").alias("y"), "__w")
    binned = work_table(binned.groupBy(*[f"b{f}" for f in range(len(cuts))], "y").agg(F.sum("__w").alias("w")), "url-binned")
    model = grow(binned, cuts)
    drop_work(binned)
    return model, suffixes, prior


def _known(pages: DataFrame, url_col: str, rules) -> DataFrame:
    """The columns of pages in their box, with __url, __host, __path, __rule and __says."""
    url = column(url_col)
    host, path = host_and_path(url)
    split = pages.select(F.struct(*map(column, pages.columns)).alias(free(pages, "box")), F.coalesce(url, F.lit("")).alias("__url"), host.alias("__host"), path.alias("__path"))
    rule, says = rule_of(F.col("__host"), F.col("__path"), rules)
    return split.withColumn("__rule", rule).withColumn("__says", says)


def _taught(known: DataFrame) -> DataFrame:
    return known.where("__says is not null").select("__url", "__host", "__path", (F.col("__says") == "block").cast("int").alias("__y"))


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """pages with __host, __path, __rule, __verdict and __score (the trees' chance of block).

    labelled: (url, label) with label 1 for block; by default the URLs that a rule decides.
    """
    known = _known(pages, url_col, rules)
    if labelled is None:
        taught = _taught(known)
    else:
        host, path = host_and_path(F.col("url"))
        taught = labelled.where("label is not null").select(F.coalesce("url", F.lit("")).alias("__url"), host.alias("__host"), path.alias("__path"), F.col("label").cast("int").alias("__y"))
    model, suffixes, prior = train(taught, max_labelled)
    featured = with_features(known, suffixes, prior)
    score = F.lit(0.0) if model is None else model.score([F.col(f"__f_{k}") for k in FEATURES])
    scored = featured.withColumn("__score", score)
    verdict = F.coalesce("__says", F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    return unboxed(scored, pages, __host=F.col("__host"), __path=F.col("__path"), __rule=F.col("__rule"), __verdict=verdict, __score=F.col("__score"))


def held_out_accuracy(pages: DataFrame, rules=RULES, url_col: str = "url", fold: int = 4, threshold: float = 0.5) -> dict[str, float]:
    """The trees alone against the rules' verdicts on every fold-th distinct URL (by crc32) that they were not trained on."""
    taught = _taught(_known(pages, url_col, rules))
    out = F.crc32(F.col("__url").cast("binary")) % fold == 2
    model, suffixes, prior = train(taught.where(~out))
    tested = with_features(taught.where(out), suffixes, prior)
    score = F.lit(0.0) if model is None else model.score([F.col(f"__f_{k}") for k in FEATURES])
    says = (score >= threshold).cast("int")
    r = tested.select("__y", says.alias("s")).groupBy("__y").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s") == F.col("__y")).cast("int")).alias("right")).collect()
    by = {x["__y"]: (x["n"], x["right"]) for x in r}
    return {"blocked": by.get(1, (0, 0))[0], "blocked_right": by.get(1, (0, 0))[1], "allowed": by.get(0, (0, 0))[0], "allowed_right": by.get(0, (0, 0))[1]}
