"""Block and allow decisions on URLs: rules first, gradient-boosted trees for the rest.

Everything here is DataFrame expressions. A URL's host and path are parsed with
string functions; the longest rule that fits decides. URLs that no rule decides get
the verdict of boosted regression trees over lexical features (lengths, depth, digit
ratio, entropy, parameters) and statistics of the host's suffix.

Training: a bounded sample of labelled URLs (``SAMPLE_ROWS``), its features in
quantile bins. Rows alike in all bins are counted once for all, and each level of a
tree is one aggregate: gradient sums by node, feature and bin. Only these histograms,
of fixed size, reach the driver, which picks the splits. A model is a sum of CASE
expressions.
"""

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from watchlake.llm.common import saved

SAMPLE_ROWS = 50_000
SUFFIXES = 1_000
BINS = 16
TREES = 8
DEPTH = 3
RATE = 0.4
PENALTY = 1.0
LEAST_WEIGHT = 1.0
PRIOR_ROWS = 20.0
THRESHOLD = 0.5

# Fixed values: (verdict, host, path), a rule being named by host and path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio",
    "host_digit_ratio", "entropy", "parameters", "suffix_rate", "domain_rate", "domain_rows",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null where none fits."""
    name, verdict = None, None
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        own = (host == rule_host) | host.endswith(f".{rule_host}")
        fits = own & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _count_of(text: Column, signs: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, signs, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's signs, in bits."""
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c))) / n
    signs = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(
        F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c))
    )
    return F.when(n > 0, bits).otherwise(0.0)


def with_lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url`` given ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", "\\.")
    n = F.size(labels)
    ratio = lambda text: F.when(F.char_length(text) > 0, _count_of(text, "0123456789") / F.char_length(text)).otherwise(0.0)
    return urls.withColumns(
        {
            "url_length": F.char_length(url).cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "depth": _count_of(F.col("path"), "/").cast("double"),
            "labels": n.cast("double"),
            "hyphens": _count_of(F.col("host"), "-").cast("double"),
            "digit_ratio": ratio(url).cast("double"),
            "host_digit_ratio": ratio(F.col("host")).cast("double"),
            "entropy": _entropy(url),
            "parameters": _count_of(url, "=").cast("double"),
            "suffix": F.element_at(labels, -1),
            "domain": F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), "."),
        }
    )


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: str
    at: float
    low: "Leaf | Split"
    high: "Leaf | Split"


def _expression(tree: "Leaf | Split") -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(F.col(tree.feature) <= tree.at, _expression(tree.low)).otherwise(_expression(tree.high))


@dataclass
class UrlModel:
    """Boosted trees and the suffix statistics they read (at most ``SUFFIXES`` rows of each kind)."""

    base: float
    trees: list["Leaf | Split"]
    suffixes: DataFrame | None
    domains: DataFrame | None
    prior: float

    def with_probability(self, urls: DataFrame, name: str = "block_probability") -> DataFrame:
        """``urls`` (url, host, path and more) with the probability that a URL is to be blocked."""
        rows = self.with_statistics(with_lexical(urls))
        margin = reduce(lambda a, b: a + b, map(_expression, self.trees), F.lit(self.base))
        return rows.withColumn(name, 1 / (1 + F.exp(-margin)))

    def with_statistics(self, rows: DataFrame) -> DataFrame:
        if self.suffixes is None:
            plain = {"suffix_rate": F.lit(self.prior), "domain_rate": F.lit(self.prior), "domain_rows": F.lit(0.0)}
            return rows.withColumns(plain)
        # Both tables have a limit of rows; see ``_statistics``.
        return (
            rows.join(F.broadcast(self.suffixes.withColumnsRenamed({"key": "suffix", "rate": "suffix_rate"}).drop("rows")), "suffix", "left")
            .join(F.broadcast(self.domains.withColumnsRenamed({"key": "domain", "rate": "domain_rate", "rows": "domain_rows"})), "domain", "left")
            .withColumns(
                {
                    "suffix_rate": F.coalesce("suffix_rate", F.lit(self.prior)),
                    "domain_rate": F.coalesce("domain_rate", F.lit(self.prior)),
                    "domain_rows": F.coalesce("domain_rows", F.lit(0.0)),
                }
            )
        )


def _statistics(rows: DataFrame, key: str, prior: float) -> DataFrame:
    """(key, rate, rows) of the most frequent values; the rate leans to the prior where rows are few."""
    rate = (F.sum("blocked") + PRIOR_ROWS * prior) / (F.count(F.lit(1)) + PRIOR_ROWS)
    counted = rows.groupBy(F.col(key).alias("key")).agg(rate.alias("rate"), F.count(F.lit(1)).cast("double").alias("rows"))
    return counted.orderBy(F.desc("rows"), "key").limit(SUFFIXES)


def _node(tree: "Leaf | Split | None", path: int = 1) -> Column:
    """Which open leaf of a growing tree a row is in; leaves are numbered as in a heap."""
    if not isinstance(tree, Split):
        return F.lit(path)
    return F.when(F.col(tree.feature) <= tree.at, _node(tree.low, 2 * path)).otherwise(_node(tree.high, 2 * path + 1))


def _best_splits(rows: list, cuts: dict[str, list[float]]) -> dict[int, tuple | float]:
    """For each node its best (feature, cut), or the value of a leaf where none helps."""
    nodes: dict[int, dict[str, dict[int, tuple]]] = {}
    for r in rows:
        nodes.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
    out = {}
    for node, features in nodes.items():
        g, h = (sum(v[i] for v in next(iter(features.values())).values()) for i in (0, 1))
        best = (1e-6, None)
        for feature in FEATURES:
            left_g = left_h = 0.0
            for i, cut in enumerate(cuts[feature]):
                add = features.get(feature, {}).get(i, (0.0, 0.0))
                left_g, left_h = left_g + add[0], left_h + add[1]
                if min(left_h, h - left_h) < LEAST_WEIGHT:
                    continue
                gain = left_g**2 / (left_h + PENALTY) + (g - left_g) ** 2 / (h - left_h + PENALTY) - g**2 / (h + PENALTY)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (feature, cut))
        out[node] = (best[1], RATE * g / (h + PENALTY))
    return out


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """A model of (url, blocked 0 or 1); about ``sample_rows`` rows at most, chosen by a hash.

    Without labels, or with one kind only, the model is a constant.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("blocked in (0, 1)")
    share = sample_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = saved(with_lexical(known.select("url", "blocked", host.alias("host"), path.alias("path"))), "url-sample")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    prior = (totals.blocked + 1) / (totals.n + 2)
    model = UrlModel(math.log(prior / (1 - prior)), [], None, None, prior)
    if totals.blocked in (0, totals.n):
        return model
    model.suffixes = saved(_statistics(rows, "suffix", prior), "url-suffixes")
    model.domains = saved(_statistics(rows, "domain", prior), "url-domains")
    rows = model.with_statistics(rows)
    shares = [i / BINS for i in range(1, BINS)]
    quantiles = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    # Cut points stand for the values between them, so a row's bins are all a tree can see.
    binned = {}
    for f in FEATURES:
        level = F.lit(float(len(cuts[f])))
        for i in reversed(range(len(cuts[f]))):
            level = F.when(F.col(f) <= cuts[f][i], F.lit(float(i))).otherwise(level)
        binned[f] = level
    alike = saved(
        rows.withColumns(binned).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("y")).coalesce(1),
        "url-bins",
    ).cache()
    steps = {f: [float(i) for i in range(len(cuts[f]))] for f in FEATURES}
    margin = F.lit(model.base)
    grown = []
    for _ in range(trees):
        tree: Leaf | Split | None = None
        for level in range(depth + 1):
            p = 1 / (1 + F.exp(-margin))
            sums = (
                alike.select(
                    _node(tree).alias("node"), (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"),
                    F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bin")) for f in FEATURES])).alias("at"),
                )
                .groupBy("node", F.col("at.feature").alias("feature"), F.col("at.bin").alias("bin"))
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )
            tree = _grown(tree, 1, _best_splits(sums, steps), level < depth)
        grown.append(tree)
        margin = margin + _expression(tree)
    alike.unpersist()
    model.trees = [_in_values(t, cuts) for t in grown]
    return model


def _grown(tree, path: int, found: dict, split: bool):
    """``tree`` with its open leaves split, or closed with their values."""
    if isinstance(tree, Split):
        return Split(tree.feature, tree.at, _grown(tree.low, 2 * path, found, split), _grown(tree.high, 2 * path + 1, found, split))
    cut, value = found.get(path, (None, 0.0))
    if split and cut:
        return Split(*cut, Leaf(0.0), Leaf(0.0))
    return Leaf(value)


def _in_values(tree, cuts):
    """Cuts by bin number back in the features' own values."""
    if isinstance(tree, Leaf):
        return tree
    return Split(tree.feature, cuts[tree.feature][int(tree.at)], _in_values(tree.low, cuts), _in_values(tree.high, cuts))


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, blocked) of the pages that a rule decides: labelled URLs to learn from."""
    host, path = host_and_path(F.col("url"))
    _, verdict = by_rule(host, path, rules)
    return pages.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("blocked")).where("blocked is not null")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, block_probability.

    ``labelled`` (url, blocked) trains the trees; by default the pages that rules
    decide. The verdict is the rule's, else ``block`` from a probability of 0.5 on.
    A null url, or one without ``://``, has an empty host and path and is judged by
    the trees as an empty one. Rows that repeat come out as often.
    """
    model = train(rule_labels(pages, rules) if labelled is None else labelled)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    judged = model.with_probability(parsed)
    guess = F.when(F.col("block_probability") >= THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "block_probability"
    )
