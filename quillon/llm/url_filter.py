"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest. Built-in functions only.

The trees are trained from labelled URLs. Each level of a tree is one aggregation of gradient sums by (node, feature, bin); the driver gets these
histograms, whose size depends on the trees' shape only, and picks the splits. Bins are quantiles of the labelled rows. Trees are scored as CASE
expressions. The labelled rows are a sample by hash of at most about ``MAX_LABELLED`` rows; suffix statistics count every labelled row.

Suffix statistics: for a host's last label and its last two labels, the smoothed share of blocked labelled URLs (a labelled URL's
own label left out). They are joined by suffix; Spark broadcasts them only under its own size threshold.

Defined results: null URLs, and those without ``://``, have an empty host and path, match no rule and are judged by the model; without labels of both kinds the
model says what the labels say, or ``allow`` without any; repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

MAX_LABELLED = 20_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_parameters", "n_dots", "n_hyphens", "has_fragment", "top_rate", "domain_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule's text, its verdict): the longest rule that fits; the first of equally long ones."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features to rows with url, host and path."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    n = F.length(url)
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: count_of(url, c) / n
    count_of = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    labels = F.split(host, r"\.")
    return urls.withColumns(
        {
            "url_length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.when(n > 0, count(url, "0123456789") / n).otherwise(0.0), "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "n_parameters": F.when(url.contains("?"), count(F.regexp_extract(url, r"\?([^#]*)", 1), "&") + 1).otherwise(0).cast("double"),
            "n_dots": count(host, ".").cast("double"), "n_hyphens": count(url, "-").cast("double"), "has_fragment": url.contains("#").cast("double"),
            "top": F.element_at(labels, -1), "domain": F.array_join(F.slice(F.reverse(labels), 1, 2), "."),
        }
    )


def suffix_rates(rows: DataFrame, labelled: DataFrame, prior: float, strength: float = 20.0) -> DataFrame:
    """Adds top_rate and domain_rate. rows: with top, domain, and y (null for rows without a label)."""
    out = rows
    for key, name in (("top", "top_rate"), ("domain", "domain_rate")):
        stats = labelled.groupBy(F.col(key).alias(f"{key}_key")).agg(F.count(F.lit(1)).alias("n_"), F.sum("y").alias("s_"))
        own = F.when(F.col("y").isNotNull(), 1).otherwise(0)
        n, s = F.coalesce("n_", F.lit(0)) - own, F.coalesce("s_", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
        out = out.join(stats, F.col(key) == F.col(f"{key}_key"), "left").withColumn(name, (s + prior * strength) / (n + strength)).drop("n_", "s_", f"{key}_key")
    return out


@dataclass
class Node:
    feature: int = -1
    threshold: float = 0.0
    value: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def column(self, leaf) -> Column:
        if self.below is None or self.above is None:
            return leaf(self)
        return F.when(F.col(FEATURES[self.feature]) <= self.threshold, self.below.column(leaf)).otherwise(self.above.column(leaf))


@dataclass
class Boosted:
    """Gradient-boosted trees with logistic loss; ``margin`` is a Column over the features."""

    base: float
    trees: list[Node]

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + tree.column(lambda n: F.lit(n.value))
        return out


def train(rows: DataFrame, n_trees: int = 10, depth: int = 3, bins: int = 32, rate: float = 0.4, ridge: float = 1.0, least_gain: float = 1e-3) -> Boosted:
    """rows: the features and y (0.0 or 1.0)."""
    quantiles = [k / bins for k in range(1, bins)]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), *[F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES]).first()
    n, s = first["n"], first["s"] or 0.0
    rate_ = min(max((s + 0.5) / (n + 1), 1e-3), 1 - 1e-3) if n else 1e-3
    model = Boosted(math.log(rate_ / (1 - rate_)), [])
    if not n or s in (0.0, float(n)):
        return model
    edges = [sorted(set(first[f] or [])) for f in FEATURES]
    # a value's bin is the number of edges below it, so "bin <= k" is "value <= edges[k]"
    below = lambda f: lambda e: e < F.col(f)
    bin_of = [F.size(F.filter(F.array(*[F.lit(float(e)) for e in es]), below(f))) if es else F.lit(0) for f, es in zip(FEATURES, edges, strict=True)]
    rows = common.written(rows.select("y", *FEATURES, *[b.alias(f"b{k}") for k, b in enumerate(bin_of)]), "url-train")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(FEATURES))])).alias("cell")
    for _ in range(n_trees):
        p = 1 / (1 + F.exp(-model.margin()))
        root = Node()
        level = [root]
        for _ in range(depth):
            ids = {id(x): k for k, x in enumerate(level)}
            place = root.column(lambda x, ids=ids: F.lit(ids.get(id(x), -1)))
            graded = rows.select(place.alias("node"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), *[f"b{k}" for k in range(len(FEATURES))])
            sums = graded.filter("node >= 0").select("node", "g", "h", cells).groupBy("node", "cell.f", "cell.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums.collect():
                found.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            following = []
            for k, node in enumerate(level):
                best = (least_gain, -1, 0, 0.0, 0.0, 0.0, 0.0)
                for f, cells_ in sorted(found.get(k, {}).items()):
                    total_g, total_h = sum(x[0] for x in cells_.values()), sum(x[1] for x in cells_.values())
                    g = h = 0.0
                    for b in sorted(cells_)[:-1]:
                        g, h = g + cells_[b][0], h + cells_[b][1]
                        gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, b, g, h, total_g - g, total_h - h)
                if best[1] < 0:
                    continue
                _, node.feature, b, g, h, g2, h2 = best
                node.threshold = float(edges[node.feature][b])
                node.below, node.above = Node(value=-rate * g / (h + ridge)), Node(value=-rate * g2 / (h2 + ridge))
                following += [node.below, node.above]
            level = following
            if not level:
                break
        if root.below is None:
            break
        model.trees.append(root)
    return model


def judge(urls: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (the model's probability of ``block``).

    labelled: rows (url, label: allow or block); by default the URLs that a rule decides.
    """

    def parts(df: DataFrame, url: Column, *more: Column) -> DataFrame:
        host, path = host_and_path(url)
        return df.select(*more, url.alias("url"), host.alias("host"), path.alias("path"))

    rows = parts(urls, urls[f"`{url_col}`"], urls[f"`{id_col}`"].alias("id"))
    text, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict})
    if labelled is None:
        known = rows.filter("ruled IS NOT NULL").select("url", "host", "path", F.col("ruled").alias("label"))
    else:
        known = parts(labelled, labelled["url"], labelled["label"]).filter("label IN ('allow', 'block')")
    known = lexical(known).withColumn("y", (F.col("label") == "block").cast("double"))
    known = common.written(known.select("url", "y", "top", "domain", *FEATURES[:-2]), "url-labels")
    n, s = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = s / n if n else 0.0
    fraction = min(1.0, max_labelled / n) if n else 1.0
    sample = known.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) <= int(fraction * 1_000_003))
    model = train(suffix_rates(sample, known, prior).select("y", *FEATURES))
    # where the rules give the labels, a page's own label is taken out of its suffixes' rates when the model scores it
    own = (F.col("ruled") == "block").cast("double") if labelled is None else F.lit(None).cast("double")
    scored = suffix_rates(lexical(rows).withColumn("y", own), known, prior)
    probability = 1 / (1 + F.exp(-model.margin()))
    scored = scored.withColumn("score", probability)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE_SQL: dict[str, str] = {}
