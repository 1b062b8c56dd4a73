"""URL filter: rules first, then boosted trees over lexical features, all in column expressions.

Trees are grown by Spark: each level takes one grouped histogram of gradients over the labelled rows, of which only
(nodes x features x bins) sums come to the driver; a grown model is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sums are taken over whole numbers, so that their order doesn't matter.
UNIT = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains if the url's path starts with its path."""

    rule: str
    verdict: str

    def fits(self) -> Column:
        host, _, path = self.rule.partition("/")
        return ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to / ? # or end, then the path up to ? # or end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits; null if none does."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        best, verdict = F.when(r.fits(), r.rule).otherwise(best), F.when(r.fits(), r.verdict).otherwise(verdict)
    return df.withColumn("rule", best).withColumn("rule_verdict", verdict)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern))
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise((p := (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n) * F.log(p)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.char_length(url),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": count("[0-9]") / n,
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "host_length": F.char_length(host),
        "host_labels": F.size(F.split(host, r"\.")),
        "host_marks": F.regexp_count(host, F.lit("[0-9-]")),
        "other_marks": count("[^A-Za-z0-9/.:]"),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    }


@dataclass
class Boosted:
    """Trees as nested tuples: (feature, bound, low, high) or a leaf's whole-number value in UNITs."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, columns: dict[str, Column]) -> Column:
        def walk(t) -> Column:
            return F.lit(t).cast("long") if isinstance(t, int) else F.when(columns[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = F.lit(round(self.base * UNIT)).cast("long")
        for t in self.trees:
            total = total + walk(t)
        return total / UNIT

    def score(self, columns: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.margin(columns)))


def fit(train: DataFrame, features: list[str], trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.4, least: float = 5.0) -> Boosted:
    """Logistic boosting on the columns ``features`` and ``y`` (0/1) of a written table.

    Rows are binned once; after each tree a table of their bins, margins and gradients is written. A level takes one grouped histogram over it.
    Trees reach Spark as literal arrays, by which the node of a row is looked up, so the same compiled code serves all trees.
    No rows, or one class only, give a constant model at the smoothed rate.
    """
    n, ones = train.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Boosted(log((ones + 1) / (n - ones + 1)))
    if not ones or ones == n:
        return model
    cuts = train.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in features]).first().asDict()
    cuts = {c: sorted(set(map(float, v or []))) for c, v in cuts.items()}

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.lit(cuts[c]).cast("array<double>"), lambda v: F.col(c) > v)).cast("tinyint")

    def graded(rows: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-F.col("m") / UNIT))
        g, h = F.round((p - F.col("y")) * UNIT).cast("long"), F.round(p * (1 - p) * UNIT).cast("long")
        return written(rows.select("bins", "y", "m", g.alias("g"), h.alias("h")), "url-boosted")

    rows = graded(train.select(F.array(*map(bin_of, features)).alias("bins"), "y", F.lit(round(model.base * UNIT)).cast("long").alias("m")))
    at = lambda values, k: F.element_at(F.lit(values), k)
    for _ in range(trees):
        tree: dict[int, tuple[int, int]] = {}
        values: dict[int, float] = {}

        def node_after(levels: int, tree=tree) -> Column:
            """The node of a row after so many levels. Nodes without a split send all rows to their first child."""
            feature, bound = ([tree.get(k, (0, bins))[i] for k in range(1, 1 << depth)] for i in (0, 1))
            node = F.lit(1)
            for _ in range(levels):
                node = 2 * node + (F.element_at("bins", at(feature, node) + 1) > at(bound, node)).cast("int")
            return node

        open_nodes = [1]
        for level in range(depth):
            cells = rows.select(node_after(level).alias("node"), "g", "h", F.posexplode("bins").alias("f", "b")).where(F.array_contains(F.lit(open_nodes), F.col("node")))
            sums: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
            for r in cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault((r["node"], r["f"]), {})[r["b"]] = (r["g"] / UNIT, r["h"] / UNIT)
            next_nodes = []
            for k in open_nodes:
                split = best_split([sums.get((k, f), {}) for f in range(len(features))], [len(cuts[c]) for c in features], least)
                if split:
                    tree[k] = split[:2]
                    values[2 * k], values[2 * k + 1] = split[2:]
                    next_nodes += [2 * k, 2 * k + 1]
            open_nodes = next_nodes
            if not open_nodes:
                break
        if not tree:
            break

        def build(k: int, tree=tree, values=values):
            return (features[tree[k][0]], cuts[features[tree[k][0]]][tree[k][1]], build(2 * k), build(2 * k + 1)) if k in tree else round(rate * values[k] * UNIT)

        model.trees.append(build(1))
        ends = []
        for leaf in range(1 << depth, 2 << depth):
            while leaf not in values and leaf > 1:
                leaf //= 2
            ends.append(round(rate * values.get(leaf, 0.0) * UNIT))
        rows = graded(rows.select("bins", "y", (F.col("m") + at(ends, node_after(depth) - (1 << depth) + 1)).cast("long").alias("m")))
    return model


def best_split(cells: list[dict[int, tuple[float, float]]], bounds: list[int], least: float) -> tuple[int, int, float, float] | None:
    """(feature, bin up to which rows go low, value of the low side, of the high side) of the largest gain; None if there is none."""
    found = None
    for f, (cell, n) in enumerate(zip(cells, bounds, strict=True)):
        g_all, h_all = sum(x[0] for x in cell.values()), sum(x[1] for x in cell.values())
        g = h = 0.0
        for i in range(n):
            g, h = g + cell.get(i, (0, 0))[0], h + cell.get(i, (0, 0))[1]
            if min(h, h_all - h) * 4 < least:
                continue
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            if gain > 1e-6 and (found is None or gain > found[0] + 1e-9):
                found = (gain, f, i, -g / (h + 1), -(g_all - g) / (h_all - h + 1))
    return found[1:] if found else None


def judge_urls(pages: DataFrame, rules: list[Rule], sample_rows: int = 200_000, id_col: str = "page_id", url_col: str = "url", prior: float = 20.0, most: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, verdict and block_score (the trees' probability, also where a rule decides).

    Labelled urls are those that a rule fits. Suffix statistics are the smoothed share of blocked among all
    labelled rows of the host's last two labels, and of its last label, without the row itself; the trees are
    fitted on at most about ``sample_rows`` labelled rows, drawn by a hash of the url. Null urls have empty host and
    path, no rule, and are scored like an empty url. Hosts that hold a third of the rows meet in joins that
    Spark splits. Other columns are not read.
    """
    url = F.coalesce(F.col("raw"), F.lit(""))
    host, path = host_and_path(F.col("raw"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("raw")).select("id", url.alias("url"), host.alias("host"), path.alias("path"))
    rows = with_rule(rows, rules)
    suffix = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    top = F.regexp_extract("host", r"[^.]*$", 0)
    rows = rows.select("*", suffix.alias("suffix"), top.alias("top"), (F.col("rule_verdict") == "block").cast("int").alias("y"))
    stats = rows.where("y is not null").groupBy("suffix", "top").agg(F.count("y").alias("n"), F.sum("y").alias("k"))
    stats = written(stats, "suffixes")
    tops = stats.groupBy("top").agg(F.sum("n").alias("top_n"), F.sum("k").alias("top_k"))
    overall = stats.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).first()[0]
    rows = rows.join(stats.drop("top"), "suffix", "left").join(tops, "top", "left")
    own = F.coalesce("y", F.lit(0))
    one = F.col("y").isNotNull().cast("int")
    share = lambda k, n: (F.coalesce(F.col(k), F.lit(0)) - own + prior * overall) / (F.coalesce(F.col(n), F.lit(0)) - one + prior)
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_share": share("k", "n"), "top_share": share("top_k", "top_n"), "suffix_seen": F.least(F.coalesce("n", F.lit(0)), F.lit(1000))}
    rows = rows.select("id", "host", "path", "rule", "rule_verdict", "y", F.xxhash64("url").alias("draw"), *[c.cast("double").alias(k) for k, c in features.items()])
    labelled = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keep = min(1.0, sample_rows / max(1, labelled))
    train = written(rows.where("y is not null").where(F.pmod("draw", F.lit(1 << 20)) < int(keep * (1 << 20))).select("y", *features), "url-train")
    model = fit(train, list(features))
    score = model.score({c: F.col(c) for c in features})
    rows = rows.withColumn("block_score", score)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > most, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
