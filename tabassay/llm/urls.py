"""URL filters: rules on hosts and paths, and gradient-boosted trees where no rule fits.

The trees learn from URLs that a rule labels: length, depth, shares of digits and signs, entropy, counts
of parameters, and how often the host's endings were blocked.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import bounded_sample, ship

Rule = tuple[str, str]  # verdict, host and path such as `example.net/en/`
RULES: list[Rule] = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of the longest rule that fits and its verdict; of equally long ones a block wins. Null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def endings(host: str) -> list[str]:
    """The host's last label, and its last two."""
    labels = host.split(".")
    return [labels[-1], ".".join(labels[-2:])]


class Features:
    """Numbers that describe a URL; the statistics of endings come from labelled hosts."""

    def __init__(self, hosts: Sequence[str], blocked: Sequence[bool]):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for host, bad in zip(hosts, blocked):
            for ending in endings(host):
                seen[ending][bool(bad)] += 1
        self.odds = {e: math.log((bad + 1) / (good + 1)) for e, (good, bad) in seen.items()}

    def __call__(self, url: str, host: str, path: str) -> list[float]:
        n = max(1, len(url))
        query = url.partition("?")[2]
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
        digits = sum(c.isdigit() for c in url)
        signs = sum(not c.isalnum() for c in url)
        return [
            len(url), len(host), len(path), path.count("/"), host.count("."), digits / n, signs / n, entropy,
            query.count("&") + 1 if query else 0, len(query), "#" in url, host.count("-"), url.startswith("https"),
            max(map(len, path.split("/"))), *(self.odds.get(e, 0.0) for e in endings(host)),
        ]

    def table(self, urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        rows = [self(u or "", h, p) for u, h, p in zip(urls, hosts, paths)]
        return np.array(rows, float) if rows else np.zeros((0, len(self("", "", ""))))


class BoostedTrees:
    """Gradient boosting of shallow trees on binned features, for the log odds of a yes or no."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, shrink: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.shrink = trees, depth, rate, bins, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.start, self.grown = float(np.log(share / (1 - share))), []
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T)], 1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            chance = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            score += self.rate * self._grow(tree, codes, cuts, y - chance, chance * (1 - chance), np.arange(len(y)), self.depth, np.zeros(len(y)))
            self.grown.append(tree)
        return self

    def _grow(self, tree, codes, cuts, slope, bend, rows, depth, out) -> np.ndarray:
        """Append a node: (feature, cut, left, right) or (value,). Fills `out` with the values of `rows`."""
        at = len(tree)
        tree.append((slope[rows].sum() / (bend[rows].sum() + self.shrink),))
        best = (1e-6, 0, 0)
        for f in range(codes.shape[1]) if depth else ():
            g = np.bincount(codes[rows, f], slope[rows], self.bins).cumsum()
            h = np.bincount(codes[rows, f], bend[rows], self.bins).cumsum()
            gain = g**2 / (h + self.shrink) + (g[-1] - g) ** 2 / (h[-1] - h + self.shrink) - g[-1] ** 2 / (h[-1] + self.shrink)
            k = int(gain[: len(cuts[f])].argmax()) if len(cuts[f]) else 0
            if len(cuts[f]) and gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[0] <= 1e-6 or not depth:
            out[rows] = tree[at][0]
            return out
        _, f, k = best
        below = codes[rows, f] <= k
        left = len(tree)
        self._grow(tree, codes, cuts, slope, bend, rows[below], depth - 1, out)
        right = len(tree)
        self._grow(tree, codes, cuts, slope, bend, rows[~below], depth - 1, out)
        tree[at] = (f, cuts[f][k], left, right)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.grown:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                for node in np.unique(at):
                    if len(tree[node]) == 4:
                        f, cut, left, right = tree[node]
                        here = at == node
                        at[here] = np.where(x[here, f] <= cut, left, right)
            total += self.rate * np.array([n[0] for n in tree])[at]
        return total


def trained(labelled: pd.DataFrame) -> tuple[Features, BoostedTrees]:
    """Features and trees from rows with url, host, path and verdict."""
    blocked = (labelled["verdict"] == "block").to_numpy()
    features = Features(labelled["host"].tolist(), blocked.tolist())
    x = features.table(labelled["url"].tolist(), labelled["host"].tolist(), labelled["path"].tolist())
    return features, BoostedTrees().fit(x, blocked.astype(float))


def filtered(pages: DataFrame, rules: Sequence[Rule] = RULES, sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of a block, of the trees) for every row.

    The trees are trained on at most `sample` URLs that a rule fits, chosen at random. A null URL, or one without `://`, has an
    empty host and path and is judged by the trees like any other. If no rule fits any URL, the trees allow. Repeated rows are judged
    alike; an empty table gives an empty result; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "found.*")
    labelled = bounded_sample(rows.where("rule IS NOT NULL"), sample).toPandas()
    model = pages.sparkSession.sparkContext.broadcast(trained(labelled))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, trees = model.value
        for frame in frames:
            score = trees.score(features.table(*(frame[c].tolist() for c in ("url", "host", "path"))))
            frame["score"] = score
            frame["verdict"] = frame["verdict"].where(frame["verdict"].notna(), np.where(score > 0, "block", "allow"))
            yield frame.drop(columns="url")

    schema = "page_id bigint, host string, path string, rule string, verdict string, score double"
    return rows.mapInPandas(judge, schema)
