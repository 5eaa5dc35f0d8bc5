"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation that fits the vectors' signs is learned on a bounded sample. Codes are split into substrings,
each with an index from value to codes. Codes within a Hamming radius agree with the query's up to
radius / substrings bits in at least one substring, so probing all values that close in every
substring finds each of them; what is found is checked on whole codes, then ranked by the
vectors themselves. The radius is learned too: the one that holds the wanted share of the sample's true neighbours.

The query set grows with the table, so both are cut into blocks and every block of queries meets every
block of the index; each such task sees a bounded number of vectors and returns `k` rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.common import bounded_sample, ship, stored

PART = 8  # bits of a substring


class Codes:
    """A learned rotation to signs; vectors are first lifted so that the nearest by angle is the nearest by inner product."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 0):
        self.longest = float(np.sqrt((sample**2).sum(1).max()))
        lifted = self._lifted(sample, True)
        self.mean = lifted.mean(0)
        _, _, axes = np.linalg.svd(lifted - self.mean, full_matrices=False)
        self.axes = axes[:bits].T
        self.bits = max(PART, -(-self.axes.shape[1] // PART) * PART)
        flat = (lifted - self.mean) @ self.axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(flat.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.turn = turn

    def _lifted(self, x: np.ndarray, indexed: bool) -> np.ndarray:
        """One more component: for indexed vectors what is missing to the longest, for queries nothing."""
        size = (x**2).sum(1)
        more = np.sqrt(np.maximum(self.longest**2 - size, 0)) if indexed else np.zeros(len(x))
        return np.concatenate([x, more[:, None]], 1)

    def __call__(self, x: np.ndarray, indexed: bool) -> np.ndarray:
        """Rows of substrings, one byte each."""
        lifted = self._lifted(x, indexed)
        if not indexed:  # a query counts by direction only
            lifted *= self.longest / np.sqrt((x**2).sum(1))[:, None]
        signs = (lifted - self.mean) @ self.axes @ self.turn > 0
        return np.packbits(np.pad(signs, ((0, 0), (0, self.bits - signs.shape[1]))), axis=1, bitorder="little")

    def radius(self, sample: np.ndarray, k: int, share: float, queries: int = 200) -> int:
        """The smallest radius that holds `share` of the sample's true neighbours."""
        asked = sample[:: max(1, len(sample) // queries)]
        scores = asked @ sample.T
        scores[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // queries))] = -np.inf
        near = np.argsort(-scores, 1)[:, : min(k, len(sample) - 1)]
        code, own = self(sample, True), self(asked, False)
        far = np.bitwise_count(code[near] ^ own[:, None]).sum(2, dtype=np.int64)
        return int(np.quantile(far, share, method="higher")) if far.size else self.bits


class Index:
    """Substring indexes over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        reach = radius // len(query)
        found = np.zeros(len(self.codes), bool)
        for part, order, starts in zip(query, self.order, self.starts):
            for value in np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ part) <= reach):
                found[order[starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(1, dtype=np.int64) <= radius]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles), without vectors that are null, zero or empty, or hold null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    )


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97, sample: int = 20_000, block: int = 8192, queries: int = 2048
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the `k` largest inner products found.

    Scores are in double precision; ties go to the smaller vec_id. A query's own row is no candidate; other rows with
    its vec_id are not either. If a block holds fewer than `k` codes within the radius, all its vectors are ranked,
    so every query gets `k` rows if there are as many candidates. Vectors of other lengths than the most frequent
    one take no part. Repeated rows count once per row as candidates and once as a query; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    width, total = (sizes["size"], sizes["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("embedding") == width)
    fit = bounded_sample(rows.select("embedding"), sample).toPandas()["embedding"]
    fitted = np.stack(fit.to_list()) if len(fit) else np.ones((1, width))
    codes = Codes(fitted)
    held = spark.sparkContext.broadcast((codes, codes.radius(fitted, k, recall)))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, -(-total // block))
    groups = max(1, -(-asked.count() // queries))
    cell = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.select(cell(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "embedding")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), cell(groups, 2).alias("part"), "vec_id", "embedding")

    def search(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(index) or not len(ask):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        code, radius = held.value
        index = index.sort_values("vec_id")
        ids, x = index["vec_id"].to_numpy(), np.stack(index["embedding"].to_list())
        wanted, q = ask["vec_id"].to_numpy(), np.stack(ask["embedding"].to_list())
        table, out = Index(code(x, True)), []
        for query, vector, own in zip(wanted, q, code(q, False)):
            near = table.within(own, radius)
            near = near[ids[near] != query]
            if len(near) < k:
                near = np.flatnonzero(ids != query)
            score = (x[near] * vector).sum(1)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), query), ids[near[best]], score[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    keys = ["block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
