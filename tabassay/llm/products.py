"""Exact largest inner products by buckets of like length.

Vectors are put in order of length and cut into parts, longest first; a part is cut into buckets inside its task.
A product is at most the product of both lengths, so with a query's threshold (a score that `k` candidates are known to
reach) every bucket has a local threshold for the cosine: threshold / (length of query * longest of bucket). Above one,
the bucket and all that follow are left out. Where it is high, coordinates are compared first: unit vectors
with that cosine differ little in the query's largest coordinates, so sorted coordinates leave few candidates. Where it is
low, coordinates tell nothing and only the vectors that are long enough are taken. What is left is verified by its product.

The first thresholds come from a bounded number of the longest vectors. They decide how much is left out, never the answer.
Queries grow with the table, so they are cut into blocks as well, and a part meets the blocks that can need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.common import ship, shuffle_partitions, stored

#: Products up to this size are exact in double precision.
EXACT = 2.0**52
LONG = 2**63 - 1


def in_steps(vectors: DataFrame, steps: int = 64) -> DataFrame:
    """vec_id, uid, x (whole numbers, as doubles) and their length; without vectors that hold null or non-finite components."""
    wide = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * steps)
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() answers a long: numbers beyond 2^53 are whole already
    x = F.transform(wide, lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("x"))
    return kept.where("x is not null").select("vec_id", F.monotonically_increasing_id().alias("uid"), "x", length.alias("length"))


def dealt(df: DataFrame, order: Column, size: int, to: str) -> tuple[DataFrame, int]:
    """Add `to`: numbers of groups of about `size` rows, in descending `order`, and their count.

    `order` must have a bounded number of values. Values that are rare share a group; a frequent one is split by `uid`.
    """
    counts = df.groupBy(order.alias("_class")).count().collect()
    groups, at, filled = [], -1, size
    for r in sorted(counts, key=lambda r: -r["_class"]):
        parts = -(-r["count"] // size)
        if parts > 1 or filled + r["count"] > size:
            at, filled = at + 1, 0
        groups.append((r["_class"], at, parts))
        at, filled = at + parts - 1, size if parts > 1 else filled + r["count"]
    table = df.sparkSession.createDataFrame(groups, f"_class {dict(df.select(order.alias('c')).dtypes)['c']}, _first int, _parts int")
    number = F.col("_first") + F.pmod(F.xxhash64("uid"), F.col("_parts").cast("bigint")).cast("int")
    return df.withColumn("_class", order).join(table, "_class").withColumn(to, number).drop("_class", "_first", "_parts"), at + 1


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of one width; what a vector lacks is zero."""
    out = np.zeros((len(column), width))
    for row, x in zip(out, column):
        row[: len(x)] = x
    return out


class Best:
    """The `k` best rows of each query found so far: by score, then id (null last), then place."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, thresholds: np.ndarray, k: int):
        self.ids, self.known, self.k = ids, known, k
        self.thresholds = thresholds.copy()
        self.queries, self.rows, self.scores = np.empty(0, int), np.empty(0, int), np.empty(0)

    def add(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        q, r = np.concatenate([self.queries, queries]), np.concatenate([self.rows, rows])
        s = np.concatenate([self.scores, scores])
        order = np.lexsort((r, self.ids[r], ~self.known[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        full = place == self.k - 1
        self.thresholds[q[full]] = np.maximum(self.thresholds[q[full]], s[full])
        kept = place < self.k
        self.queries, self.rows, self.scores = q[kept], r[kept], s[kept]


def by_coordinates(unit: np.ndarray, order: np.ndarray, query: np.ndarray, cosine: float, focus: int = 3) -> np.ndarray:
    """Rows of a bucket whose unit vectors can reach the cosine, judged by the query's largest coordinates.

    With cosine c, a coordinate v of the other vector lies in q c -+ sqrt((1 - q^2)(1 - c^2)).
    """
    passed = np.zeros(len(unit), np.int8)
    chosen = np.argsort(-np.abs(query))[:focus]
    for f in chosen:
        middle, reach = query[f] * cosine, np.sqrt(max(0.0, (1 - query[f] ** 2) * (1 - cosine**2)))
        # beyond the coordinate itself lies nothing closer: the bound is one-sided where the cosine at that end is still reached
        low = -1.0 if query[f] <= -cosine else middle - reach
        high = 1.0 if query[f] >= cosine else middle + reach
        column = unit[order[:, f], f]
        start, end = np.searchsorted(column, low - 1e-9), np.searchsorted(column, high + 1e-9, side="right")
        passed[order[start:end, f]] += 1
    return np.flatnonzero(passed == len(chosen))


def search(
    x: np.ndarray, lengths: np.ndarray, uids: np.ndarray, q: np.ndarray, sizes: np.ndarray, own: np.ndarray, best: Best,
    bucket: int = 1024, switch: float = 0.7,
) -> int:
    """Hold queries against vectors in order of falling length; returns the number of products that were computed."""
    products = 0
    for start in range(0, len(x), bucket):
        part, size = x[start : start + bucket], lengths[start : start + bucket]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            reach = sizes * size[0] * (1 + 1e-9)
            active = np.flatnonzero(~(best.thresholds > reach))
            local = np.where(reach[active] > 0, best.thresholds[active] / reach[active], 0)
        if not len(active):
            break
        found = []
        high = active[local >= switch]
        if len(high):
            unit = part / np.where(size > 0, size, 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            for i, cosine in zip(high, local[local >= switch]):
                rows = by_coordinates(unit, order, q[i] / sizes[i], min(1.0, float(cosine)))
                products += len(rows)
                found.append((np.full(len(rows), i), rows, part[rows] @ q[i]))
        low = active[~(local >= switch)]
        if len(low):
            with np.errstate(invalid="ignore", over="ignore"):
                needed = np.min(best.thresholds[low] / sizes[low], initial=np.inf, where=sizes[low] > 0) * (1 - 1e-9)
            if (sizes[low] == 0).any():
                needed = -np.inf
            long = int(np.searchsorted(-size, -needed, side="right")) if needed > 0 else len(part)
            scores = q[low] @ part[:long].T
            products += scores.size
            at, rows = np.nonzero(scores >= best.thresholds[low][:, None])
            found.append((low[at], rows, scores[at, rows]))
        queries, rows, scores = map(np.concatenate, zip(*found))
        fine = (scores >= best.thresholds[queries]) & (uids[start + rows] != own[queries])
        best.add(queries[fine], start + rows[fine], scores[fine])
    return products


def search_whole(x: np.ndarray, uids: np.ndarray, q: np.ndarray, own: np.ndarray, best: Best) -> list[tuple[int, int, int]]:
    """The same with numbers of any size: every product in whole numbers, for parts whose products leave double precision."""
    numbers, out = [[int(v) for v in row] for row in x], []
    for i, query in enumerate([[int(v) for v in row] for row in q]):
        scores = [(-sum(a * b for a, b in zip(query, row)), not best.known[r], best.ids[r], r) for r, row in enumerate(numbers) if uids[r] != own[i]]
        out += [(i, r, max(-LONG - 1, min(LONG, -score))) for score, _, _, r in sorted(scores)[: best.k]]
    return out


def _pairs(index: pd.DataFrame, ask: pd.DataFrame, k: int) -> pd.DataFrame:
    """The `k` best rows of `index` for each row of `ask`."""
    index = index.sort_values(["length", "uid"], ascending=[False, True])
    width = max(map(len, [*index["x"], *ask["x"]]), default=0)
    x, q = matrix(index["x"], width), matrix(ask["x"], width)
    known = index["vec_id"].notna().to_numpy()
    ids = index["vec_id"].fillna(0).to_numpy("int64")
    uids, own = index["uid"].to_numpy(), ask["uid"].to_numpy()
    lengths, sizes = index["length"].to_numpy(), ask["length"].to_numpy()
    best = Best(ids, known, ask["threshold"].to_numpy(float), k)
    if lengths.max(initial=0) * sizes.max(initial=0) < EXACT:
        search(x, lengths, uids, q, sizes, own, best)
        at, rows, scores = best.queries, best.rows, best.scores.astype("int64")
    else:
        found = search_whole(x, uids, q, own, best)
        at, rows = (np.array([f[i] for f in found], int) for i in range(2))
        scores = np.array([f[2] for f in found], "int64")
    return pd.DataFrame({
        "asked": own[at], "query_id": ask["vec_id"].to_numpy("int64")[at],
        "vec_id": pd.array(ids[rows], "Int64"), "uid": uids[rows], "score": scores,
    }).assign(vec_id=lambda d: d["vec_id"].mask(~known[rows]))


def largest_products(
    vectors: DataFrame, every: int = 20, k: int = 20, steps: int = 64, seeds: int = 4096, part: int = 65_536, block: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the `k` largest inner products.

    Components become floor(steps * x), so scores are whole numbers; ties go to the smaller vec_id. A query's own row is no
    candidate; other rows with its vec_id are, and each row of a repeated vec_id is a query of its own. Rows without a
    vec_id are candidates (last among ties). Zero vectors and empty ones take part; a shorter vector counts as
    padded with zeros. Vectors that are null or hold null or non-finite components take no part. Scores
    beyond 64 bits become the largest or smallest long. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(in_steps(vectors, steps), "lengths")
    total = rows.count()
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    part = max(1, min(part, max(2048, total // shuffle_partitions(spark)), 1 + (1 << 26) // width))
    # lengths in steps of a 64th of a doubling: at most some 130,000 classes
    step = F.when(F.col("length") > 0, F.floor(F.log2("length") * 64).cast("double")).otherwise(-1e9)
    rows, parts = dealt(rows, step, part, "part")
    rows = stored(rows, "parts")
    first = rows.where("part = 0").orderBy(F.desc("length"), "uid").limit(max(1, min(seeds, (1 << 22) // width)))
    seeded = spark.sparkContext.broadcast(first.select("vec_id", "uid", "x", "length").toPandas())
    reach = np.full(parts, -1.0)
    for r in rows.groupBy("part").agg(F.max("length").alias("longest")).collect():
        reach[r["part"]] = r["longest"]
    reach = np.maximum.accumulate(reach[::-1])[::-1]  # falls, as parts do

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ask in batches:
            found = _pairs(seeded.value, ask.assign(threshold=-np.inf), k)
            last = found.groupby("asked")["score"].agg(["min", "size"]).reindex(ask["uid"])
            known = np.where(last["size"] >= k, last["min"], -np.inf)
            known = np.where(np.abs(known) < EXACT, known, -np.inf)  # doubles no longer tell neighbours apart
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                needed = np.where(known > 0, known / ask["length"].to_numpy() * (1 - 1e-9), -1)
            reached = len(reach) - np.searchsorted(reach[::-1], needed)
            yield ask.assign(threshold=known, last=np.maximum(reached - 1, 0).astype("int32"))

    schema = "vec_id bigint, uid bigint, x array<double>, length double, threshold double, last int"
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "uid", "x", "length")
    asked = stored(asked.mapInPandas(thresholds, schema), "thresholds")
    asked, blocks = dealt(asked, F.col("last"), max(1, min(block, 1 + (1 << 25) // width)), "block")
    needs = asked.groupBy("block").agg(F.max("last").alias("last")).collect()
    served = [(p, sum(r["last"] >= p for r in needs)) for p in range(parts)]  # blocks come in falling order of need
    served = spark.createDataFrame(served, "part int, blocks int").where("blocks > 0")
    left = rows.join(served, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    def held(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        return _pairs(index, ask, k)

    schema = "asked bigint, query_id bigint, vec_id bigint, uid bigint, score bigint"
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(held, schema)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
