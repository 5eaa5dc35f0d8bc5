"""Sharding by longest processing time: groups that stay together, by size, to the least-loaded shard.

Equal texts form a group. A group above a small share of all bytes is scheduled on its own; the
others are first gathered, whole, into a fixed number of bundles by their digest. Large groups and
bundles, sorted by size, then go to the least-loaded shard through a heap. Their number is bounded by
parameters, so the driver schedules as many items whatever the table's size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import numbered, stored


def least_loaded(sizes: dict[object, int], shards: int) -> dict[object, int]:
    """Items by size, the largest first, each to the shard with the fewest bytes so far; ties go to the smaller key and shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for item in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + sizes[item], shard))
    return out


def sharded(docs: DataFrame, shards: int = 8, bundles: int = 16_384, heavy_share: float = 1 / 4096, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard per document, sizes of shards near equal.

    Size is the text's bytes and one. Null texts are grouped and hashed as empty ones, with size 1. Documents of a
    group share a shard; slots count from 0 without gaps in each shard. Repeated rows are documents of
    their own; an empty table gives an empty result; other columns are ignored. A group is scheduled on its own if
    it has more than `heavy_share` of all bytes: at most 1 / `heavy_share` groups can.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = groups.where(F.col("bytes") > total * heavy_share)
    large = {("group", bytes(r["digest"])): r["bytes"] for r in heavy.collect()}
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles))
    alone = [digest for _, digest in large]
    spark = docs.sparkSession
    known = spark.createDataFrame([(digest, True) for digest in alone], "digest binary, heavy boolean")
    marked = rows.join(F.broadcast(known), "digest", "left").withColumn("bundle", F.when(F.col("heavy").isNull(), bundle))
    loads = marked.where("bundle IS NOT NULL").groupBy("bundle").agg(F.sum("size").alias("bytes")).collect()
    items = large | {("bundle", r["bundle"]): r["bytes"] for r in loads}
    where = least_loaded({k: v for k, v in items.items()}, shards) if items else {}
    of_group = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == "group"], "digest binary, group_shard int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == "bundle"], "bundle bigint, bundle_shard int")
    placed = marked.join(F.broadcast(of_group), "digest", "left").join(F.broadcast(of_bundle), "bundle", "left")
    placed = placed.select("uid", "doc_id", "size", "text_crc32", F.coalesce("group_shard", "bundle_shard").alias("shard"))
    return numbered(placed, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
