"""Quality by importance resampling: two hashed n-gram models, and Gumbel top-k on their ratio.

The target model counts hashed words and word pairs of labelled good documents, the raw model those
of all documents. A document's weight is the mean logarithm of the ratio of the models over its
n-grams. Gumbel noise on tempered weights and a top-k draw a sample without
replacement with probabilities in proportion to the weights. k is the number of documents whose
weight reaches the cut that separates labelled good from labelled bad documents best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import bounded_sample, ship, stored

BUCKETS = 1 << 16
#: N-grams that each bucket's ratio is taken to have as expected, besides those counted.
DOUBT = 5.0
#: Neutral n-grams that each text is taken to have besides its own: short texts tell little.
FEW = 20
#: Runs of letters and digits, or of other signs; bytes over 127 count as letters.
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")


class _Hashes(dict):
    """Hashes of the tokens seen last, at most 300,000."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[token] = xxhash.xxh32_intdigest(token)
        return found


_HASHES = _Hashes()


def buckets_of(text: bytes) -> np.ndarray:
    """Buckets of all words and neighbouring pairs of a text."""
    tokens = TOKEN.findall(text)
    words = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return (np.concatenate([words, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per bucket over a task's texts: all of them, and those of labelled good ones."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for cell, quality in zip(batch.column(0), batch.column(1)):
            counts = buckets_of(cell.as_py() or b"")
            np.add.at(raw, counts, 1) if len(counts) < 1000 else np.add(raw, np.bincount(counts, minlength=BUCKETS), out=raw)
            if quality.as_py() == 1:
                target += np.bincount(counts, minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labelled: DataFrame, text: str = "text") -> np.ndarray:
    """Logarithm of target share over raw share for each bucket; zero everywhere if nothing good is labelled."""
    rows = docs.join(F.broadcast(labelled), "doc_id", "left").select(F.col(text).cast("binary"), "quality")
    counts = rows.mapInArrow(_counted, "bucket bigint, raw bigint, target bigint")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found:  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + DOUBT) / (expected + DOUBT))  # rare buckets tell little


def weighted(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, text: str = "text", carried: Sequence[str] = ("*",)
) -> DataFrame:
    """`doc` (the carried columns, packed), `weight` and `quality`: the label of labelled documents that the target model has not seen.

    `sample` bounds the labelled documents used, chosen at random; by a hash of its id every second one
    trains the target model and the others tell where to cut. A null text is empty; a text without tokens has
    weight zero. Of several labels of a document the lowest holds.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = bounded_sample(known, sample)
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(2)) == 0
    labelled = stored(labelled.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), held.alias("held")), "labelled")
    narrow = docs.select("doc_id", F.col(text).alias("text"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(narrow, labelled.where("NOT held").drop("held")))

    @F.pandas_udf("double")
    def weight(texts):
        import pandas as pd

        table = ratios.value
        return pd.Series([table[b].sum() / (len(b) + FEW) for b in (buckets_of(t or b"") for t in texts)])

    rows = docs.select(F.struct(*carried).alias("doc"), F.col("doc_id").alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = rows.join(F.broadcast(labelled.where("held").withColumnRenamed("doc_id", "_id")), "_id", "left")
    return rows.select("doc", weight("_text").alias("weight"), "quality")


def best_cut(good: np.ndarray, bad: np.ndarray, keep: float = 0.995) -> float:
    """The weight from which documents count as good: midway between the weight that a share `keep` of good ones
    reaches and the next bad one below. Without a bad one below there is nothing to reject."""
    least = np.quantile(good, 1 - keep) if len(good) else -np.inf
    below = bad[bad < least]
    return float((least + below.max()) / 2) if len(below) else -np.inf


def threshold(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, by histograms of ever narrower ranges; the driver sees 4096 counts or keys at a time."""
    if k <= 0:
        return float("inf")
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return -float("inf")
    above = 0  # rows over the range
    while True:
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        slot = F.least(F.lit(4095), F.floor((F.col(key) - low) / width))
        bins = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]
        if low == high:
            return low
        if n <= 4096:
            keys = sorted((r[0] for r in rows.where((F.col(key) >= low) & (F.col(key) <= high)).select(key).collect()), reverse=True)
            return keys[k - above - 1]


def resampled(
    docs: DataFrame, labels: DataFrame, temperature: float = 0.002, seed: int = 17, text: str = "text", carried: Sequence[str] = ("*",)
) -> DataFrame:
    """`doc` (the carried columns with doc_id, packed), `weight`, `key` and `kept`: whether the document is in the sample.

    Rows whose keys tie with the k-th all stay, so repeated rows share a fate. Of several documents with one labelled id the
    lowest weight tells where to cut. Without labelled good and bad documents all
    stay. An empty table gives an empty result.
    """
    rows = weighted(docs, labels, text=text, carried=carried)
    chance = (F.shiftrightunsigned(F.xxhash64("doc.doc_id", "weight", F.lit(seed)), 12) + 0.5) / float(1 << 52)
    rows = stored(rows.withColumn("key", F.col("weight") / temperature - F.log(-F.log(chance))), "weights")
    labelled = rows.where("quality IS NOT NULL").groupBy("doc.doc_id").agg(F.min("quality").alias("quality"), F.min("weight").alias("weight"))
    seen = labelled.select("quality", "weight").toPandas()  # a row per labelled id, at most `sample` of `weighted`
    good, bad = (seen["weight"][seen["quality"] == q].to_numpy() for q in (1, 0))
    k = rows.where(F.col("weight") >= best_cut(good, bad)).count()
    return rows.select("doc", "weight", "key", (F.col("key") >= threshold(rows, "key", k)).alias("kept"))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `resampled` keeps, with their columns."""
    return resampled(docs, labels).where("kept").select("doc.*")
