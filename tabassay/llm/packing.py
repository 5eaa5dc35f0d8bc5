"""Packing of documents into windows: whole pieces by non-negative least squares, the rest by cutting.

A document's tokens give full windows from its start and one rest. The histogram of rests (at
most one count per length) is matched by combinations of two or three lengths that fill a window:
least squares with non-negative repeat counts, rounded so that no length is used more often than it
occurs. Rests that these patterns leave over are laid end to end and cut at window ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabassay.llm.common import numbered, ship, stored
from tabassay.llm.encoding import encoder
from tabassay.llm.ranked import RankedEncoder, agrees

#: The id that ends a document.
END_ID = (1).to_bytes(4, "little")
#: Tokens that one task lays end to end.
RUN = 1 << 22
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def ranked(vocabulary: str) -> RankedEncoder:
    """One encoder per worker process."""
    return RankedEncoder(vocabulary)


@lru_cache(maxsize=2)
def id_type(vocabulary: str) -> str:
    """Two bytes for an id where all fit, else four."""
    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab().values()) < 1 << 16 else "<u4"


def pieces(docs: DataFrame, vocabulary: str, window: int, text: str = "text") -> DataFrame:
    """Full windows and rests of all documents; a rest also has its ids (`rest`, of the type `kind`). A null text is empty.

    Ids come from ranks where these agree with the vocabulary's pairs, else from the exact encoder.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rest binary"
    by_ranks, kind = agrees(vocabulary), id_type(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ranked(vocabulary) if by_ranks else encoder(vocabulary)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, ids in zip(batch.column(0).to_pylist(), code.many(cell.as_py() or "" for cell in batch.column(1))):
                ids += END_ID
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rest = np.frombuffer(part, "<u4").astype(kind).tobytes() if len(part) < 4 * window else None
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), total, rest)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(cut, schema)


def combinations(histogram: dict[int, int], window: int, leaders: int = 64) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window: all pairs, and triples that hold one of the most frequent lengths."""
    present = np.zeros(window + 1, bool)
    present[list(histogram)] = True
    found = [(a, window - a, 0) for a in range(1, window // 2 + 1) if present[a] and present[window - a]]
    for a in sorted(histogram, key=lambda n: (-histogram[n], n))[:leaders]:
        b = np.arange(1, (window - a) // 2 + 1)
        b = b[present[b] & present[window - a - b]]
        found += [tuple(sorted((a, int(x), window - a - int(x)), reverse=True)) for x in b]
    return np.array(sorted(set(found)), int).reshape(-1, 3)


def repeat_counts(histogram: dict[int, int], window: int, rounds: int = 300) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; together they use no length more often than it occurs.

    Multiplicative updates solve the least squares; all terms are non-negative, so counts stay so.
    """
    combos = combinations(histogram, window)
    if not len(combos):
        return []
    have = np.zeros(window + 1)
    have[list(histogram)] = list(histogram.values())
    weight = (combos > 0).astype(float)
    into = lambda x: np.bincount(combos.ravel(), (x[:, None] * weight).ravel(), window + 1)
    back = lambda v: (v[combos] * weight).sum(1)
    wanted = back(have)
    x = wanted / np.maximum(back(into(np.ones(len(combos)))), 1)
    for _ in range(rounds):
        x *= wanted / np.maximum(back(into(x)), 1e-9)
    left, chosen = dict(histogram), []
    for i in np.argsort(-x, kind="stable"):
        parts = tuple(int(n) for n in combos[i] if n)
        count = min(int(np.ceil(x[i])), *(left[n] // parts.count(n) for n in parts))
        if count > 0:
            chosen.append((parts, count))
            for n in parts:
                left[n] -= count
    return chosen


def intervals(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank: which rests of a length go where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, count in chosen:
        offset = 0
        for n in parts:
            first = used.get(n, 0)
            rows.append((n, first, first + count, sequence, offset))
            used[n] = first + count
            offset += n
        sequence += count
    return np.array(sorted(rows), "int64").reshape(-1, 5)


def laid(lengths: list[int], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items laid end to end; the last, short sequence ends as powers of two."""
    total = sum(lengths)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if total % window >> b & 1]
    sequence = offset = 0
    for item, length in enumerate(lengths):
        start = 0
        while start < length:
            part = min(length - start, sizes[sequence] - offset)
            yield item, start, part, sequence, offset
            start, offset = start + part, offset + part
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0


def packed(docs: DataFrame, vocabulary: str, window: int = 2048, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `window` must be a power of two. An empty or null text is a document of the end id alone; repeated rows are
    documents of their own; an empty table gives an empty result; other columns are ignored. The driver
    sees a histogram of at most `window` lengths and the patterns chosen from it.
    """
    spark = docs.sparkSession
    ship(spark)
    every = stored(pieces(docs, vocabulary, window, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rests = every.where(F.col("length") < window)
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    chosen = repeat_counts(histogram, window)
    table = spark.sparkContext.broadcast(intervals(chosen))
    left = sum(n * c for n, c in histogram.items()) - sum(sum(parts) * c for parts, c in chosen)
    runs = max(1, -(-left // RUN))
    kind = id_type(vocabulary)
    schema = "uid bigint, " + PIECES + ", rest binary"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = table.value
        big = 1 << 44
        firsts = rows[:, 0] * big + rows[:, 1]
        for frame in frames:
            key = frame["length"].to_numpy() * big + frame["rank"].to_numpy()
            at = np.searchsorted(firsts, key, "right") - 1
            row = rows[np.maximum(at, 0)] if len(rows) else np.zeros((len(frame), 5), "int64")
            rank = frame["rank"].to_numpy()
            fits = (at >= 0) & (row[:, 0] == frame["length"].to_numpy()) & (rank < row[:, 2])
            frame["sequence_id"] = pd.array(np.where(fits, (row[:, 3] + rank - row[:, 1]) * 4 + 1, 0), "Int64")
            frame["offset"] = pd.array(row[:, 4], "Int64")
            frame.loc[~fits, ["sequence_id", "offset"]] = pd.NA
            frame.loc[fits, "rest"] = None
            yield frame.drop(columns="rank")

    def lay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        ids = [np.frombuffer(b, kind).astype("<u4") for b in frame["rest"]]
        doc, start, total, run = (frame[c].to_list() for c in ("doc_id", "start", "doc_tokens", "run"))
        rows = [
            (doc[i], start[i] + at, n, zlib.crc32(ids[i][at : at + n].tobytes()), total[i], (run[i] << 32 | k) * 4 + 2, offset)
            for i, at, n, k, offset in laid([len(x) for x in ids], window)
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    ranked = numbered(rests, ["length"], "rank").select(
        "uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"), "rest", "rank",
    )
    placed = stored(ranked.mapInPandas(place, schema), "placed")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    full = every.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    over = placed.where("sequence_id IS NULL").withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(runs)))
    return full.unionByName(placed.where("sequence_id IS NOT NULL").select(*columns)).unionByName(over.groupBy("run").applyInPandas(lay, PIECES))
