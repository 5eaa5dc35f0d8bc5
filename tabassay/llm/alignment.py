"""How the tokens of two tokenizers lie over each other, and which of their ids go together in a corpus.

Both encode the same text, so their tokens are two cuts of the same bytes. Per batch of documents, an as-of merge keyed by
document finds for each token's start the token of the other side that covers it; both directions together give all overlaps. Where
a token starts with the token that covers its start, both sides have a common end just before: these ends cut the tokens into groups.
All pairs of tokens of a group are links.

How many documents hold a pair linked is counted over the corpus: tasks put out each pair once per chunk of documents, with
its number of documents, and get each chunk's pairs back with their counts. So a pair that is in every document
is moved once a chunk, and no table of pairs is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabassay.llm.bpe import SETTLED, byte_letters
from tabassay.llm.common import ship, stored

#: Fixed value of the format: how the byte-level vocabulary splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Long runs are left to the library, whose time does not grow with the square of a run.
RUN = re.compile(r"\S{500}|\s{500}")
#: A group with more pairs than this is taken by its distinct ids.
MANY = 4096
#: Bits for an id of the second side within a pair's key.
SHIFT = 32


class ByteSide:
    """Ids of a byte-level vocabulary, as its library gives them without special tokens; from ranks where both agree for sure."""

    def __init__(self, library: str, ranks: str):
        self.library = Tokenizer.from_file(library)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        byte = {letter: b for b, letter in byte_letters().items()}
        special = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        self.pieces = [b""] * (1 + max(self.library.get_vocab().values()))
        for token, i in self.library.get_vocab().items():
            self.pieces[i] = special[i].encode() if i in special else bytes(byte[c] for c in token)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text, whole."""
        out = []
        for text in texts:
            if (text.isascii() or SETTLED.fullmatch(text)) and not RUN.search(text):
                out.append(self.fast.encode_ordinary(" " + text))
            else:
                out.append(self.library.encode(" " + text, add_special_tokens=False).ids)
        return out


class PieceSide:
    """Ids of a vocabulary of pieces, which puts a space before each text by itself."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        name, single = self.library.id_to_piece, self.library.is_byte
        self.pieces = [bytes([int(name(i)[3:5], 16)]) if single(i) else name(i).replace("▁", " ").encode() for i in range(self.library.get_piece_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Sides:
    """Both tokenizers."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.a, self.b = a, b
        self.sizes = [np.array([len(p) for p in side.pieces], np.int64) for side in (a, b)]

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none for a text that is empty or that a side's tokens do not give back, with a space before it."""
        out = []
        for text, a, b in zip(texts, self.a.ids(texts), self.b.ids(texts)):
            want = (" " + text).encode()
            fine = text and all(b"".join(map(side.pieces.__getitem__, ids)) == want for side, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if fine else ([], []))
        return out


@lru_cache(maxsize=2)
def sides(a: tuple[str, str], b: str) -> Sides:
    """Both tokenizers, once per worker process."""
    return Sides(ByteSide(*a), PieceSide(b))


def _tokens(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """All tokens of a batch: document, id, start and end in bytes; documents lie one after the other."""
    flat = np.frombuffer(array("q", chain.from_iterable(ids)), np.int64)
    ends = np.cumsum(sizes[flat])
    return pd.DataFrame({
        "doc": np.repeat(np.arange(len(ids)), [len(several) for several in ids]),
        "id": flat, "start": ends - sizes[flat], "end": ends, "token": np.arange(len(flat)),
    })


def _covering(tokens: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Each token with the token of the other side that covers its start."""
    other = others[["doc", "start", "token"]].assign(from_=others["start"]).rename(columns={"token": "other"})
    return pd.merge_asof(tokens[["doc", "start", "token"]], other, on="start", by="doc")


def aligned(texts: list[str], both: Sides) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """The tokens of both sides with their groups, and all overlaps (places of a token of A and of one of B).

    A text that is empty or whose tokens do not give back a space and the text has no tokens.
    """
    ids = both.ids(texts)
    left, right = (_tokens([pair[i] for pair in ids], both.sizes[i]) for i in (0, 1))
    covers_a, covers_b = _covering(left, right), _covering(right, left)
    # where both sides have a token that starts, a group starts, and both directions find the same pair
    same_a, same_b = ((c["from_"] == c["start"]).to_numpy() for c in (covers_a, covers_b))
    left["group"], right["group"] = np.cumsum(same_a) - 1, np.cumsum(same_b) - 1
    overlaps = pd.DataFrame({
        "a": np.concatenate([covers_a["token"], covers_b["other"][~same_b]]), "b": np.concatenate([covers_a["other"], covers_b["token"][~same_b]]),
    })
    return left, right, overlaps


def links(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, keys of id pairs and how often each is linked; a pair of a document may come several times."""
    groups = int(left["group"].iloc[-1]) + 1 if len(left) else 0
    in_a, in_b = np.bincount(left["group"], minlength=groups), np.bincount(right["group"], minlength=groups)
    first = np.concatenate([[0], np.cumsum(in_b)])[:-1]
    group, ids, doc = left["group"].to_numpy(), left["id"].to_numpy(), left["doc"].to_numpy()
    other = right["id"].to_numpy()
    plain = in_a * in_b <= MANY
    chosen = np.flatnonzero(plain[group])
    times = in_b[group[chosen]]
    ends = np.cumsum(times)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(first[group[chosen]], times)
    yield np.repeat(doc[chosen], times), np.repeat(ids[chosen], times) << SHIFT | other[place], np.ones(len(place), np.int64)
    starts = np.concatenate([[0], np.cumsum(in_a)])
    for g in np.flatnonzero(~plain):
        a_ids, a_times = np.unique(ids[starts[g] : starts[g + 1]], return_counts=True)
        b_ids, b_times = np.unique(other[first[g] : first[g] + in_b[g]], return_counts=True)
        for i, n in zip(a_ids, a_times):
            yield np.full(len(b_ids), doc[starts[g]]), i << SHIFT | b_ids, n * b_times


def summed(parts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, pairs and times, each pair once per document."""
    doc, pair, times = (np.concatenate(p) for p in zip(*parts))
    names, code = np.unique(pair, return_inverse=True)
    key = doc * len(names) + code
    found, inverse = np.unique(key, return_inverse=True)
    return found // max(1, len(names)), names[found % max(1, len(names))], np.bincount(inverse, times, len(found)).astype(np.int64)


class Printed:
    """The text of groups, put together from ready pieces per id."""

    def __init__(self, size: int):
        numbers = [b"%d" % i for i in range(size)]
        self.ends = [np.array([n + sign for n in numbers], dtype=object) for sign in (b",", b"|", b";")]

    def digests(self, left: pd.DataFrame, right: pd.DataFrame, docs: int) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` per document; empty for one without tokens."""
        comma, bar, semicolon = self.ends
        texts = []
        for side, last in ((left, bar), (right, semicolon)):
            group, ids = side["group"].to_numpy(), side["id"].to_numpy()
            closes = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
            texts.append(np.where(closes, last[ids], comma[ids]))
        order = np.argsort(np.concatenate([left["group"] * 2, right["group"] * 2 + 1]), kind="stable")
        text = np.concatenate(texts)[order]
        ends = np.cumsum(np.bincount(left["doc"], minlength=docs) + np.bincount(right["doc"], minlength=docs))
        out, start = [], 0
        for end in ends:
            out.append(hashlib.sha256(b"".join(text[start:end])[:-1]).hexdigest() if end > start else "")
            start = end
        return out


COUNTS = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string"
FOUND = COUNTS + ", pairs binary, times binary, pair bigint, docs bigint"


def _linked(docs: DataFrame, a: tuple[str, str], b: str, size: int) -> DataFrame:
    """A row per document with its pairs, and a row per chunk and pair with the number of its documents (`pair` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a, b)
        printed = Printed(max(map(len, both.sizes)))
        schema = pa.schema([
            ("chunk", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")),
            ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64()),
        ])
        chunk = TaskContext.get().partitionId() << 32
        held_pairs, held_docs, held = [], [], 0

        def table(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def pairs_of_chunk() -> pa.RecordBatch:
            names, code = np.unique(np.concatenate(held_pairs), return_inverse=True)
            counts = np.bincount(code, np.concatenate(held_docs), len(names)).astype(np.int64)
            return table(chunk=np.full(len(names), chunk), pair=names, docs=counts)

        for ids, texts in _groups(batches, 1_000_000):
            left, right, overlaps = aligned(texts, both)
            n = len(ids)
            doc, pair, times = summed(list(links(left, right)), n)
            count = lambda d: np.bincount(d, minlength=n)
            closes = left["group"].diff(-1).to_numpy() != 0
            ends = np.cumsum(count(doc))
            parts = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()))
            yield table(
                chunk=np.full(n, chunk), doc_id=ids, n_a=count(left["doc"]), n_b=count(right["doc"]), n_groups=count(left["doc"][closes]), n_overlaps=count(left["doc"].to_numpy()[overlaps["a"].to_numpy(int)]),
                n_links=np.bincount(doc, times, n).astype(np.int64), groups_sha256=printed.digests(left, right, n),
                pairs=[pair[s:e].astype("<i8").tobytes() for s, e in parts], times=[times[s:e].astype("<i4").tobytes() for s, e in parts],
            )
            names, counts = np.unique(pair, return_counts=True)
            held_pairs.append(names)
            held_docs.append(counts)
            held += sum(map(len, texts))
            if held >= size:
                yield pairs_of_chunk()
                held_pairs, held_docs, held, chunk = [], [], 0, chunk + 1
        if held_pairs:
            yield pairs_of_chunk()

    return docs.mapInArrow(run, FOUND)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about `size` letters together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def summary(docs: DataFrame, a: tuple[str, str], b: str, text: str = "text", chunk: int = 8_000_000) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are the best of their A id, counts, a digest of the groups, and overlaps.

    A pair's count is the number of documents (rows) of the corpus that hold it linked; a link is best if no other pair of its A id
    has a higher count. A null or empty text, and one that either side does not give back byte by byte, has no tokens: zeros, and an empty
    digest. Repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    found = stored(_linked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text)), a, b, chunk), "links")
    pairs = found.where("pair is not null").select("chunk", "pair", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    first = F.shiftright("pair", SHIFT).alias("a")
    best = counts.groupBy(first).agg(F.max("count").alias("most"))  # as many rows as the vocabulary has ids at most
    judged = pairs.select("chunk", "pair").join(counts, "pair").withColumn("a", first).join(best, "a")
    judged = judged.select(F.col("chunk").alias("part"), "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    rows = found.where("pair is null").drop("pair", "docs")

    def scored(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("pair")
        pair, count, best = table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy()
        n_best, total = [], []
        for keys, times in zip(rows["pairs"], rows["times"]):
            at, n = np.searchsorted(pair, np.frombuffer(keys, "<i8")), np.frombuffer(times, "<i4").astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            total.append(int((n * count[at]).sum()))
        out = rows.drop(columns=["chunk", "pairs", "times"])
        return out.assign(n_best=n_best, count_sum=total)

    schema = COUNTS.removeprefix("chunk bigint, ") + ", n_best bigint, count_sum bigint"
    out = rows.groupBy("chunk").cogroup(judged.groupBy("part")).applyInPandas(scored, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
