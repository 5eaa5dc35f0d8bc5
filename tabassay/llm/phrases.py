"""Phrases of words that occur together, by dynamic itemset counting.

The table is dealt to shards, which are scanned in turn, over and over. Words are counted from the first shard on. A longer
phrase is counted from the first scan after both its subphrases (all but the last, all but the first word) have reached the
threshold, wherever in the cycle that is, and until it has seen each shard once; so its count is exact, and lengths
are counted side by side. Once no phrase is left that has not completed its cycle, all frequent phrases are known.

Which phrases are active is told to tasks by a table of fixed size: a cell, chosen by a phrase's hash, holds the scan after which
a phrase of that cell reached the threshold. Phrases that share a cell may start others too early; these see each shard
once all the same, so counts stay exact, and whatever misses the threshold is dropped. Counts are kept by 96-bit digests of
language and words; one last scan fetches the texts of the phrases that are left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabassay.llm.common import dropped, ship, shuffles_dropped, stored

LONGEST = 5
#: Upper to lower case for A-Z, marks that end a piece to a byte that no text holds, tab to space.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(255 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Between texts; both bytes are in no text.
NEXT = b"\xfe"
#: Texts belong to one of so many blocks by their hash. A phrase's text is fetched from one block that holds it.
BLOCKS = 1024
#: The owner of a cell that several phrases share: every block.
ANY = BLOCKS
NEVER = 255
#: Odd factors that make a phrase's two hashes depend on the order of its words.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Copies of the table of counts when parts are looked up, so that a word at the start of very many phrases is spread.
SALTS = 16


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the place of each word in them (-1 between pieces and texts), and the text each belongs to.

    All on the bytes of the texts one after the other: no word becomes an object of its own.
    """
    letters = np.frombuffer(NEXT.join(t.translate(TABLE) for t in texts), np.uint8)
    marks = letters >= NEXT[0]
    gaps = marks | (letters == 32)
    edges = np.flatnonzero(np.diff(gaps, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters[~gaps])])
    coded = words.dictionary_encode()
    pieces, of_text = (np.cumsum(m, dtype=np.int32)[starts] for m in (marks, letters == NEXT[0]))
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(pieces[1:] != pieces[:-1])])
    codes, text = np.full(at[-1] + 1, -1, np.int64), np.zeros(at[-1] + 1, np.int64)
    codes[at], text[at] = coded.indices.to_numpy(), of_text
    return coded.dictionary.to_pylist(), codes, text


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread hashes over all bits (the finish of a splitting generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(names: list[bytes], lang: bytes) -> list[np.ndarray]:
    """Two independent hashes of each word, other ones in each language.

    The language's hash is mixed before it is added: a word that is another language's name ("de" in "en", "en" in "de") shares no sum.
    """
    both = []
    for key in ("phrases of words", "words of phrases"):
        table = pd.util.hash_array(np.array([*names, lang, b""], dtype=object), hash_key=key, categorize=False)
        both.append(mixed(table[:-2] + mixed(table[-2:-1])))
    return both


class Level(NamedTuple):
    """The places of a text that may hold an active phrase of one length, the scan each started at, and its digest."""

    length: int
    at: np.ndarray
    start: np.ndarray
    digest: list[np.ndarray]


def levels(names: list[bytes], codes: np.ndarray, lang: bytes, scan: int, cells: np.ndarray, longest: int) -> Iterator[Level]:
    """Words, then phrases whose two subphrases have both reached the threshold before this scan."""
    at = np.flatnonzero(codes >= 0)
    if not len(at):
        return
    with np.errstate(over="ignore"):
        single = [h[codes] for h in hashes(names, lang)]  # any value between pieces
        marks = [h[at] for h in single]
        digest = kept(marks)
        start = np.zeros(len(at), np.uint8)
        yield Level(1, at, start, digest)
        for length in range(2, longest + 1):
            ages = np.full(len(codes) + 1, NEVER, np.uint8)
            # a cell may be set by another phrase, before this one has started
            ages[at] = age = np.maximum(cells[place(digest[0], cells)], start)
            start = np.maximum(age, ages[at + 1])
            going = start <= scan
            at, start = at[going], start[going]
            if not len(at):
                return
            marks = [m[going] * np.uint64(f) + h[at + length - 1] for m, h, f in zip(marks, single, FACTORS)]
            digest = kept(marks)
            yield Level(length, at, start, digest)


def kept(marks: list[np.ndarray]) -> list[np.ndarray]:
    """A digest of 64 and 32 bits."""
    return [mixed(marks[0]), mixed(marks[1]) & np.uint64(0xFFFFFFFF)]


def place(digest: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (digest & np.uint64(len(cells) - 1)).astype(np.int64)


def counted(texts: list[bytes], blocks: np.ndarray, lang: bytes, scan: int, cycle: int, cells: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length: digests, starts with a block, and counts of the phrases that this scan has to count in texts of one language."""
    names, codes, of_text = split_words(texts)
    for level in levels(names, codes, lang, scan, cells, longest):
        now = np.flatnonzero(scan < level.start.astype(int) + cycle)
        if len(now):
            first, counts = grouped([d[now] for d in level.digest])
            first = now[first]
            seen = level.start[first].astype(np.int32) << 16 | blocks[of_text[level.at[first]]]
            yield level.digest[0][first].view(np.int64), level.digest[1][first].astype(np.uint32).view(np.int32), seen, counts


def named(texts: list[bytes], blocks: np.ndarray, lang: bytes, owners: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """For each length: digests and texts of the phrases whose cells belong to the block of a text that holds them; length 0 has the words."""
    names, codes, of_text = split_words(texts)
    yield 0, np.zeros(1, np.int64), np.zeros(1, np.int32), [b"%d" % (codes >= 0).sum()]
    cells = np.where(owners < 0, NEVER, 0).astype(np.uint8)
    for level in levels(names, codes, lang, 0, cells, longest):
        owner = owners[place(level.digest[0], cells)]
        held = np.flatnonzero((owner == ANY) | (owner == blocks[of_text[level.at]]))
        if len(held):
            first = held[grouped([d[held] for d in level.digest])[0]]
            at = level.at[first]
            words = zip(*(map(names.__getitem__, codes[at + i].tolist()) for i in range(level.length)))
            digest = level.digest[0][first].view(np.int64), level.digest[1][first].astype(np.uint32).view(np.int32)
            yield level.length, *digest, list(map(b" ".join, words))


def grouped(digest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of each run of equal digests, and the run's length."""
    order = np.argsort(digest[0])
    one, two = (d[order] for d in digest)
    other = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    if (np.diff(one[other]) == 0).any():  # two phrases of one first half
        order = np.lexsort(digest)
        one, two = (d[order] for d in digest)
        other = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    starts = np.concatenate([[0], other + 1])
    return order[starts], np.diff(np.append(starts, len(order)))


def by_language(batches: Iterator[pa.RecordBatch], size: int = 5_000_000) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Texts of one language and their blocks, of about `size` bytes together with those of other languages."""
    waiting: dict[str, tuple[list[bytes], list[int]]] = {}
    held = 0
    for rows in batches:
        for lang, text, block in zip(*(rows.column(i).to_pylist() for i in range(3))):
            texts, blocks = waiting.setdefault(lang, ([], []))
            texts.append(text)
            blocks.append(block)
            held += len(text)
            if held >= size:
                yield from ((name, t, np.array(b, np.int32)) for name, (t, b) in waiting.items())
                waiting, held = {}, 0
    yield from ((name, t, np.array(b, np.int32)) for name, (t, b) in waiting.items())


def dealt(docs: DataFrame, shards: int, text: str, lang: str) -> DataFrame:
    """lang, text, block and shard: rows go to blocks and shards by the hash of the text, so every scan sees the same ones."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    mark = F.xxhash64("text")
    block, shard = F.pmod(mark, F.lit(BLOCKS)).cast("int"), F.pmod(F.shiftright(mark, 10), F.lit(shards)).cast("int")
    return rows.where(F.length("text") > 0).select("lang", "text", block.alias("block"), shard.alias("shard"))


def scanned(shard: DataFrame, state: DataFrame | None, scan: int, cycle: int, cells: np.ndarray, longest: int, least: int) -> DataFrame:
    """h1, h2, seen, n: the state of counts with what one scan counts in one shard. The cells travel compressed.

    `seen` holds the scan that a phrase started at, and a block. What has ended its cycle below the threshold is left out.
    """
    held = shard.sparkSession.sparkContext.broadcast(zlib.compress(cells.tobytes(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for lang, texts, blocks in by_language(batches):
            for columns in counted(texts, blocks, lang.encode(), scan, cycle, active, longest):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "seen", "n"])

    found = shard.select("lang", "text", "block").mapInArrow(count, "h1 bigint, h2 int, seen int, n bigint")
    found = (found if state is None else found.unionAll(state)).groupBy("h1", "h2").agg(F.max("seen").alias("seen"), F.sum("n").alias("n"))
    going = F.shiftright("seen", 16) + cycle - 1 > scan
    with shuffles_dropped(shard.sparkSession):
        counts = stored(found.where(going | (F.col("n") >= least)), f"scan-{scan}", compression="snappy")
    held.destroy()
    return counts


def reached(counts: DataFrame, least: int, cells: int) -> np.ndarray:
    """Cells of the phrases that have reached the threshold; the driver gets bitmaps of `cells` bits in all."""
    cell = F.col("h1").bitwiseAND(F.lit(cells - 1)) + 1  # buckets of bitmaps start with 1
    maps = counts.where(F.col("n") >= least).select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
    found = np.zeros(cells, bool)
    for r in maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = (r["bucket"] - 1) * 32_768
        found[start : start + len(bits)] |= bits[: cells - start].astype(bool)
    return found


def owners(counts: DataFrame, least: int, cells: int) -> np.ndarray:
    """For each cell the block that has to name its phrase, `ANY` if it has several, -1 if none; the driver gets a row per cell at most."""
    cell = F.col("h1").bitwiseAND(F.lit(cells - 1)).cast("int").alias("cell")
    block = F.when(F.count("*") > 1, ANY).otherwise(F.max(F.col("seen").bitwiseAND(F.lit(BLOCKS - 1)))).cast("smallint")
    table = counts.where(F.col("n") >= least).groupBy(cell).agg(block.alias("block")).toArrow()
    found = np.full(cells, -1, np.int16)
    found[table["cell"].to_numpy()] = table["block"].to_numpy()
    return found


def frequent(
    docs: DataFrame, least: int = 100, longest: int = LONGEST, shards: int = 2, cell_bits: int = 24, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """lang, length, phrase, a: all phrases of 1 to `longest` words that occur `least` times or more; and lang, n: all words.

    Both tables are stored. `docs` is read once a scan, so store it first if it is dear to compute. Counts are kept by digests of 96 bits
    (with ten million million different phrases, two of them share one with a chance below a thousandth); texts of the frequent
    ones are fetched by one more scan. `cell_bits` bounds what tasks are told; it changes how much is counted in vain only.
    """
    ship(docs.sparkSession)
    rows, state = dealt(docs, shards, text, lang), None
    cells = np.full(1 << cell_bits, NEVER, np.uint8)
    scan, until = 0, shards
    while scan < until:
        earlier = state
        state = scanned(rows.where(F.col("shard") == scan % shards), state, scan, shards, cells, longest, least)
        if earlier:
            dropped(earlier)
        new = reached(state, least, len(cells)) & (cells == NEVER)
        scan += 1
        if new.any():
            cells[new] = scan
            until = min(scan + shards, longest * shards)  # by then the longest have completed their cycles
    named_by = owners(state, least, len(cells))
    held = docs.sparkSession.sparkContext.broadcast(zlib.compress(named_by.tobytes(), 1))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(zlib.decompress(held.value), np.int16)
        for language, texts, blocks in by_language(batches):
            for length, h1, h2, phrases in named(texts, blocks, language.encode(), own, longest):
                n = len(phrases)
                columns = [pa.repeat(language, n), pa.array(h1), pa.array(h2), pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(phrases, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "h1", "h2", "length", "phrase"])

    found = rows.select("lang", "text", "block").mapInArrow(texts_of, "lang string, h1 bigint, h2 int, length int, phrase binary")
    found = stored(found.withColumn("phrase", F.col("phrase").cast("string")), "texts", compression="snappy")
    totals = stored(found.where("length = 0").groupBy("lang").agg(F.sum(F.col("phrase").cast("bigint")).alias("n")), "words")
    texts = found.where("length > 0").distinct()
    counts = texts.join(state.where(F.col("n") >= least).select("h1", "h2", F.col("n").alias("a")), ["h1", "h2"])
    counts = stored(counts.select("lang", "length", "phrase", "a"), "phrases")
    for table in (state, found):
        dropped(table)
    return counts, totals


def collocations(
    docs: DataFrame, least: int = 100, longest: int = LONGEST, most: int = 2000, cover: int = 100, text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of two or more words.

    Texts are lower-cased in A-Z and split at .,;:!? and line ends into pieces, these at tabs and spaces into words. `a` is how often a
    phrase occurs within pieces, overlaps included; a cut into a first part and a rest that occur l and r times gives floor(1000 a n / (l r)) with
    n words in all; the lowest-scoring cut counts, of equal ones that with the shortest first part. Phrases that lie within a longer one that
    occurs at least `cover` percent as often are dropped. Order: score and `a` falling, phrase by its bytes.

    A null or empty text has no words; a null language is `und`. Repeated rows count each. An empty table gives an empty result; other
    columns are ignored.
    """
    counts, totals = frequent(docs, least, longest, text=text, lang=lang, **options)
    return ranked(counts, totals, longest, most, cover)


def ranked(counts: DataFrame, totals: DataFrame, longest: int = LONGEST, most: int = 2000, cover: int = 100) -> DataFrame:
    """Collocations out of the counts of all frequent phrases and the number of words per language; in whole numbers of 38 digits."""
    candidates = counts.where("length > 1").join(totals, "lang")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = (
        candidates.withColumn("words", F.split("phrase", " "))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
        .withColumn("first", part(F.lit(1), F.col("k")))
        .withColumn("rest", part(F.col("k") + 1, F.col("length") - F.col("k")))
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
        .drop("words")
    )
    parts = counts.where(F.col("length") < longest).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = lambda name, times: parts.select("lang", "salt", F.col("phrase").alias(name), F.col("a").alias(times))
    cuts = cuts.join(found("first", "l"), ["lang", "salt", "first"]).join(found("rest", "r"), ["lang", "salt", "rest"])
    wide = lambda name: f"cast({name} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    cuts = cuts.groupBy("lang", "length", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what lies within a phrase two words longer and as frequent also lies within one that is a word longer
    longer = counts.where("length > 2").withColumn("words", F.split("phrase", " "))
    ends = F.explode(F.array(part(F.lit(1), F.col("length") - 1), part(F.lit(2), F.col("length") - 1)))
    covers = longer.select("lang", ends.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cuts.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.select("lang", F.col("rank").cast("bigint"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
