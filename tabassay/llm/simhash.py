"""SimHash near-duplicates: fingerprints, blocks by the pigeonhole principle, Hamming distance, components.

`linked` is exact: with `b` blocks, two fingerprints that differ in at most `d` bits agree on some
`b - d` of them, so each choice of these blocks is a table of keys, and close pairs meet under one key.
Within a key, members are reached from one another and only a spanning forest is put out, so
a group of thousands of copies gives as many links as members, not all its pairs.

`one_per_group` compares documents at a similarity of 0.8, where 64 bits say too little: it has 512
bits, and blocks such that close pairs very probably share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import ship, stored

BITS = 64
LINK = "a bigint, b bigint, later boolean"
#: Members of a key that one task compares at once.
MOST = 1 << 16


def _hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of `width` words, repeats included; fewer words are one shingle, none give none."""
    words = text.lower().split()
    if len(words) <= width:
        whole = [b" ".join(words)] if words else []
        return np.array([xxhash.xxh64_intdigest(x, 42) for x in whole], np.uint64)
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of a matrix of 64-bit columns, bits that are set in over half the rows."""
    n, width = hashes.shape
    counts = np.zeros(width * BITS, np.int64)
    for at in range(0, n, 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096].astype("<u8"))
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each whole text, A-Z lower-cased; without words the fingerprint is zero."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_majority(_hashes(cell.as_py() or b"", width)[:, None])[0] for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, "<u8").view("<i8"))], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("binary")).mapInArrow(run, "doc_id bigint, fp bigint")


def _spanning(bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of rows that differ in at most `distance` bits."""
    links, left = [], np.arange(len(bits))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]).sum(1, dtype=np.int64) <= distance
            if near.any():
                found = left[near]
                links += [(at, x) for x in found]
                todo += found.tolist()
                left = left[~near]
    return links


def _in_buckets(width: int, distance: int, put_off: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within runs of equal key; columns: table, key, id, bits (`width` longs as binary, or the id itself if 1).

    A run of over MOST members, if `put_off`, is not compared: its members are put out with `later` set.
    Otherwise its table and key are put out once with `later` set, for `_completed`, and it is taken in parts, each with
    one member of the groups found before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros((0, 2), np.int64)
        ids, bits = np.zeros(0, np.int64), np.zeros((0, width), np.uint64)
        over: tuple | None = None  # the key that is being put off
        told: tuple | None = None  # the key that was last named as too large

        def out(a: np.ndarray, b: np.ndarray, later: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), later))], ["a", "b", "later"])

        def compared(first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if links := np.array(_spanning(bits[first:end], distance), np.int64).reshape(-1, 2).tolist():
                at = np.array(links) + first
                yield ids[at[:, 0]], ids[at[:, 1]]

        for batch in _with_end(batches):
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], 1)
                more = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                wide = (
                    more.view(np.uint64)[:, None]
                    if width == 1
                    else np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, width)
                )
                if over is not None:
                    same = (new == over).all(1)
                    if same.any():
                        yield out(more[same], more[same], True)
                        new, more, wide = new[~same], more[~same], wide[~same]
                    if len(new):
                        over = None
                keys, ids, bits = np.concatenate([keys, new]), np.concatenate([ids, more]), np.concatenate([bits, wide])
            if not len(keys):
                continue
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(keys)]])
            if batch is not None:  # the last run may go on
                starts, ends = starts[:-1], ends[:-1]
            found = []
            sizes = ends - starts
            twos = starts[sizes == 2]
            if len(twos):
                near = np.bitwise_count(bits[twos] ^ bits[twos + 1]).sum(1, dtype=np.int64) <= distance
                found.append((ids[twos[near]], ids[twos[near] + 1]))
            for first, end in zip(starts[sizes > 2], ends[sizes > 2]):
                found += compared(first, end)
            if found:
                yield out(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), False)
            rest = ends[-1] if len(ends) else 0
            keys, ids, bits = keys[rest:], ids[rest:], bits[rest:]
            if len(ids) > MOST and put_off:
                yield out(ids, ids, True)
                over = tuple(keys[0])
                keys, ids, bits = keys[:0], ids[:0], bits[:0]
            elif len(ids) > MOST:
                if told != (told := tuple(keys[0].tolist())):
                    yield out(keys[:1, 0], keys[:1, 1], True)
                links = _spanning(bits, distance)
                if links:
                    at = np.array(links)
                    yield out(ids[at[:, 0]], ids[at[:, 1]], False)
                # Only to shorten the work of _completed: a few groups' members, so that parts stay small.
                reached = {b for _, b in links}
                lead = np.array(sorted({a for a, _ in links} - reached)[: max(1, MOST // 16)], np.int64)
                keys, ids, bits = keys[lead], ids[lead], bits[lead]

    return run


def _completed(links: DataFrame, members: Callable[[], DataFrame], width: int, distance: int) -> DataFrame:
    """Links (a, b) of `_in_buckets` and all that it did not see within keys over MOST.

    Members of one component need no more links. So in each large key the members outside its most frequent component are
    held against all of its members, in blocks of MOST that are dealt out by their numbers: every pair meets in some task.
    """
    near = links.where("NOT later").select("a", "b")
    large = links.where("later").select(F.col("a").alias("table"), F.col("b").alias("key")).distinct()
    if large.isEmpty():
        return near
    # Without hints: there may be a key for each MOST of a table's rows, so Spark broadcasts them only while they are few.
    rows = members().join(large, ["table", "key"]).join(components(near), "id", "left")
    rows = stored(rows.select("table", "key", "id", "bits", F.coalesce("root", "id").alias("root")), "members")
    counts = rows.groupBy("table", "key", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("table", "key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")
    )
    rows = rows.join(main, ["table", "key"])
    blocks = lambda n: F.ceil(F.col(n) / MOST)
    block = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), blocks(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    place = ["table", "key", "i", "j"]
    kept = ["id", "bits", "root"]
    others = rows.where("root <> main").select("*", block("others").alias("i")).select("table", "key", "i", every("all").alias("j"), F.lit(True).alias("other"), *kept)
    whole = rows.where("others > 0").select("*", block("all").alias("j")).select("table", "key", every("others").alias("i"), "j", F.lit(False).alias("other"), *kept)

    def compared(group: pa.Table) -> pa.Table:
        other = group["other"].to_numpy()
        ids, roots = group["id"].to_numpy(), group["root"].to_numpy()
        bits = np.frombuffer(b"".join(group["bits"].to_pylist()), "<u8").reshape(-1, width)
        ids_, roots_, bits_ = ids[~other], roots[~other], bits[~other]
        found = []
        for x in np.flatnonzero(other):
            close = np.flatnonzero(np.bitwise_count(bits_ ^ bits[x]).sum(1, dtype=np.int64) <= distance)
            close = close[roots_[close] != roots[x]]
            # One link to each component that is near.
            found += [(ids[x], ids_[y]) for y in close[np.unique(roots_[close], return_index=True)[1]]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    more = others.unionByName(whole).groupBy(*place).applyInArrow(compared, "a bigint, b bigint")
    return near.union(stored(more, "more-links"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of `blocks - distance` blocks of 64 bits, the signed long that selects them."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(whole, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(blocks, distance))))
    rows = prints.select(keys.alias("table", "key"), "fp").select(F.col("table").cast("bigint"), "key", F.col("fp").alias("id"))
    return rows


def _close(prints: DataFrame, distance: int, blocks: int, put_off: bool) -> DataFrame:
    dealt = _keyed(prints, distance, blocks).repartition("table", "key").sortWithinPartitions("table", "key", "id")
    return dealt.mapInArrow(_in_buckets(1, distance, put_off), LINK)


def linked(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column `fp`: a spanning forest under each key that close pairs share.

    The number of blocks follows the number of fingerprints, so that unrelated ones rarely share a key; it
    changes the work, not the components. Members of keys with over MOST members are taken again with twelve
    blocks, whose keys leave at most 22 bits free: at most 2 ** 22 fingerprints can share one. `_completed` compares the
    members of keys that are still over MOST.
    """
    ship(prints.sparkSession)
    n = prints.count()
    blocks = next((b for b in range(distance + 1, 12) if n <= 4 * 2 ** (BITS * (b - distance) // b)), 12)
    found = stored(_close(prints, distance, blocks, True), "links")
    again = found.where("later").select(F.col("a").alias("fp")).distinct()
    late = stored(_close(again, distance, 12, False), "links")
    members = lambda: _keyed(again, distance, 12).withColumn("bits", F.unhex(F.lpad(F.hex("id"), 16, "0")))
    return found.where("NOT later").select("a", "b").union(_completed(late, members, 1, distance))


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) for each end of a link, by alternating large and small stars.

    Each round is a table in the shared folder; the number of rounds grows with the logarithm of the links.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over close fingerprints.

    A null text is empty; texts without words have fingerprint zero and are linked like any other; equal
    texts share a fingerprint. Repeated rows give repeated results. A null doc_id stays null
    and is nobody's component_id. An empty table gives an empty result; other columns are ignored.
    """
    prints = stored(fingerprints(docs, width, text), "prints")
    known = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct")
    roots = components(linked(known.select("fp"), distance))
    of = known.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(of.join(smallest, "root").select("fp", "n", "component_id"), "components")
    # Fewer than 1000 fingerprints can each have over a thousandth of all rows.
    total = prints.count()
    frequent = F.broadcast(of.where(F.col("n") > total / 1000).select("fp", F.lit(True).alias("frequent"), F.col("component_id").alias("own")))
    split = prints.join(frequent, "fp", "left")
    rare = split.where("frequent IS NULL").drop("own", "frequent").join(of.where(F.col("n") <= total / 1000).drop("n"), "fp")
    hot = split.where("frequent").select("fp", "doc_id", F.col("own").alias("component_id"))
    both = hot.unionByName(rare)
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Similarity of 0.8 and more -------------------------------------------------------------

WIDE = 8  # 64-bit parts of a wide fingerprint
#: Bits between texts whose shingles have a Jaccard similarity of 0.8: 77 of 512 expected, with deviation 8; two deviations more link.
EXPECTED = 77
FAR = 93
#: Keys that such texts are expected to share; they share none with a chance of exp(-3.5).
SHARED = 3.5


def _wide(hashes: np.ndarray) -> np.ndarray:
    """A wide fingerprint: each 64-bit part from another mix of the shingles' hashes."""
    columns = []
    with np.errstate(over="ignore"):
        for part in range(WIDE):
            x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * part * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF | 1)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            columns.append(x ^ (x >> np.uint64(29)))
    return _majority(np.stack(columns, 1))


def _key_bits(texts: int) -> int:
    """Bits of a key: some 64 unrelated texts share one at any number of texts over four million."""
    return min(62, max(16, texts.bit_length() - 6))


def _chosen(key_bits: int) -> np.ndarray:
    """The bits of each key: neighbouring blocks, then blocks of shuffled bits, until texts of a similarity of 0.8 share SHARED keys."""
    every, dice = WIDE * BITS, np.random.default_rng(0)
    tables = int(np.ceil(SHARED / (1 - EXPECTED / every) ** key_bits))
    orders = [np.arange(every)]
    while len(orders) * (every // key_bits) < tables:
        orders.append(dice.permutation(every))
    blocks = [order[: every // key_bits * key_bits].reshape(-1, key_bits) for order in orders]
    return np.concatenate(blocks)[:tables]


def _blocks(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The keys of each row, a column per row of `chosen`."""
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
    keys = np.zeros((len(bits), len(chosen)), np.int64)
    for place in chosen.T:
        keys = (keys << 1) | flat[:, place]
    return keys


def _sketches(docs: DataFrame, width: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (_hashes(cell.as_py() or b"", width) for cell in batch.column(2))
            found = [_wide(h).tobytes() if len(h) else None for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "digest", "bits"])

    rows = docs.select("doc_id", _digest(text).alias("digest"), F.col(text).cast("binary"))
    return rows.mapInArrow(run, "doc_id bigint, digest binary, bits binary")


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def one_per_group(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """The documents without near copies: of each group linked by a similarity of about 0.8 or more, the smallest doc_id stays.

    Words and shingles are those of `fingerprints`. Equal texts are one group always; a null text is empty; texts without words
    are copies only of equal ones. Repeated rows leave one. An empty table stays empty. Columns are kept as they are.
    Keys widen with the number of texts, and their number with them, so that work per text grows slowly. Pairs that share no key are
    missed: about 3 % at a similarity of 0.8, under 1 % from 0.85 on; so are some 2 % at 0.8 beyond FAR bits. Most pairs
    from 0.75 on lie within FAR bits too.
    """
    ship(docs.sparkSession)
    sketches = stored(_sketches(docs, width, text), "sketches")
    texts = sketches.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits"))
    texts = stored(texts.withColumn("id", F.xxhash64("digest")), "texts")
    chosen = _chosen(_key_bits(texts.count()))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WIDE)
                keys = _blocks(bits, chosen)
                n, tables = keys.shape
                rows = np.repeat(np.arange(n), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables), n)), pa.array(keys.ravel()), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))],
                    ["table", "key", "id", "bits"],
                )

    members = lambda: texts.where("bits IS NOT NULL").select("id", "bits").mapInArrow(keyed, "table bigint, key bigint, id bigint, bits binary")
    dealt = members().repartition("table", "key").sortWithinPartitions("table", "key", "id")
    links = stored(dealt.mapInArrow(_in_buckets(WIDE, FAR, False), LINK), "links")
    roots = components(_completed(links, members, WIDE, FAR))
    of = texts.select("id", "digest", "first").join(roots, "id", "left")
    of = of.withColumn("root", F.coalesce("root", "id"))
    order = F.struct(F.col("first").isNull(), "first", "digest")
    kept = of.groupBy("root").agg(F.min_by(F.struct("first", "digest"), order).alias("kept")).select("kept.*")
    # One key that is never null: the join and the removal of repeated rows then share one shuffle of the texts.
    key = lambda doc_id, digest: F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary"))
    kept = kept.select(key(F.col("first"), F.col("digest")).alias("key"))
    rows = docs.select(F.struct("*").alias("doc"), key(F.col("doc_id"), _digest(text)).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
