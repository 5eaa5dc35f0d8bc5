"""Largest products, token alignment and collocations against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabassay.llm import alignment, common, phrases, products
from tabassay.llm.bpe import byte_letters
from tabassay.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, pair string, chunk string, length string, shard string"
VECTORS = "vec_id bigint, embedding array<float>, label int, length string, x string, part string"


def floors(vector):
    if vector is None or any(v is None or not np.isfinite(v) for v in vector):
        return None
    return [int(np.floor(64 * float(np.float32(v)))) for v in vector]


def best_products(rows, k, every=20):
    usable = [(i, id_, x) for i, (id_, v, *_) in enumerate(rows) if (x := floors(v)) is not None]
    out = []
    for i, query, q in usable:
        if query is None or query % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, x)), id_ is None, id_ or 0) for j, id_, x in usable if j != i]
        for rank, (score, none, id_) in enumerate(sorted(scores)[:k], 1):
            out.append((query, rank, None if none else id_, max(-(2**63), min(2**63 - 1, -score))))
    return sorted(out, key=str)


def odd_vectors(seed=3, n=300, width=6):
    rnd = random.Random(seed)
    row = lambda i, v: (i, v, 1, "clash", "clash", "clash")
    rows = [row(i, [rnd.gauss(0, 1) * 2 ** rnd.randint(0, 6) for _ in range(width)]) for i in range(n)]
    rows += [row(i % 400 * 20, [1.0, 0.5, 0.25, 0.0, -1.0, 2.0]) for i in range(80)]  # one vector, often, with repeated ids
    odd = [None, [], [0.0] * width, [1.0, None], [1.0, float("nan")], [float("inf")], [0.3], [9.0] * (width + 2), [-0.001] * width]
    rows += [row(1000 + 20 * i, v) for i, v in enumerate(odd)] + [row(None, [3.0] * width), row(None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"part": 16, "seeds": 3, "block": 4}, {"part": 50, "seeds": 40, "block": 1000}])
def test_largest_products_are_exact(spark, options):
    rows = odd_vectors()
    found = products.largest_products(spark.createDataFrame(rows, VECTORS).repartition(3), k=7, **options)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == best_products(rows, 7)


def test_products_beyond_doubles_are_exact(spark):
    big = 2.0**24
    rows = [(20 * i, [big + 2 * i, big - 2 * i, 1.0], 0, "", "", "") for i in range(12)] + [(1, [1e30, 0.0, 0.0], 0, "", "", "")]
    found = products.largest_products(spark.createDataFrame(rows, VECTORS), k=5)
    assert sorted(map(tuple, found.collect()), key=str) == best_products(rows, 5)


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert products.largest_products(empty).collect() == []
    one = spark.createDataFrame([(20, [1.0], 0, "", "", ""), (3, [2.0], 0, "", "", "")], VECTORS)
    assert [tuple(r) for r in products.largest_products(one).collect()] == [(20, 1, 3, 64 * 128)]


def test_length_and_coordinates_leave_most_products_out():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-50, 50, (4000, 8)) * 2.0 ** rnd.integers(0, 8, (4000, 1))
    lengths = np.sqrt((x**2).sum(1))
    order = np.argsort(-lengths)
    x, lengths = x[order], lengths[order]
    true = np.sort(x[:50] @ x.T, 1)[:, ::-1][:, :5]
    for switch in (0.0, 0.7, 2.0):  # all by coordinates, by choice, all by length
        best = products.Best(np.arange(4000), np.ones(4000, bool), np.full(50, -np.inf), 5)
        done = products.search(x, lengths, np.arange(4000), x[:50], lengths[:50], np.full(50, -1), best, bucket=128, switch=switch)
        assert (best.scores.reshape(50, 5) == true).all()
        assert done < 0.4 * 50 * 4000


def test_coordinates_never_lose_a_vector():
    rnd = np.random.default_rng(2)
    unit = rnd.normal(size=(2000, 4))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    order = np.argsort(unit, axis=0)
    for query in unit[:40]:
        for cosine in (-0.9, 0.0, 0.5, 0.9, 0.99, 1.0):
            assert set(np.flatnonzero(unit @ query >= cosine)) <= set(products.by_coordinates(unit, order, query, cosine))


def brute_alignment(rows):
    a, b = Tokenizer.from_file(BYTE_VOCABULARY[0]), sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
    a.encode_special_tokens = True
    byte = {letter: n for n, letter in byte_letters().items()}
    per, held = [], Counter()
    for doc, text in rows:
        groups = []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            cut = lambda parts: list(np.cumsum([len(p) for p in parts]))
            ends = sorted(set(cut(bytes_a)) & set(cut(bytes_b)))
            place = lambda parts: [next(g for g, e in enumerate(ends) if e >= x) for x in cut(parts)]
            groups = [([], []) for _ in ends]
            for side, (ids, parts) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                for i, g in zip(ids, place(parts)):
                    groups[g][side].append(i)
        linked = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(linked.keys())
        per.append((doc, groups, linked))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc, groups, linked in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def odd_texts():
    rnd = random.Random(8)
    signs = "aB'sé日本 ▁​\t\n\x00👍𝕏ﬁ=-<|>/0x9"
    texts = [None, "", " ", "\n", "word", "a▁b", "<|endoftext|> <s> <0x0A>", "naïve café日本語テスト", "x" * 700, "=" * 3001 + "日" * 900, " " * 1200 + "end"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    texts += ["The quick brown fox jumped over the lazy dogs. " * n for n in (1, 2, 40)] + ["word", "word"]
    return texts


def test_alignment_counts_as_brute_force(spark):
    texts = odd_texts()
    rows = [(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "word of no id", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for chunk in (100, 8_000_000):
        found = alignment.summary(docs, BYTE_VOCABULARY, PIECE_VOCABULARY, chunk=chunk)
        assert sorted((tuple(r)[:8] for r in found.collect()), key=str) == brute_alignment([r[:2] for r in rows])
    assert alignment.summary(spark.createDataFrame([], DOCS), BYTE_VOCABULARY, PIECE_VOCABULARY).collect() == []


def test_overlaps_are_the_pairs_that_share_a_byte():
    left, right, overlaps = alignment.aligned(["Unfathomable words, 12345 naïve\n\nend", "", "x▁y"], alignment.sides(BYTE_VOCABULARY, PIECE_VOCABULARY))
    shared = {
        (i, j) for i, (d, s, e) in enumerate(zip(left["doc"], left["start"], left["end"]))
        for j, (f, t, u) in enumerate(zip(right["doc"], right["start"], right["end"])) if d == f and s < u and t < e
    }
    assert sorted(map(tuple, overlaps.to_numpy().tolist())) == sorted(shared) and len(shared) > 5
    assert set(left["doc"]) == {0}


def test_groups_of_very_many_pairs_are_counted_by_distinct_ids(monkeypatch):
    both = alignment.sides(BYTE_VOCABULARY, PIECE_VOCABULARY)
    left, right, _ = alignment.aligned(odd_texts()[4:], both)
    want = alignment.summed(list(alignment.links(left, right)), 1)
    monkeypatch.setattr(alignment, "MANY", 1)
    assert all((x == y).all() for x, y in zip(alignment.summed(list(alignment.links(left, right)), 1), want))


def brute_phrases(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][words[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        found = []
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in chosen.items():
            within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and b >= a and within(q) for q, b in chosen.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed=4):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "state\tof", "the", "art", "é", "日本", "go\x1con", "go", "go"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, rnd.choice(["en", "en", "en", "de", None])))
    rows += [(500, None, "en"), (501, "", "fr"), (502, " .\n", "fr"), (503, "one two", "it"), (None, "a b " * 3000, "en")] + rows[:3]
    return [(i, t, lang, "s", 1, "clash", "clash", "clash", "clash") for i, t, lang in rows]


@pytest.mark.parametrize("options", [{"shards": 3}, {"shards": 1, "cell_bits": 5}, {"cell_bits": 7}])
def test_collocations_count_as_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = phrases.collocations(docs, least=5, most=30, **({"cell_bits": 12} | options))
    assert sorted(map(tuple, found.collect())) == brute_phrases([(r[2], r[1]) for r in rows], 5, 30)


def test_words_that_are_names_of_languages_count_in_their_own(spark):
    """"de" in "en" and "en" in "de" had one digest, so the counts of both were added up."""
    rnd = random.Random(9)
    names = ["de", "en", "und", "es"]
    words = ["de", "en", "en", "und", "es", "x\x00", "\x00", "\u00a0", "\x85", "A\u2028b", "İ", "ﬀ", "'\"", "Ä"]
    rows = [(rnd.choice([*names, None]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", ".", "\x0b", "\x0c", "\r\n"]) for _ in range(90))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, lang, *["s", 1], *["clash"] * 4) for i, (lang, t) in enumerate(rows)], DOCS)
    found = phrases.collocations(docs, least=5, most=200, cell_bits=12)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 5, 200)


def test_no_rows_give_no_collocations(spark):
    found = phrases.collocations(spark.createDataFrame([], DOCS), shards=2, cell_bits=8)
    assert found.collect() == []
    assert [c for c, _ in found.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark):
    a, left, right, n = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3, 8 * 10**14 + 9
    counts = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], "lang string, length int, phrase string, a bigint")
    row = phrases.ranked(counts, spark.createDataFrame([("en", n)], "lang string, n bigint")).first()
    assert row["score"] == 1000 * a * n // (left * right)


def test_phrases_of_one_half_of_a_digest_are_told_apart():
    one, two = np.zeros(5, np.uint64), np.array([7, 8, 7, 9, 7], np.uint64)
    first, counts = phrases.grouped([one, two])
    assert {int(two[i]): n for i, n in zip(first, counts)} == {7: 3, 8: 1, 9: 1}


def test_what_is_dropped_is_gone_and_nothing_else(spark):
    first, second = (common.stored(spark.range(3), "trial") for _ in range(2))
    path = Path(first.inputFiles()[0].removeprefix("file://")).parent
    common.dropped(first)
    common.dropped(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert not path.exists() and path.parent.exists() and second.count() == 3


def test_tables_are_stored_without_a_configured_folder(tmp_path):
    """A session of its own process, without any configuration."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from tabassay.llm.common import shared_folder, stored\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert stored(spark.range(4), 'trial').count() == 4 and shared_folder(spark) == shared_folder(spark)\n"
    )
    (tmp_path / "spark-defaults.conf").write_text("")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=300)
