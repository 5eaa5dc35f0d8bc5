"""Secret scans by a battery of randomness tests. DataFrame functions only.

Three patterns give the base spans. Every other run of at least 20 token characters is a
candidate: its encoding is inferred from its characters, then three tests compare it with random
text in that encoding (chi-squared uniformity of the alphabet, runs above and below the middle of the
alphabet, serial correlation of neighbours). A candidate that passes as random gets a second
p-value, under the hypothesis that it is ordinary text or digits in that encoding: its likelihood there, from how
often letters stand in prose and how kinds of letters follow each other, over that of random text. The
inverse of this ratio bounds the p-value. Benjamini and Hochberg's rule on these, per encoding and class of length
over the whole table, says which are reported, so that long texts and large corpora
do not raise the share of false reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import let, prefix_sums, stored

# The patterns of the base kinds; a match counts from the given length of the given group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a run that is too short holds no longer one
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more, likewise
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"  # a name before = is no part of a value
KINDS = ["assign", "access", "hex", "random"]

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of encodings: hex, base32, letters of one case with digits, letters of both, base64.
ENCODINGS = [DIGITS + "abcdef", UPPER + "234567", LOWER + DIGITS, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/"]
HEX_CODE, BASE32, ONE_CASE, BOTH_CASES, BASE64 = range(5)
#: In hundredths of the letters of prose in several languages.
SHARES = dict(
    a=8, b=2, c=3.2, d=4, e=14, f=1.8, g=2.2, h=4, i=7.5, j=0.5, k=1.2, l=4.5, m=2.8, n=8, o=6, p=2.5, q=0.6, r=6.8, s=7, t=7.5, u=4.2, v=1.4, w=1.5,
    x=0.5, y=1.2, z=0.9,
)
#: How often the kinds (lower vowel, lower consonant, upper vowel, upper consonant, digit, sign) follow each kind in words and identifiers.
FOLLOWS = [
    [0.14, 0.76, 0.008, 0.027, 0.015, 0.05],
    [0.50, 0.40, 0.008, 0.027, 0.015, 0.05],
    [0.08, 0.17, 0.08, 0.57, 0.03, 0.07],
    [0.25, 0.10, 0.28, 0.27, 0.04, 0.06],
    [0.015, 0.035, 0.01, 0.03, 0.75, 0.16],
    [0.22, 0.38, 0.05, 0.13, 0.17, 0.05],
]
STEPS, BINS = 20, 400  # p-values are counted by twentieths of a decimal power


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of start, end (code points, end exclusive), token and the group's text, for each match."""

    def placed(parts: Column) -> Column:
        length = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
        sums = let(
            F.zip_with(length(F.slice(parts["gaps"], 1, F.size(parts["found"]))), length(parts["found"]), lambda g, m: g + m),
            prefix_sums,
        )
        return let(
            sums,
            lambda before: F.transform(
                parts["found"],
                lambda token, i: let(
                    F.get(before, i) + F.char_length(F.get(parts["gaps"], i)),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.char_length(token)).alias("end"),
                        token.alias("token"),
                        F.get(parts["groups"], i).alias("value"),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.struct(F.split(text, pattern).alias("gaps"), found.alias("found"), groups.alias("groups"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string,value:string>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def _spans(matches: Column, kind: str, least: int = 0) -> Column:
    held = F.filter(matches, lambda m: F.char_length(m["value"]) >= least) if least else matches
    return F.transform(
        held, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))
    )


def _normal(z: Column) -> Column:
    """Distribution function of the normal law, by a logistic curve (error under 0.0002)."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z)) * (1.5976 + 0.070565 * z * z)))


def _tail(z: Column) -> Column:
    return 2 * _normal(-F.abs(z))


def _kind(letter: str) -> int:
    if letter.isalpha():
        return 2 * letter.isupper() + (letter.lower() not in "aeiou")
    return 4 if letter.isdigit() else 5


def _evidence() -> tuple[Column, Column, Column]:
    """Decimal logarithms of random over ordinary likelihood, per encoding: of a letter, of a pair of neighbours, of the start."""
    letters, pairs, starts = [], [], []
    for alphabet in ENCODINGS:
        share = {c: SHARES.get(c.lower(), 1) for c in alphabet}
        sums = [sum(n for c, n in share.items() if _kind(c) == kind) for kind in range(6)]
        known = [kind for kind in range(6) if sums[kind]]
        starts.append(log10(len(known)))
        letters.append([log10(sums[_kind(c)] / share[c] / len(alphabet)) for c in alphabet])
        after = lambda a, b: log10(sum(FOLLOWS[a][kind] for kind in known) / FOLLOWS[a][b])
        pairs.append([after(_kind(a), _kind(b)) for a in alphabet for b in alphabet])
    # One literal a row, which the optimizer folds: thousands of literals would take long to plan.
    listed = lambda row: F.split(F.lit(",".join(f"{x:.5f}" for x in row)), ",").cast("array<double>")
    return F.array(*map(listed, letters)), F.array(*map(listed, pairs)), listed(starts)


def _battery(token: Column) -> Column:
    """For one candidate: is it consistent with random text, its class (encoding and length) and its p-value as ordinary text."""
    plain, joined = F.translate(F.rtrim(token, F.lit("=")), "-_=", "+//"), F.replace(F.rtrim(token, F.lit("=")), F.lit("-"), F.lit(""))
    # Dashes between hex digits, as in a UUID, tell nothing.
    hexes = joined.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$")
    code = (
        F.when(hexes, HEX_CODE)
        .when(plain.rlike("^[A-Z2-7]+$"), BASE32)
        .when(plain.rlike("[0-9]") & plain.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), ONE_CASE)
        .when(plain.rlike("^[A-Za-z0-9]+$"), BOTH_CASES)
        .otherwise(BASE64)
    )
    body = F.when(hexes, F.lower(joined)).when(code == ONE_CASE, F.lower(plain)).otherwise(plain)
    by_letter, by_pair, by_start = _evidence()
    number = lambda x: x.cast("double")
    add = lambda a, x: a + x

    def tests(t: Column) -> Column:
        size, k = number(F.char_length(t["body"])), number(F.char_length(t["letters"]))
        squares = F.aggregate(
            F.transform(
                F.split(t["letters"], ""),
                lambda c: F.pow(number(F.char_length(t["body"]) - F.char_length(F.replace(t["body"], c, F.lit("")))), F.lit(2)),
            ),
            F.lit(0.0),
            add,
        )
        codes = F.transform(F.split(t["body"], ""), lambda c: number(F.instr(t["letters"], c) - 1))
        return let(
            F.struct(size.alias("n"), k.alias("k"), (squares * k / size - size).alias("chi"), codes.alias("x"), t["code"].alias("code")),
            verdict,
        )

    def verdict(s: Column) -> Column:
        n, k, chi, x = s["n"], s["k"], s["chi"], s["x"]
        free = k - 1
        spread = F.lit(2.0) / (9 * free)
        uniform = _normal(-(F.pow(chi / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        upper = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v >= k / 2, 1.0).otherwise(0.0))
        neighbours = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x)).alias("b"))
        turns = F.aggregate(
            neighbours, F.lit(0.0), lambda a, p: a + F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0)
        )
        mean = 2 * upper * (n - upper) / n
        runs = F.when(mean <= 1, F.lit(9.0)).otherwise((turns - mean) / F.sqrt(mean * F.greatest(mean - 1, F.lit(0.1)) / (n - 1)))
        middle = (k - 1) / 2
        serial = F.aggregate(neighbours, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
        serial = serial / ((k * k - 1) / 12) / F.sqrt(n - 1)
        random = 3 * F.least(uniform, _tail(runs), _tail(serial)) >= 0.01
        of_letters, of_pairs = F.get(by_letter, s["code"]), F.get(by_pair, s["code"])
        ordinary = F.get(by_start, s["code"]) + F.aggregate(x, F.lit(0.0), lambda a, v: a + F.get(of_letters, v.cast("int")))
        ordinary = F.aggregate(neighbours, ordinary, lambda a, p: a + F.get(of_pairs, (p["a"] * k + p["b"]).cast("int")))
        level = F.when(random, F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(ordinary * STEPS)))).otherwise(0).cast("int")
        group = s["code"] * 64 + F.floor(F.log2(n)).cast("int")
        return F.struct(random.alias("random"), group.alias("class"), level.alias("level"))

    alphabets = F.array(*map(F.lit, ENCODINGS))
    return let(let(F.struct(body.alias("body"), code.alias("code")), lambda t: t.withField("letters", F.get(alphabets, t["code"]))), tests)


def scanned(docs: DataFrame, text: str = "text", rate: float = 0.01, carried: Sequence[str] = ("*",)) -> DataFrame:
    """`doc` (the carried columns of the input, packed), `base` and `spans`: arrays of start, kind, end by start, then kind.

    Offsets are code points, ends exclusive; `kind` is a place in KINDS. Random spans that
    overlap a base span are not reported twice. `rate` bounds the expected share of false reports
    among candidates. A null or empty text has no spans, an empty table gives an empty result, repeated
    rows give the same spans.
    """
    body = F.col("body")
    base = F.concat(
        _spans(_matches(body, ASSIGN, 2), "assign", 8), _spans(_matches(body, ACCESS), "access"), _spans(_matches(body, HEX), "hex")
    )
    df = docs.select(F.struct(*carried).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    df = df.select("doc", "body", F.sort_array(base).alias("base"), _matches(body, CANDIDATE).alias("runs"))
    free = F.filter(
        "runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])) & r["token"].rlike("[0-9A-Za-z]")
    )
    df = df.select("doc", "base", free.alias("runs"))
    tested = F.transform(
        "runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), _battery(r["token"]).alias("test"))
    )
    df = stored(df.select("doc", "base", tested.alias("runs")), "spans")
    # A row per encoding, class of length and level: at most 5 times 32 times 401, whatever the table's size.
    levels = (
        df.select(F.explode("runs.test").alias("t")).groupBy("t.class", "t.level").agg(F.count("*").alias("n")).collect()
    )
    limits = _limits([(r["class"], r["level"], r["n"]) for r in levels], rate)
    known = F.create_map(*(F.lit(x) for pair in ({-1: BINS + 1} | limits).items() for x in pair))
    held = F.filter(
        "runs", lambda r: r["test"]["random"] & (r["test"]["level"] >= F.coalesce(F.element_at(known, r["test"]["class"]), F.lit(BINS + 1)))
    )
    added = F.transform(
        held, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end"))
    )
    return df.select("doc", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def _limits(levels: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Per class, the lowest level whose p-value meets Benjamini and Hochberg's bound."""
    limits: dict[int, int] = {}
    for size in {s for s, _, _ in levels}:
        own = sorted(((level, n) for s, level, n in levels if s == size), reverse=True)
        total, rank = sum(n for _, n in own), 0
        for level, n in own:
            rank += n
            if 10 ** (-level / STEPS) <= rate * rank / total:
                limits[size] = level
    return limits


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(found: DataFrame) -> DataFrame:
    """One row per document of `scanned`: counts per base kind, a digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by `mask`; overlapping spans get one mask. Other texts stay as they are."""
    body, spans = F.col(f"doc.{text}"), F.col("spans")

    def masked(state: Column, s: Column) -> Column:
        gap = F.substring(body, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(gap, F.lit(mask)))).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, masked, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(body, (s["at"] + 1).cast("int"))))
    found = scanned(docs, text)
    clean = F.when(F.size(spans) > 0, done).otherwise(body)
    return found.select(*(clean.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
