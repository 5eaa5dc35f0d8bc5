"""Quality rules as weak supervision: rules vote or abstain, EM weighs them. DataFrame functions only.

Each rule reads a document's measures and votes good (1), bad (-1) or abstains (0). The number of
documents per combination of votes is counted over the whole table; from these counts (at most
three to the number of rules) expectation-maximisation estimates how often each rule votes which way on
good and on bad documents. A document stays if its posterior probability of being good is at least one half
and no base rule rejects it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.common import SPACES, let, stored

WINDOW = 8


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text, the first time included."""

    def doubled(parts: Column, width: int) -> Column:
        """Hashes of windows of twice `width` words, from those of `width`, or from the words."""
        n = F.size(parts) - width
        both = F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(width + 1), n)
        return F.zip_with(*both, lambda x, y: F.xxhash64(x, y))

    windows = let(doubled(words, 1), lambda p: let(doubled(p, 2), lambda q: doubled(q, 4)))

    def positions(order: Column) -> Column:
        """First words of repeated windows; `order`: windows by hash, then place."""
        twin = lambda x, k: F.get(order, k)["h"].eqNullSafe(x["h"])
        held = F.filter(order, lambda x, k: (twin(x, k + 1)) | ((k > 0) & twin(x, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(held, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(let(ordered, positions), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated)

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, counted))


def measures(docs: DataFrame, text: str = "text", carried: Sequence[str] = ("*",)) -> DataFrame:
    """`doc` (the carried columns of the input, packed) and the measures of its text; a null text has no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*carried).alias("doc"), body.alias("body"))
    bare = F.btrim("body", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    df = df.select("*", words.alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda a: F.struct(
                F.size(a).cast("long").alias("all"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")
            ),
        ).alias("lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("body", F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_signs"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("body", F.lit(r"[.!?…](?=\s|$)")).cast("long").alias("n_ends"),
    )
    return df.select("*", F.col("lines.all").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines")).drop("lines")


def votes() -> dict[str, Column]:
    """Rules by name: 1 good, -1 bad, 0 abstains."""
    share = lambda n, of: F.col(n) / F.greatest(F.col(of), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = share("word_chars", "n_words")
    ends = share("n_ends", "n_words")
    return {
        "long_enough": rule(F.col("n_words") >= 50, F.col("n_words") < 25),
        "word_length": rule(length.between(3, 9), ~length.between(2.2, 14)),
        "few_symbols": rule(share("n_symbols", "word_chars") < 0.002, share("n_symbols", "word_chars") > 0.015),
        "few_signs": rule(share("n_signs", "word_chars") < 0.05, share("n_signs", "word_chars") > 0.075),
        "few_capitals": rule(share("n_upper", "word_chars") < 0.1, share("n_upper", "word_chars") > 0.25),
        "sentences": rule(ends.between(0.02, 0.25), (ends > 0.5) | (ends < 0.004)),
        "new_lines": rule(F.col("n_dup_lines") == 0, share("n_dup_lines", "n_lines") > 0.5),
        "new_words": rule(share("n_repeat_words", "n_words") < 0.05, share("n_repeat_words", "n_words") > 0.3),
    }


#: How rules are taken to vote before the counts speak: shares of bad, none and good, on bad and on good documents.
START = ((0.4, 0.2, 0.4), (0.02, 0.18, 0.8))
IMAGINED = 20  # documents of each kind that vote so


def estimate(counts: Mapping[tuple[int, ...], int], rounds: int = 200) -> tuple[float, list[list[float]]]:
    """Log odds of good before any vote, and per rule what its votes -1, 0 and 1 add to them.

    `counts`: documents per combination of votes. Rules are taken to be independent given the truth
    and no worse than chance: a bad vote never speaks for good, nor a good vote against it.
    """
    rules = len(next(iter(counts), ()))
    prior, adds = math.log(0.8 / 0.2), [_weights(*START) for _ in range(rules)]
    total = sum(counts.values())
    for _ in range(rounds):
        good_sum = 0.0
        seen = [[[IMAGINED * p for p in kind] for kind in START] for _ in range(rules)]
        for pattern, n in counts.items():
            good = 1 / (1 + math.exp(-prior - sum(a[v + 1] for a, v in zip(adds, pattern))))
            good_sum += n * good
            for (on_bad, on_good), vote in zip(seen, pattern):
                on_bad[vote + 1] += n * (1 - good)
                on_good[vote + 1] += n * good
        share = min(0.99, max(0.01, (good_sum + 8) / (total + 10)))
        new = [_weights(*([x / sum(kind) for x in kind] for kind in both)) for both in seen]
        moved = max((abs(x - y) for p, q in zip(adds, new) for x, y in zip(p, q)), default=0)
        prior, adds = math.log(share / (1 - share)), new
        if moved < 1e-7:
            break
    return prior, adds


def _weights(on_bad: Sequence[float], on_good: Sequence[float]) -> list[float]:
    bad, none, good = (math.log(g / b) for b, g in zip(on_bad, on_good))
    return [min(0.0, bad), none, max(0.0, good)]


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5, carried: Sequence[str] = ("*",)) -> DataFrame:
    """`doc`, measures, votes, `good` (posterior probability), `base_failed` and `kept`.

    A null, empty or blank text has no words and fails the base rule. An empty table gives an empty
    result. Repeated rows are judged alike, each on its own. Columns of the input stay inside `doc`, so their
    names cannot clash.
    """
    rules = votes()
    voted = measures(docs, text, carried).select("*", F.struct(*(v.alias(k) for k, v in rules.items())).alias("votes"))
    voted = stored(voted, "votes")
    # At most 3 ** 8 rows whatever the table's size.
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    prior, adds = estimate({tuple(r["votes"]): r["n"] for r in rows})
    logit = F.lit(prior)
    for name, (bad, none, good) in zip(rules, adds):
        vote = F.col(f"votes.{name}")
        logit += F.when(vote > 0, good).when(vote < 0, bad).otherwise(none)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.select("*", (1 / (1 + F.exp(-logit))).alias("good"), failed.alias("base_failed"))
    return scored.select("*", (~F.col("base_failed") & (F.col("good") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that `judged` keeps, with their columns."""
    return judged(docs, text).where("kept").select("doc.*")
