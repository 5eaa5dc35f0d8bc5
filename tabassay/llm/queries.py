"""The operators of this folder on the given tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm import (
    alignment, chat, encoding, importance, neighbours, packing, phrases, products, quality_rules, secrets, sharding, simhash, urls,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The same vocabulary twice: as its library reads it, and as ranks, which are faster for ordinary texts.
BYTE_VOCABULARY = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_word_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.formatted(turns.unionByName(probe)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carried=["doc_id"])
    return found.select(F.col("doc.doc_id").alias("doc_id"), "weight", "key", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scanned(_table(spark, sf_dir, "documents"), carried=["doc_id"]))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(_table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents"), carried=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good"]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *names)


def op11_largest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.largest_products(_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_word_automaton, op2_chat_windows, op3_packing, op4_importance_resampling, op5_simhash,
        op6_secret_scan, op7_nearest, op8_url_filter, op9_sharding, op10_quality_rules,
        op11_largest_products, op12_token_alignment, op13_collocations,
    )
}
#: Integer products in double precision, exact for the vectors given here.
PRODUCTS_SQL = """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: All phrases counted at once.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), lines AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), phrases AS (
    SELECT lang, k, unnest([array_to_string(words[i : i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)]) AS phrase
    FROM lines, range(1, 6) AS lengths(k)
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM phrases GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, cut, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM candidates c
    JOIN range(1, 5) AS places(cut) ON cut < c.k
    JOIN totals USING (lang)
    JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : cut], ' ')
    JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1 : c.k], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM candidates b
        WHERE b.lang = s.lang AND b.k > s.k AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
    )
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

#: The others cannot be said in SQL at bearable cost; tests/llm holds them against brute force, libraries and round trips.
ORACLES: dict[str, str] = {"op11_largest_products": PRODUCTS_SQL, "op13_collocations": COLLOCATIONS_SQL}
