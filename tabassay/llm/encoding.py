"""Tables of texts to ids and back: the lexicon is built from the corpus, encoding runs in tasks."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.bpe import Encoder, Lexicon, Vocabulary, compiled, lowered
from tabassay.llm.common import ship, stored

LETTERS = r"[^\p{L}]+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, lexicon: str | None = None) -> Encoder:
    """One encoder per worker process."""
    return Encoder(Vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def frequent_words(docs: DataFrame, limit: int, text: str = "text") -> list[str]:
    """At most `limit` of the most frequent runs of letters in lower case, counted over all whole texts.

    Words are taken by classes of like counts, eight to a doubling: all classes that fit under the limit. So the
    driver sees a count per class and `limit` words, and no task has to rank words.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), LETTERS)).alias("word"))
    counts = words.where("word != ''").groupBy("word").count().where("count > 1")
    counts = stored(counts.select("word", F.floor(F.log2("count") * 8).cast("int").alias("class")), "words")
    least, total = None, 0
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        if (total := total + r["count"]) > limit:
            break
        least = r["class"]
    return [] if least is None else sorted(r["word"] for r in counts.where(F.col("class") >= least).select("word").collect())


def shared_lexicon(docs: DataFrame, vocabulary: str, size: int = 65_536, text: str = "text") -> str:
    """Compile at most `size` of the most frequent words and give the file to all executors, lost and new ones too; returns its name.

    `size` bounds what the driver holds and sends; it changes the speed, never the ids.
    """
    words = [lowered(word).encode() for word in frequent_words(docs, size, text)]
    block = compiled(dict(zip(words, Vocabulary(vocabulary).merged_many(words))))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="tabassay-"), name)
    with open(path, "wb") as file:
        file.write(block)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encoded(docs: DataFrame, vocabulary: str, lexicon_size: int = 65_536, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, per document.

    Encodes as the vocabulary's library does without extra special tokens. A null text is empty and has no
    ids; empty texts and white space likewise; repeated rows give repeated results; an empty table
    gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    name = shared_lexicon(docs, vocabulary, lexicon_size, text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, name)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for ids in code.many(cell.as_py() or "" for cell in batch.column(1)):
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                numbers = np.frombuffer(ids, "<u4")
                back = hashlib.sha256()
                for at in range(0, len(numbers), 1 << 20):
                    back.update((" " if at else "").encode() + code.vocabulary.decoded(numbers[at : at + (1 << 20)].tolist()).encode())
                text_digests.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(digests, schema)
