"""Whole groups of texts to ids of the word vocabulary, in arrays.

Letters are classed, words are cut where the class changes, and each distinct word of a group is merged once, by ranks: a
word's end is a letter of its own there (a space, which no word holds). Ids are then dealt back to all places of the words.
Nothing is remembered between groups. Texts that hold special strings, or letters whose classes differ between editions
of Unicode, take the exact encoder of `bpe`.

Ranks merge any two neighbours whose bytes together are a token; the vocabulary lists one pair per token. Both agree if
every token's bytes, merged by themselves, end as that token: merges inside a stretch that no merge has crossed go the same way
as in the stretch alone, so its last two symbols are the listed pair. `agrees` looks at every token.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken

from tabassay.llm.bpe import END_OF_WORD, SETTLED, SHORT, Encoder, Vocabulary, by_length, lowered

SPACE, LETTER, NUMBER, SIGN = range(4)
#: Letters after an apostrophe that make a word with it, by their number. Fixed values of the vocabulary's format.
ENDINGS = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}
#: Longer words are merged one by one, in time that does not grow with the square of the length.
LONG = 256
APOSTROPHE = ord("'")


def _raw(vocabulary: Vocabulary) -> tuple[dict[bytes, int], np.ndarray]:
    """Bytes of each token, a space for the end of a word, with its rank; the ids by rank."""
    ids = [*vocabulary.inner, *vocabulary.last, *vocabulary.made]
    ranks: dict[bytes, int] = {}
    for rank, i in enumerate(ids):
        piece = vocabulary.pieces[i]
        core, end = (piece[: -len(END_OF_WORD)], b" ") if piece.endswith(END_OF_WORD) else (piece, b"")
        ranks.setdefault(bytes(map(vocabulary.byte.__getitem__, core)) + end, rank)
    return ranks, np.array(ids, "<u4")


@lru_cache(maxsize=2)
def agrees(path: str) -> bool:
    """Whether ranks give the ids that the vocabulary's pairs give."""
    vocabulary = Vocabulary(path)
    ranks, ids = _raw(vocabulary)
    if len(ranks) < len(ids):
        return False
    inner = [(token, int(ids[rank])) for token, rank in ranks.items() if not token.endswith(b" ")]
    ends = [(token[:-1], int(ids[rank])) for token, rank in ranks.items() if len(token) > 1 and token.endswith(b" ")]
    inner.append((b" ", vocabulary.inner[ord(" ")]))
    found = vocabulary.merged_many([token for token, _ in ends])
    if any(block != i.to_bytes(4, "little") for block, (_, i) in zip(found, ends)):
        return False
    if any(len(token) > SHORT for token, _ in inner):
        return False
    tokens = [token for token, _ in inner]
    for rows, letters, sizes in by_length(tokens, range(len(tokens))):
        blocks = vocabulary._merged_table(vocabulary.inner_ids[letters], sizes)
        if any(block != inner[row][1].to_bytes(4, "little") for row, block in zip(rows, blocks)):
            return False
    return True


def _classes() -> np.ndarray:
    """The class of each letter of the basic plane; only settled ones are ever looked up."""
    table = np.full(1 << 16, SIGN, np.uint8)
    text = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        table[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-16-le"), "<u2")] = kind
    return table


class RankedEncoder:
    """Texts to ids, for a vocabulary that `agrees`."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        ranks, self.ids_by_rank = _raw(self.vocabulary)
        self.ranks = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(len(self.ids_by_rank), bool)
        self.ends[[rank for token, rank in ranks.items() if len(token) > 1 and token.endswith(b" ")]] = True
        self.classes = _classes()
        self.exact = Encoder(self.vocabulary, held=100_000)

    def many(self, texts: Iterable[str], group: int = 4_000_000) -> Iterator[bytes]:
        """Ids of each text, little-endian, four bytes each. Special strings in a text give their special ids.

        Texts are taken in groups of about `group` letters; a longer text is cut at spaces, which no word crosses.
        """
        waiting: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > group:
                yield from self._group(waiting)
                waiting, size = [], 0
            if len(text) > group:
                yield b"".join(ids for part in _parts(text, group) for ids in self._group([part]))
            else:
                waiting.append(text)
                size += len(text)
        yield from self._group(waiting)

    def _plain(self, text: str) -> str | None:
        """The text as words see it, or None if it is left to the exact encoder."""
        if any(special in text for special in self.vocabulary.special):
            return None
        if text.isascii():
            return text.lower()
        return lowered(unicodedata.normalize("NFC", text)) if SETTLED.fullmatch(text) else None

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self._plain(text) for text in texts]
        block, ends = self._encoded([text for text in plain if text is not None])
        start = 0
        found = iter(ends.tolist())
        for text, ready in zip(texts, plain):
            if ready is None:
                yield self.exact.ids(text)
            else:
                end = next(found)
                yield block[start:end].tobytes()
                start = end

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        if not len(codes):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        kind = self.classes[np.minimum(codes, 0xFFFF)]
        starts = self._starts(codes, kind)
        held = kind != SPACE
        letters = codes[held]
        firsts = np.flatnonzero(starts[held])
        if not len(firsts):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        breaks = np.cumsum([len(text) + 1 for text in texts]) - 1  # places after each text
        words_by = np.searchsorted(np.flatnonzero(starts), breaks)
        sizes = 1 + (letters >= 0x80).astype(np.uint8) + (letters >= 0x800)
        offsets = np.append(0, np.cumsum(np.add.reduceat(sizes, firsts, dtype=np.int64)))
        data = letters.tobytes().decode("utf-32-le").encode()
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        ids, first, count = self._merged(coded.dictionary)
        which = coded.indices.to_numpy()
        counts = count[which]
        upto = np.append(0, np.cumsum(counts))
        places = np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], counts)
        return ids[places], upto[words_by]

    @staticmethod
    def _starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where a word starts: at a change of class, at each number, and around an apostrophe's ending."""
        starts = kind == NUMBER
        starts[0] |= kind[0] != SPACE
        starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != SPACE)
        marks = np.flatnonzero(codes == APOSTROPHE)
        marks = marks[starts[marks]]
        for size, endings in ENDINGS.items():
            near = marks[marks + size < len(codes)]
            for ending in endings:
                here = near[np.logical_and.reduce([codes[near + 1 + i] == ord(letter) for i, letter in enumerate(ending)])]
                starts[here + 1] = False
                after = here + 1 + size
                after = after[after < len(codes)]
                starts[after] |= kind[after] != SPACE
        return starts

    def _merged(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, with the first place and the number of each word's ids."""
        _, offsets, data = words.buffers()
        sizes = np.diff(np.frombuffer(offsets, np.int64, len(words) + 1))
        short = sizes <= LONG
        letters = np.frombuffer(data, np.uint8)[np.repeat(short, sizes)]
        marked = np.insert(letters, np.cumsum(sizes[short]), ord(" ")).tobytes().decode()
        ranks = self.ranks.encode_to_numpy(marked, disallowed_special=())
        last = np.flatnonzero(self.ends[ranks])
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[short] = np.append(0, last + 1)[: len(last)]
        count[short] = last + 1 - first[short]
        ids = array("I", self.ids_by_rank[ranks].tobytes())
        for i in np.flatnonzero(~short).tolist():
            first[i] = len(ids)
            ids.extend(self.vocabulary.merged(words[i].as_py()))
            count[i] = len(ids) - first[i]
        return np.frombuffer(ids, "<u4"), first, count


def _parts(text: str, size: int) -> Iterator[str]:
    """The text, cut at the first space after every `size` letters."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end
