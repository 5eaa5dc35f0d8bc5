"""Byte-pair encoding of a public word vocabulary, with a transducer of frequent words.

The lexicon holds the frequent words of a corpus as a minimal acyclic automaton: words share
prefixes and suffixes, and arcs carry numbers that add up to a word's place in the table of ids.
It is one flat file, mapped into memory by every task. Words that it lacks are merged exactly,
pair by pair. Both ways give the ids that the vocabulary's own library gives.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import filterfalse

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed values of the vocabulary's format: its splitting pattern and its two special strings.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
WORDS = regex.compile(PATTERN)
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: str.split() also splits at these, the vocabulary does not.
EXTRA = re.compile(r"[\x1c-\x1f]")
#: Letters of scripts whose classes have long been settled. For others the library is asked, as tables of
#: letters differ between editions of Unicode.
SETTLED = regex.compile(r"[\x00-ͯЀ-ԯ‐-‧ぁ-ゖァ-ヺ一-龥]*")
END_OF_WORD = "</w>"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def lowered(text: str) -> str:
    """Lower case letter by letter: a final sigma is not treated differently."""
    return text.replace("Σ", "σ").lower()


#: Longer words are merged one by one.
SHORT = 32


def by_length(words: Sequence[bytes], chosen: Sequence[int], most: int = 4096) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The chosen words in tables of like length: their places, their bytes (padded with zeros) and their lengths."""
    ordered = sorted(chosen, key=lambda i: len(words[i]))
    for first in range(0, len(ordered), most):
        rows = ordered[first : first + most]
        width = len(words[rows[-1]])
        letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        yield rows, letters, np.array([len(words[i]) for i in rows])


class Vocabulary:
    """Ids, merges and the exact merging of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab: dict[str, int] = data["model"]["vocab"]
        merges = data["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.base = 1 << 20
        self.rank = {vocab[a] * self.base + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.rank.values(), np.int32, len(keys))[order], len(pairs)).astype(np.int32)
        self.made_ids = np.array([*self.made, 0], np.int64)
        letters = byte_letters()
        self.inner_ids = np.array([vocab[letters[b]] for b in range(256)])
        self.last_ids = np.array([vocab[letters[b] + END_OF_WORD] for b in range(256)])
        self.byte = {letter: b for b, letter in letters.items()}
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + END_OF_WORD] for b in range(256)]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = token
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece of text without white space, as bytes."""
        core = piece.rstrip(".,;:!?")
        if core.isalpha() and (core.isascii() or max(core) <= "\xff"):  # letters, then perhaps a run of signs
            word, rest = core.lower().encode(), piece[len(core) :]
            return [word, rest.encode()] if rest else [word]
        if piece.isascii():
            return [w.encode() for w in WORDS.findall(piece.lower())]
        if SETTLED.fullmatch(piece):
            return [w.encode() for w in WORDS.findall(lowered(unicodedata.normalize("NFC", piece)))]
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte.__getitem__, word)) for word, _ in split]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > 48:
            return self._merged_long(ids)
        base, get, none = self.base, self.rank.get, len(self.made)
        ranks = [get(a * base + b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] * base + ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in time n log n."""
        n, base, get = len(ids), self.base, self.rank.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] * base + ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := get(ids[i] * base + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get(ids[before[i]] * base + ids[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def merged_many(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of many words, as little-endian bytes: those of like length are merged side by side, one pair each a time."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for i in range(len(words) if len(short) < len(words) else 0):
            if len(words[i]) > SHORT:
                out[i] = array("I", self.merged(words[i])).tobytes()
        for rows, letters, sizes in by_length(words, short):
            ids = np.where(np.arange(letters.shape[1]) == (sizes - 1)[:, None], self.last_ids[letters], self.inner_ids[letters])
            for row, found in zip(rows, self._merged_table(ids, sizes)):
                out[row] = found
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.made)).astype(np.int32)

    def _merged_table(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Symbols stay in their columns; a merged one leaves a hole, and links lead from symbol to symbol around holes."""
        n, width = ids.shape
        none, columns = len(self.made), np.arange(width)
        ranks = np.full((n, width), none, np.int32)  # of each symbol with the next
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[columns >= (sizes - 1)[:, None]] = none
        ids[columns >= sizes[:, None]] = -1
        after, before = (np.tile(columns + d, (n, 1)).ravel() for d in (1, -1))
        symbol, rank = ids.ravel(), ranks.ravel()
        todo = np.flatnonzero(sizes > 1)
        while len(todo):
            at = ranks[todo].argmin(1)  # the first of equal ones
            here = todo * width + at
            least = rank[here]
            go = least < none
            todo, at, here, least = todo[go], at[go], here[go], least[go]
            row, size = todo * width, sizes[todo]
            gone = row + after[here]
            symbol[here], symbol[gone], rank[gone] = self.made_ids[least], -1, none
            follows = after[gone]
            after[here], rank[here] = follows, none
            more = follows < size
            near = row[more] + follows[more]
            before[near] = at[more]
            rank[here[more]] = self._ranks(symbol[here[more]], symbol[near])
            more = before[here] >= 0
            near = row[more] + before[here[more]]
            rank[near] = self._ranks(symbol[near], symbol[here[more]])
        held = ids >= 0
        block, ends = ids[held].astype("<u4").tobytes(), np.cumsum(held.sum(1) * 4).tolist()
        return [block[start:end] for start, end in zip([0, *ends], ends)]

    def decoded(self, ids: Iterable[int]) -> str:
        """The pieces of all ids, special ones included, joined by spaces: this vocabulary has no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))


def compiled(words: dict[bytes, bytes]) -> bytes:
    """A minimal acyclic transducer from words to ids (little-endian bytes), as one flat block.

    Words are added in order; a state that can get no more arcs is replaced by an equal one if there
    is one, so equal suffixes are stored once. Each arc adds the number of words that sort before
    its target's, so the sum along a word is its place among all words.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, arcs, words below

    def frozen(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append((final, key[1], final + sum(states[t][2] for _, t in arcs)))
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(final, arcs)))

    ordered = sorted(w for w in words if w)
    for word in ordered:
        common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    close(0)
    root = frozen(*path[0])
    arcs_by_key, finals, targets, adds = array("I"), bytearray(), array("I"), array("I")
    for state, (final, arcs, _) in enumerate(states):
        finals.append(final)
        below = int(final)
        for label, target in arcs:
            arcs_by_key.append(state << 8 | label)
            targets.append(target)
            adds.append(below)
            below += states[target][2]
    starts, ids = array("I", [0]), array("I")
    for word in ordered:
        ids.frombytes(words[word])
        starts.append(len(ids))
    parts = [arcs_by_key.tobytes(), targets.tobytes(), adds.tobytes(), starts.tobytes(), ids.tobytes(), bytes(finals)]
    return struct.pack("<7Q", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled transducer in a file, mapped into memory. An arc's key is its state and byte; keys are in order."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            block = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<7Q", block)
        parts, at = [], 56
        for size, kind in zip(sizes, ("<u4",) * 5 + ("u1",)):
            parts.append(np.frombuffer(block, kind, size // np.dtype(kind).itemsize, at))
            at += size
        self.keys, self.targets, self.adds, self.starts, self.ids, self.finals = parts

    def get_many(self, words: Sequence[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian bytes, or None if the lexicon lacks it; words walk side by side."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return out
        for rows, letters, sizes in by_length(words, [i for i, w in enumerate(words) if w]):
            state, place = np.full(len(rows), self.root, np.int64), np.zeros(len(rows), np.int64)
            known = np.ones(len(rows), bool)
            for column in range(letters.shape[1]):
                key = state << 8 | letters[:, column]
                arc = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
                going = sizes > column
                known &= ~going | (self.keys[arc] == key)
                going &= known
                place += np.where(going, self.adds[arc], 0)
                state = np.where(going, self.targets[arc], state)
            known &= self.finals[state] > 0
            for at in np.flatnonzero(known):
                out[rows[at]] = self.ids[self.starts[place[at]] : self.starts[place[at] + 1]].tobytes()
        return out


class Encoder:
    """Texts to ids. It remembers the ids of pieces between spaces, and forgets all when it holds more than `held`.

    Splitting, normalisation and merges never look across white space, so pieces are independent.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, held: int = 800_000):
        self.vocabulary, self.lexicon, self.held = vocabulary, lexicon, held
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        words = list(map(self.vocabulary.words, pieces))
        distinct = list({word for several in words for word in several})
        found: list[bytes | None] = self.lexicon.get_many(distinct) if self.lexicon else [None] * len(distinct)
        rare = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rare, self.vocabulary.merged_many([distinct[i] for i in rare])):
            found[i] = ids
        ids_of = dict(zip(distinct, found))
        known = self.known
        for piece, several in zip(pieces, words):
            known[piece] = ids_of[several[0]] if len(several) == 1 else b"".join(map(ids_of.__getitem__, several))

    def _parts(self, text: str) -> list[str]:
        """The text, cut at special strings: these have odd places."""
        cut = self.vocabulary.cut
        return cut.split(text) if cut and "<|" in text else [text]

    def many(self, texts: Iterable[str], group: int = 4_000_000) -> Iterator[bytes]:
        """Ids of each text, little-endian, four bytes each. Special strings in a text give their special ids.

        Texts are taken in groups of about `group` characters; the new pieces of a group are looked up together.
        """
        waiting: list[str] = []
        size = 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= group:
                yield from self._group(waiting)
                waiting, size = [], 0
        yield from self._group(waiting)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        split = [[_pieces(part) if i % 2 == 0 else part for i, part in enumerate(self._parts(text))] for text in texts]
        new = self._new(split)
        if len(self.known) + len(new) > self.held:
            self.known.clear()
            new = self._new(split)
        self._learn(new)
        get, special = self.known.__getitem__, self.vocabulary.special
        for parts in split:
            yield b"".join(special[p].to_bytes(4, "little") if i % 2 else b"".join(map(get, p)) for i, p in enumerate(parts))

    def _new(self, split: list[list]) -> set[str]:
        new: set[str] = set()
        for parts in split:
            for pieces in parts[::2]:
                new.update(filterfalse(self.known.__contains__, pieces))
        return new

    def ids(self, text: str) -> bytes:
        return next(self.many([text]))


def _pieces(text: str) -> list[str]:
    return SPACE.split(text) if EXTRA.search(text) else text.split()
