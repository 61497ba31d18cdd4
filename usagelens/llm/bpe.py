"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one encoding, so it has exactly one last
token.  ``Prefixes`` stores that token for each prefix: a token ending at a position is the
stored one if the last token of what stands before it is compatible with it, that is, if no
merge would have crossed the border between the two.  Appending bytes only adds entries, an
edit recomputes entries from the edit until they agree with the old ones again, and the
encoding is read by walking back from the end.

The columns ``encode`` and ``decode`` run on Arrow batches.  Texts are cut before single
spaces between other characters, where the splitting pattern always starts a new match, so
that the packed ids of frequent words are looked up; anything else goes match by match.

Null and empty texts have no ids.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries of one generation of a worker's caches, and the longest key kept.
CACHE, KEPT = 200_000, 64
#: Words of letters up to Latin Extended-A and the signs after them, if any.
WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-/:-@\\[-`{-~]*)").fullmatch


class Vocabulary:
    """Tokens with their ranks, and which two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(token): int(rank)
                               for token, rank in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last step to ``token``."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                joined = [self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 40)
                          for a, b in zip(parts, parts[1:])]
                at = min(range(len(joined)), key=joined.__getitem__)
                parts[at:at + 2] = [joined[at]]
            self._halves[token] = tuple(parts)
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are encoded together.

        Undo the merges of both sides from the latest to the first.  A merge across the
        border that ranks before the merge just undone would have come first.
        """
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= 8 * CACHE:
                self._compatible.clear()
            known = self._compatible[key] = self._apart(left, right)
        return known

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix; the longest token that fits is met first."""
        last, known = [-1] * len(data), self._compatible.get
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                if size > end:
                    last[end] = token
                    continue
                left = last[end - size]
                apart = known(left << 32 | token)
                if apart or apart is None and self.compatible(left, token):
                    last[end] = token
        return last

    def walked_back(self, last: list[int]) -> list[int]:
        """The encoding, read from the stored tokens of the prefixes."""
        out, at, names = [], len(last) - 1, self.tokens
        while at >= 0:
            out.append(last[at])
            at -= len(names[out[-1]])
        return out[::-1]

    def _apart(self, left: int, right: int) -> bool:
        tokens, bound = self.tokens, 1 << 40
        while True:
            if self.ranks.get(tokens[left] + tokens[right], 1 << 40) < bound:
                return False
            undo_left, undo_right = len(tokens[left]) > 1, len(tokens[right]) > 1
            if undo_left and (left > right or not undo_right):
                # the crossing merge is to the right of this one and loses a tie
                bound, left = left, self.halves(left)[1]
            elif undo_right:
                bound, right = right + 1, self.halves(right)[0]
            else:
                return True


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, data, vocabulary.last_tokens(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no stored entry changes."""
        done = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        for _ in self._fill(done):
            pass

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]`` by ``new``; the number of recomputed entries.

        An entry depends on the ``longest`` bytes and entries before it, so once that many
        entries in a row agree with the old ones the rest stays as it was.
        """
        old = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.last[:start] + [-1] * (len(new) + len(old))
        behind, same, window = start + len(new), 0, self.vocabulary.longest
        for at, token in self._fill(start):
            if at >= behind:
                same = same + 1 if token == old[at - behind] else 0
                if same >= window:
                    self.last[at + 1:] = old[at + 1 - behind:]
                    return at + 1 - start
        return len(self.last) - start

    def _fill(self, start: int) -> Iterable[tuple[int, int]]:
        """Entries from ``start`` on, each with its position as soon as it is known."""
        last, compatible = self.last, self.vocabulary.compatible
        origin = max(0, start - self.vocabulary.longest)
        text = self.data[origin:].decode("latin-1")
        for end, (token, size) in self.vocabulary.automaton.iter(text):
            end += origin
            if end < start or last[end] >= 0:
                continue
            before = end - size
            if before < 0 or compatible(last[before], token):
                last[end] = token
                yield end, token

    def tokens(self) -> list[int]:
        return self.vocabulary.walked_back(self.last)


class Uncut(Exception):
    """A space of the text is no place to cut."""


class Recent(dict):
    """A cache of two generations: what is met again moves to the young one and stays."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to packed ids (little-endian, unsigned, 32 bits), match by match of a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = Vocabulary.load(path)
        self.matches = regex.compile(pattern).findall
        self.plain = pattern == public_tokenizers.PATTERN
        self.pieces, self.segments = Recent(self._piece), Recent(self._segment)

    @staticmethod
    @lru_cache(2)
    def load(path: str, pattern: str) -> Encoder:
        return Encoder(path, pattern)

    def _piece(self, piece: str) -> bytes:
        data, vocabulary = piece.encode(), self.vocabulary
        rank = vocabulary.ranks.get(data)
        tokens = [rank] if rank is not None else vocabulary.walked_back(vocabulary.last_tokens(data))
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def _segment(self, segment: str) -> bytes:
        """Ids of a space and characters that neither begin nor end with white space."""
        if not segment or segment[0].isspace() or segment[-1].isspace():
            raise Uncut(segment)
        if self.plain and (plain := WORD(segment)):  # a space and letters are one match, so are signs
            word, signs = plain.groups()
            return self.segments[word] + self.pieces[signs] if signs else self._piece(" " + word)
        found = self.matches(" " + segment)
        return self._piece(found[0]) if len(found) == 1 else b"".join(
            map(self.pieces.__getitem__, found))

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.matches(text)))

    def encode(self, text: str) -> bytes:
        segments = text.split(" ")
        first = segments[0]
        if len(segments) == 1 or not first or first[-1].isspace():
            return self.packed(text)
        try:
            return self.packed(first) + b"".join(
                map(self.segments.__getitem__, islice(segments, 1, None)))
        except Uncut:
            return self.packed(text)


def encode(text: Column, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of each text, packed as little-endian unsigned 32-bit integers."""

    @F.arrow_udf(BinaryType())
    def packed_ids(texts: pa.Array) -> pa.Array:
        encoder = Encoder.load(path, pattern)
        return pa.array([encoder.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return packed_ids(text)


def decode(ids: Column, path: str = RANKS) -> Column:
    """The bytes that packed ids stand for; null ids stand for none."""

    @F.arrow_udf(BinaryType())
    def text_bytes(packed: pa.Array) -> pa.Array:
        token = Vocabulary.load(path).tokens.__getitem__
        return pa.array([b"".join(map(token, np.frombuffer(p or b"", "<u4").tolist()))
                         for p in packed.to_pylist()], pa.binary())

    return text_bytes(ids)


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")


def ids_array(ids: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.arrow_udf("array<int>")
    def unpacked(packed: pa.Array) -> pa.Array:
        parts = [np.frombuffer(p or b"", "<u4").astype("i4") for p in packed.to_pylist()]
        offsets = np.cumsum([0, *map(len, parts)]).astype("i4")
        flat = np.concatenate([np.empty(0, "i4"), *parts])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return unpacked(ids)
