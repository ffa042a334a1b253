"""Byte-level BPE by prefix dynamic programming, and decoding.

For every prefix of a byte string exactly one token can be the last of its encoding: the
one suffix token that is compatible with the last token of the prefix before it. A table of
these last tokens is filled from left to right; the encoding is read off it backwards.

The table makes changes cheap. Appended bytes only add entries. After an edit, entries are
filled anew from the edit on, until as many in a row as the longest token has bytes agree
with the old ones; all later ones then agree as well.

Two neighbouring tokens are compatible if merging in rank order would never join something
across their border. Along the border the left token grows through the chain of its right
parts, the right token through that of its left parts; the check looks whether any two
pieces that stand there at the same time have a merge that comes first.

A text is cut by a pattern, and each match is encoded by itself. As words repeat, encoded
pieces are kept in a bounded table of the Python worker.

Defined cases: null is the empty text; its encoding is empty. Texts of any length are
encoded whole; the table of a piece takes one integer per byte. Special tokens are ordinary
text. Rows are independent, so repeated rows get equal results; an empty table gives no
rows. Other columns stay untouched.
"""

from __future__ import annotations

import array
import base64
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from classatlas.llm.pieces import PieceTable

#: Entries of the tables of encoded pieces and of compatible pairs, and characters of the longest piece kept.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 48


class Vocabulary:
    """Tokens with ranks; a token's rank is its id, and merges happen in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: every end of a token, with its rank if it is a token itself, else -1
        self.suffixes = {t[k:]: -1 for t in ranks for k in range(len(t))} | ranks
        self._chains: dict[tuple[int, bool], tuple[tuple[int, int], ...]] = {}
        self._compatible: dict[int, bool] = {}

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)})

    def born(self, token: int) -> int:
        """When merging makes the token; single bytes are there from the start."""
        return token if len(self.tokens[token]) > 1 else -1

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge inside this token joins."""
        whole = self.tokens[token]
        for cut in range(1, len(whole)):
            left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
            if left is not None and right is not None and max(self.born(left), self.born(right)) < token:
                if self._border_holds(left, right, token):
                    return left, right
        raise ValueError(f"no merge makes token {token}")

    def chain(self, token: int, at_right: bool) -> tuple[int, ...]:
        """The parts that touch the right (or left) border, from the whole token down to a byte."""
        key = (token, at_right)
        if key not in self._chains:
            inner = self.chain(self.parts(token)[at_right], at_right) if self.born(token) >= 0 else ()
            self._chains[key] = (token, *inner)
        return self._chains[key]

    def _border_holds(self, left: int, right: int, until: float) -> bool:
        """Whether no merge across the border of the two happens before ``until``."""
        lefts, rights = self.chain(left, True), self.chain(right, False)
        i = j = 0
        left_end = right_end = until  # when a piece becomes part of the next larger one
        while True:
            a, b = lefts[i], rights[j]
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            # of merges with equal rank the leftmost is done first
            if joined is not None and joined < left_end and joined <= right_end:
                return False
            a_born, b_born = self.born(a), self.born(b)
            if a_born < 0 and b_born < 0:
                return True
            if b_born >= a_born:
                j, right_end = j + 1, b_born
            else:
                i, left_end = i + 1, a_born

    def compatible(self, left: int, right: int) -> bool:
        known = self._compatible.get(left << 32 | right)
        if known is None:
            if len(self._compatible) > CACHE_ENTRIES // 2:
                self._compatible.clear()
            known = self._compatible[left << 32 | right] = self._border_holds(left, right, float("inf"))
        return known


class PrefixTable:
    """A byte string with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        at, self.data = len(self.data), self.data + more
        for _ in self._filled(at + 1, self.last):
            pass

    def become(self, data: bytes) -> None:
        """Take other bytes; the entries of a common beginning are kept."""
        same = 0
        for same, (old, new) in enumerate(zip(self.data, data)):
            if old != new:
                break
        else:
            same = min(len(self.data), len(data))
        del self.last[same:]
        self.data = data
        for _ in self._filled(same + 1, self.last):
            pass

    def replace(self, start: int, stop: int, by: bytes) -> None:
        """Exchange the bytes from ``start`` to ``stop``; only entries near the edit are filled anew."""
        old, after = self.last, start + len(by)
        shift = after - stop
        self.data = self.data[:start] + by + self.data[stop:]
        last, agree = old[:start], 0
        for end in self._filled(start + 1, last):
            # from here on the same bytes stand behind the same entries as before
            agree = agree + 1 if end > after and last[-1] == old[end - shift - 1] else 0
            if agree >= self.vocabulary.longest:
                last += old[end - shift:]
                break
        self.last = last

    def _filled(self, first: int, last: list[int]) -> Iterator[int]:
        """Adds to ``last`` the entries of the prefixes from length ``first`` on; yields each length done."""
        data, suffix, known = self.data, self.vocabulary.suffixes.get, self.vocabulary._compatible.get
        for end in range(first, len(data) + 1):
            start, starts, tokens = end - 1, [], []
            rank = suffix(data[start:end])
            while rank is not None:
                if rank >= 0:
                    starts.append(start)
                    tokens.append(rank)
                start -= 1
                if start < 0:
                    break
                rank = suffix(data[start:end])
            while starts:  # longest first
                start, token = starts.pop(), tokens.pop()
                if start == 0:
                    break
                before = last[start - 1]
                fits = known(before << 32 | token)
                if fits or fits is None and self.vocabulary.compatible(before, token):
                    break
            else:
                raise ValueError("a byte of the text is not in the vocabulary")
            last.append(token)
            yield end

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            found.append(token)
            end -= len(self.vocabulary.tokens[token])
        return found[::-1]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> PieceTable:
    """Encodes texts to little-endian unsigned 32-bit ids by a file of ranks."""
    table = PrefixTable(Vocabulary.load(path))

    def encode_piece(piece: str) -> bytes:
        table.become(piece.encode())
        ids = array.array("I", table.tokens())
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return PieceTable(pattern, encode_piece, CACHE_ENTRIES, CACHE_CHARS, in_order=True)


class Decoder:
    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str) -> list[bytes]:
        tokens = Vocabulary.load(path).tokens
        return [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]


def _joined(tokens: list[bytes], ids: bytes | None) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text as binary: little-endian unsigned 32-bit integers."""

    @pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = encoder(path, pattern)
        for texts in batches:
            yield pd.Series(table.encode_all(texts), dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that the ids of :func:`encoded` stand for."""

    @pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Decoder.load(path)
        for rows in batches:
            yield pd.Series([_joined(tokens, r) for r in rows], dtype=object)

    return decode(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct of the ids of each text and the bytes that they decode to.

    One function for both, so that a task needs one Python worker with one vocabulary.
    """

    @pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, tokens = encoder(path, pattern), Decoder.load(path)
        for texts in batches:
            ids = table.encode_all(texts)
            yield pd.DataFrame({"ids": ids, "decoded": [_joined(tokens, r) for r in ids]})

    return both(text)
