"""Splitting texts by a tokenizer's pattern, and looking up pieces that come again."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import regex

_PARTS = regex.compile(r"\\p\{\w+\}|\\.|\[|\]|.", regex.S)


class Splitter:
    """``findall`` of a pattern with Unicode classes.

    Texts of Latin-1 characters only go through a pattern in which the classes are written
    out for these 256 characters; it matches the same and is faster.
    """

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern).findall
        self._latin = re.compile(self._written_out(pattern)).findall

    @staticmethod
    def _written_out(pattern: str) -> str:
        latin, parts, inside = "".join(map(chr, range(256))), [], False
        for part in _PARTS.findall(pattern):
            if part in "[]":
                inside = part == "["
            elif part.startswith(r"\p") or part in (r"\s", r"\S"):
                if part == r"\S" and inside:
                    raise ValueError(r"\S in brackets is not supported")
                members = "".join(f"\\x{ord(c):02x}" for c in regex.findall(part.lower() if part == r"\S" else part, latin))
                part = members if inside else f"[{'^' * (part == chr(92) + 'S')}{members}]"
            parts.append(part)
        return "".join(parts)

    def findall(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._any(text)
        return self._latin(text)


class PieceTable:
    """Encodes texts piece by piece; encodings are kept up to a number of pieces and a length.

    ``encode_piece`` gives the bytes of one piece's ids; with ``in_order`` it is called in
    the order of the pieces, so that neighbours share beginnings. Kept pieces are of two generations: when the
    young one holds half of all entries it becomes the old one, and what is not asked for
    again until the next time is forgotten.
    """

    #: Characters of the texts that are looked up together.
    AT_ONCE = 1 << 18

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], entries: int, chars: int, in_order: bool = False):
        self.in_order = in_order
        self.split, self.encode_piece = Splitter(pattern).findall, encode_piece
        self.entries, self.chars = entries, chars
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of every text; none for null."""
        encoded, waiting, size = [], [], 0
        for text in texts:
            waiting.append(text or "")
            size += len(waiting[-1])
            if size >= self.AT_ONCE:
                encoded += self._together(waiting)
                waiting, size = [], 0
        return encoded + self._together(waiting)

    def _together(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.entries // 2:
            self.known, self.old = {}, self.known
        known, old, pieces = self.known, self.old, [self.split(text) for text in texts]
        new = set().union(*pieces).difference(known)
        for piece in sorted(new) if self.in_order else new:
            known[piece] = old.get(piece) or self.encode_piece(piece)
        encoded = [b"".join(map(known.__getitem__, some)) for some in pieces]
        for piece in new:
            if len(piece) > self.chars:
                del known[piece]
        return encoded


@functools.cache
def byte_characters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
