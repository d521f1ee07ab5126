"""Vectorised split of UTF-8 texts by the common byte-level BPE pattern.

The pattern (fixed value) is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Matches are found from runs of character classes over a whole slice at once, so a
slice costs a few array passes and no call per match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from barloom.llm.kernels import ranges, span_hash

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    number = lambda i: i if i < 0xD800 else i + 0x800
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(name, every):
            table[number(m.start()) : number(m.end() - 1) + 1] = kind
    table[WHITE_SPACE] = SPACE
    return table


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions, lead bytes and classes of the characters of valid UTF-8."""
    table = classes()
    if not (data & 0x80).any():
        return np.arange(len(data)), data, table[:128][data]
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[pos]
    kind = table[:256][lead]
    wide = np.flatnonzero(lead >= 0xC0)
    at, top = pos[wide], lead[wide].astype(np.int32)
    pad = np.append(data, np.zeros(3, np.uint8)).astype(np.uint8)
    b, c, d = (pad[at + j].astype(np.int32) & 0x3F for j in (1, 2, 3))
    two = (top & 0x1F) << 6 | b
    three = (top & 0x0F) << 12 | b << 6 | c
    four = (top & 0x07) << 18 | b << 12 | c << 6 | d
    kind[wide] = table[np.where(top < 0xE0, two, np.where(top < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    return pos, lead, kind


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and lengths of the matches, in order; they cover every text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, lead, kind = characters(data)
    n = len(pos)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(pos, offsets)] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after] = lead[after - 1] != 0x20
    quote = np.flatnonzero((lead == 0x27) & start)
    if len(quote):
        last = np.append(np.flatnonzero(first)[1:], n)
        stop = last[np.searchsorted(np.flatnonzero(first), quote, "right") - 1]
        pad = np.append(lead, np.zeros(2, np.uint8))
        a, b = np.where(quote + 1 < stop, pad[quote + 1], 0), np.where(quote + 2 < stop, pad[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        grown = np.append(start, [True] * 4)
        for at, size in ((quote[one], 2), (quote[two], 3)):
            for j in range(1, size):
                grown[at + j] = False
            grown[at + size] = True
        start = grown[:n]
        start |= first
    begin = pos[np.flatnonzero(start)]
    return begin, np.diff(np.append(begin, len(data)))


class PieceCache:
    """Token ids of pieces, encoded once each; whole slices come out as flat arrays.

    ``encode`` turns a list of distinct pieces (bytes) into lists of ids.  Pieces are
    known by two 64-bit hashes, kept in arrays sorted by the first.  The cache is
    emptied when it holds ``limit`` pieces, which bounds memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.proof = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _store(self, got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, got), np.int32, len(got))
        total = int(count.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + total, 2 * len(self.flat)))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.int32, total)
        at = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += total
        return at, count

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the offsets between its texts."""
        import pandas as pd  # here, since workers that only ask for classes would hold it too

        begin, size = split(data, offsets)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        codes, first = pd.factorize(span_hash(data, begin, size))
        where = np.empty(len(first), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        lo, hi = begin[where], size[where]
        second = span_hash(data, lo, hi, seed=1)
        if len(self.known) + len(first) > self.limit:
            self._clear()
        slot = np.searchsorted(self.known, first)
        near = np.minimum(slot, max(0, len(self.known) - 1))
        same = self.known[near] == first if len(self.known) else np.zeros(len(first), bool)
        hit = same & (self.proof[near] == second) if len(self.known) else same
        at, count = np.empty(len(first), np.int64), np.empty(len(first), np.int32)
        if len(self.known):
            at[hit], count[hit] = self.at[near[hit]], self.count[near[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            raw = data.tobytes()
            at[miss], count[miss] = self._store(self.encode([raw[a:b] for a, b in zip(lo[miss].tolist(), (lo + hi)[miss].tolist(), strict=True)]))
            new = miss[~same[miss]]
            new = new[np.argsort(first[new])]
            for name, values in (("at", at), ("count", count), ("proof", second), ("known", first)):
                setattr(self, name, np.insert(getattr(self, name), slot[new], values[new]))
        n_ids = count[codes]
        ends = np.concatenate([[0], np.cumsum(n_ids, dtype=np.int64)])
        return self.flat[ranges(at[codes], n_ids)], ends[np.searchsorted(begin, offsets)]
