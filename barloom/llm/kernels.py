"""Vectorised byte kernels shared by the text operators.

Every kernel works on one slice of an Arrow batch: the UTF-8 bytes of some whole
texts laid end to end, and the offsets between them.  Slices hold a few megabytes
(or one text, if that is longer), so memory does not depend on the input.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

#: ASCII white space: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_S31, _S29, _S32 = np.uint64(31), np.uint64(29), np.uint64(32)
_LONG = 4096


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> _S31)


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system, so that a worker holds little between batches."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets); null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, "")
        col = col.cast(pa.large_binary())
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            hi = min(hi, len(col))
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
        del batch, col, at, raw
        give_back()


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~IS_SPACE[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; spans up to 8 bytes of one length never collide."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    h = lens.astype(np.uint64) * _M1 + np.uint64(seed)
    long = np.flatnonzero(lens > _LONG)
    todo, pos, rest = None, starts, np.where(lens > _LONG, 0, lens) if len(long) else lens
    h = mix64((h ^ (lanes[pos] & _MASK[np.minimum(rest, 8)])) * _M1)
    while True:
        left = np.flatnonzero(rest > 8)
        if not len(left):
            break
        todo = left if todo is None else todo[left]
        pos, rest = pos[left] + 8, rest[left] - 8
        h[todo] = mix64((h[todo] ^ (lanes[pos] & _MASK[np.minimum(rest, 8)])) * _M1)
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lens[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + len) for each pair."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep].astype(np.int64), lens[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    heads = np.cumsum(lens)[:-1]
    step[0] = starts[0]
    step[heads] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(step)


def per_text(numbers: np.ndarray, n_texts: int) -> np.ndarray:
    """Offsets of each text's run in a list ordered by text number."""
    return np.searchsorted(numbers, np.arange(n_texts + 1), "left")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text (lower-cased A-Z).

    Returns the hashes, ascending inside each text, and the offsets between texts.
    A text with fewer than k words gives its whole word sequence as one shingle; a
    text without words gives none.
    """
    low = LOWER[data]
    starts, lens, doc = spans_of_words(low, offsets)
    n = len(offsets) - 1
    words = span_hash(low, starts, lens)
    at = per_text(doc, n)
    count = np.diff(at)
    full = max(0, len(words) - k + 1)
    h = np.full(full, k, np.uint64)
    for j in range(k):
        h = mix64((h ^ words[j : j + full]) * _M1)
    same = doc[:full] == doc[k - 1 : k - 1 + full] if full else np.zeros(0, bool)
    h, owner = h[same], doc[:full][same]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            x = np.full(1, count[t], np.uint64)
            for w in words[at[t] : at[t + 1]]:
                x = mix64((x ^ w) * _M1)
            extra[i] = x[0]
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    at = per_text(owner, n)
    out, sizes = [], np.zeros(n, np.int64)
    for t in range(n):
        part = np.sort(h[at[t] : at[t + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        sizes[t] = len(part)
        out.append(part)
    return (np.concatenate(out) if out else h), np.concatenate([[0], np.cumsum(sizes)])
