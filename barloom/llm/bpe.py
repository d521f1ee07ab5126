"""Byte-level BPE encoding and decoding with an Aho-Corasick matcher.

Bytes are mapped to Latin-1 so that the matcher works on strings.  A piece is
encoded by taking the longest vocabulary entry at the current position, testing it
against the entry before it, and stepping back to shorter entries when the two could
not stand side by side in the merge result.  Whether two entries are compatible
depends on the pair alone, so the answers are memoised; each position is ruled out
at most once, which keeps the work linear in the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.kernels import column, ranges, text_slices
from barloom.llm.pretokens import PieceCache
from barloom.llm.scratch import on_workers


class BytePairs:
    """Exact merges of a rank file (``base64 rank`` lines, every byte included)."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 1 << 17):
        import ahocorasick

        self.ranks, self.memo_limit = ranks, memo
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.length = [len(x) for x in self.bytes_of]
        self.shorter = [-1] * size
        self.parts = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.matcher = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self.matcher.add_word(piece.decode("latin-1"), (len(piece) - 1, rank))
        self.matcher.make_automaton()
        for rank in sorted(ranks.values()):
            self._learn(rank)
        self.memo.clear()

    def _learn(self, rank: int) -> None:
        """The longest shorter entry that begins this one, and the pair that makes it."""
        piece, found = self.bytes_of[rank], False
        for cut in range(len(piece) - 1, 0, -1):
            left = self.ranks.get(piece[:cut], -1)
            if left < 0:
                continue
            if self.shorter[rank] < 0:
                self.shorter[rank] = left
            right = self.ranks.get(piece[cut:], -1)
            if not found and 0 <= right < rank and left < rank and self._adjacent(left, right):
                self.joined[left, right] = rank
                self.parts[rank] = (left, right)
                found = True

    def _adjacent(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the seam, newest first, looking for one that crosses it sooner."""
        limit = len(self.bytes_of)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            undo_left = left > right
            for side in (undo_left, not undo_left):
                if side:
                    inner = self.parts[left][1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.parts[right][0]
                    if inner != right:
                        limit, right = right + 1, inner
                        break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (back, rank) in self.matcher.iter(piece.decode("latin-1")):
            longest[end - back] = rank
        length, shorter, memo, adjacent = self.length, self.shorter, self.memo, self._adjacent
        if len(memo) > self.memo_limit:
            memo.clear()
        closed: set[int] = set()
        out: list[int] = []
        last, pos, token = -1, 0, longest[0]
        while True:
            end = pos + length[token]
            if end in closed:
                fits = False
            elif last < 0:
                fits = True
            else:
                key = last << 32 | token
                fits = memo.get(key)
                if fits is None:
                    fits = memo[key] = adjacent(last, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                last, pos, token = token, end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode_piece(p) for p in pieces]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(piece): int(rank) for piece, rank in pairs}


_LOADED: dict[str, tuple[BytePairs, PieceCache]] = {}


def _loaded(key: str, raw: bytes) -> tuple[BytePairs, PieceCache]:
    if key not in _LOADED:
        pairs = BytePairs(read_ranks(raw))
        _LOADED.clear()
        _LOADED[key] = pairs, PieceCache(pairs.encode)
    return _LOADED[key]


@lru_cache(2)
def _flat_bytes(key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = _LOADED[key][0].bytes_of
    size = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size


def _ship(df: DataFrame, vocabulary: str) -> tuple[str, object]:
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a rank file over 64 MB is not shipped to workers")
    on_workers(df.sparkSession)
    return hashlib.sha256(raw).hexdigest(), df.sparkSession.sparkContext.broadcast(raw)


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[str]]:
    kept = [f for f in df.schema.fields if f.name != name]
    return T.StructType([*kept, T.StructField(name, kind)]), [f.name for f in kept]


#: Bytes of text encoded at once.
SLICE = 1 << 20


def _id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def _decoded(key: str, numbers: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes of each run of ids; -1 stands for a null id and gives none."""
    flat, start, size = _flat_bytes(key)
    if len(numbers) and (numbers.max() >= len(size) or numbers.min() < -1):
        raise ValueError("a token id is outside the vocabulary")
    real = np.maximum(numbers, 0)
    lens = np.where(numbers >= 0, size[real], 0) if len(numbers) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lens)])[at]
    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat[ranges(start[real], lens)].tobytes())])
    return blob.cast(pa.binary())


def _kept(rows: pa.RecordBatch, kept: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(column(rows, c) for c in kept), *more.values()], [*kept, *more])


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids (array<int>) of each whole text.

    ``vocabulary`` is the path of a rank file on the driver.  A null or empty text
    gives an empty array.  Every other column is kept; a column already called
    ``out`` is replaced.  Rows are independent: repeated rows give repeated results
    and an empty table an empty one.
    """
    key, shipped = _ship(df, vocabulary)
    schema, kept = _with(df, out, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _loaded(key, shipped.value)
        for rows, data, offsets in text_slices(batches, text, SLICE):
            yield _kept(rows, kept, {out: _id_lists(*cache.ids(data, offsets))})

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) that each array of token ids stands for.

    A null or empty array gives empty bytes; null ids are skipped; an id outside the
    vocabulary raises ValueError.
    """
    key, shipped = _ship(df, vocabulary)
    schema, kept = _with(df, out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded(key, shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                col = column(rows, ids)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
                numbers = np.asarray(pa.compute.fill_null(pa.compute.list_flatten(col), -1)).astype(np.int64)
                yield _kept(rows, kept, {out: _decoded(key, numbers, np.concatenate([[0], np.cumsum(sizes)]))})

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass, so that a task needs one worker and ids move once."""
    key, shipped = _ship(df, vocabulary)
    schema, kept = _with(df, ids, T.ArrayType(T.IntegerType(), False))
    schema, kept = T.StructType([*(f for f in schema.fields if f.name != out), T.StructField(out, T.BinaryType())]), [c for c in kept if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _loaded(key, shipped.value)
        for rows, data, offsets in text_slices(batches, text, SLICE):
            numbers, at = cache.ids(data, offsets)
            yield _kept(rows, kept, {ids: _id_lists(numbers, at), out: _decoded(key, numbers.astype(np.int64), at)})

    return df.mapInArrow(run, schema)
