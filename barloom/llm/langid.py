"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent 1- to 3-grams over every learned
text, most frequent first.  A text's own list is compared with each profile by the
out-of-place measure: the sum over its n-grams of how far their two ranks are apart,
with a fixed penalty for n-grams that the profile lacks.  The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.kernels import column, ranges, text_slices
from barloom.llm.pretokens import LETTER, classes
from barloom.llm.scratch import on_workers

PROFILE = 300
#: Bytes of text handled at once; n-gram codes take many times the text.
SLICE = 1 << 19
UNDETERMINED = "und"
#: Languages compared in one pass over the texts, whose profiles travel to every task together (10 MB).
AT_ONCE = 2000

_BITS = np.uint64(18)


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    letter = classes() == LETTER
    out = np.where(letter, np.arange(len(letter)), 0).astype(np.int32)
    for cp in np.flatnonzero(letter):
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text in lower case with one 0 before, between and after words; offsets between texts."""
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[pos].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        pad = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        at, top = pos[wide], cp[wide]
        b, c, d = (pad[at + j] & 0x3F for j in (1, 2, 3))
        cp[wide] = np.where(top < 0xE0, (top & 0x1F) << 6 | b, np.where(top < 0xF0, (top & 0x0F) << 12 | b << 6 | c, np.minimum((top & 7) << 18 | b << 12 | c << 6 | d, 0x10FFFF)))
    sym = _lower()[cp]
    heads = np.searchsorted(pos, offsets)
    n = len(offsets) - 1
    sym = np.insert(sym, heads, 0)  # a 0 before each text and one at the very end
    heads = heads + np.arange(n + 1)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[heads] = True
    keep[heads[1:][sym[heads[1:] - 1] == 0] - 1] &= np.isin(heads[1:][sym[heads[1:] - 1] == 0] - 1, heads)
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[heads]


def _grams(sym: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes of the 1-, 2- and 3-grams (the length in the low bits) and each kind's offsets by text."""
    s = np.append(sym, [0, 0]).astype(np.uint64)
    a, b, c = s[:-2], s[1:-1], s[2:]
    nonzero = a != 0
    head = np.zeros(len(sym), bool)
    head[at[:-1][at[:-1] < len(sym)]] = True
    nxt = np.append(head[1:], True)  # the next symbol opens another text: its 0 also closes this one
    found = [
        (nonzero, a << np.uint64(2) | np.uint64(1)),
        ((nonzero | (b != 0)) & ~(nxt & ~nonzero), (a << _BITS | b) << np.uint64(2) | np.uint64(2)),
        ((b != 0) & ~(nxt & ~nonzero), ((a << _BITS | b) << _BITS | c) << np.uint64(2) | np.uint64(3)),
    ]
    codes = [code[ok] for ok, code in found]
    ends = [np.concatenate([[0], np.cumsum(ok)])[at] for ok, _ in found]
    return codes, ends


def _counted(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_codes):
        return sorted_codes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    return sorted_codes[first], np.diff(np.append(first, len(sorted_codes)))


@dataclass(frozen=True)
class Profiles:
    """Sorted languages and, as postings, the n-grams of their profiles.

    The postings of ``codes[i]`` are ``lang`` and ``rank`` from ``at[i]`` up to ``at[i + 1]``.
    """

    languages: list[str]
    codes: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    rank: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """From (language, n-gram code, rank) in any order."""
        languages = sorted({x[0] for x in rows})
        number = {x: i for i, x in enumerate(languages)}
        table = np.array(sorted((code, number[name], rank) for name, code, rank in rows), np.int64).reshape(-1, 3)
        codes, first = np.unique(table[:, 0], return_index=True)
        return cls(languages, codes.astype(np.uint64), np.append(first, len(table)), table[:, 1], table[:, 2])

    def block(self, lo: int, hi: int) -> Profiles:
        """The languages from number ``lo`` up to ``hi``."""
        some = np.flatnonzero((self.lang >= lo) & (self.lang < hi))
        code = np.repeat(self.codes, np.diff(self.at))[some]
        codes, first = np.unique(code, return_index=True)
        return Profiles(self.languages[lo:hi], codes, np.append(first, len(code)), self.lang[some] - lo, self.rank[some])

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """1 - distance / greatest distance of a ranked n-gram list to each language."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        own = np.flatnonzero(self.codes[at] == codes)
        n = self.at[at[own] + 1] - self.at[at[own]]
        rows = ranges(self.at[at[own]], n)
        near = PROFILE - np.abs(self.rank[rows] - np.repeat(own, n))
        return np.bincount(self.lang[rows], near, len(self.languages)) / (PROFILE * len(codes))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of every language in ``df``, from all its rows with a language and a text.

    Counts are summed inside each task first, so a language that holds most rows costs a
    few rows per task.  Ties in a profile go to the smaller n-gram code.
    """
    on_workers(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            codes, ends = _grams(*_symbols(data, offsets))
            names = np.array(column(rows, "lang").to_pylist(), object)
            for name in set(names):
                mine = names == name
                picked = [c[np.repeat(mine, np.diff(e))] for c, e in zip(codes, ends, strict=True)]
                new = _counted(np.sort(np.concatenate(picked)))
                if name in held:
                    both, sums = np.concatenate([held[name][0], new[0]]), np.concatenate([held[name][1], new[1]])
                    order = np.argsort(both, kind="stable")
                    both, sums = both[order], sums[order]
                    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                    new = both[first], np.add.reduceat(sums, first)
                if len(new[0]):
                    held[name] = new
        for name, (c, m) in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(c), pa.string()), "code": pa.array(c.view(np.int64)), "m": pa.array(m, pa.int64())})

    slim = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    totals = slim.mapInArrow(count, "lang string, code long, m long").groupBy("lang", "code").agg(F.sum("m").alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("m"), "code")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    return Profiles.build([(r.lang, r.code, r.rank - 1) for r in top.select("lang", "code", "rank").toLocalIterator()])


def predict(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", out: str = "score", declared: str | None = None, declared_out: str = "declared_score") -> DataFrame:
    """Add ``lang`` (string) and ``out`` (double, 0 to 1) to every row.

    ``und`` with score 0 when the text is null, has no letter, or nothing was learned.
    Equal distances go to the language that sorts first.  With ``declared``, a string
    column, ``declared_out`` is the score of the language it names (null if it is null or
    was not learned).  Columns already called like the added ones are replaced; every
    other column and every repeated row is kept.  One pass over the texts compares
    AT_ONCE languages.
    """
    on_workers(df.sparkSession)
    added = [T.StructField(lang, T.StringType()), T.StructField(out, T.DoubleType())] + [T.StructField(declared_out, T.DoubleType())] * (declared is not None)
    names = [f.name for f in added]
    for first in range(0, max(1, len(profiles.languages)), AT_ONCE):
        kept = [f for f in df.schema.fields if f.name not in names]
        shipped = df.sparkSession.sparkContext.broadcast(profiles.block(first, first + AT_ONCE))

        def run(batches: Iterator[pa.RecordBatch], first=first, kept=kept, shipped=shipped) -> Iterator[pa.RecordBatch]:
            known = shipped.value
            number = {x: i for i, x in enumerate(known.languages)}
            for rows, data, offsets in text_slices(batches, text, SLICE):
                codes, ends = _grams(*_symbols(data, offsets))
                n = len(offsets) - 1
                best, score = ([UNDETERMINED] * n, [0.0] * n) if not first else (column(rows, c).to_pylist() for c in names[:2])
                said = column(rows, declared).to_pylist() if declared else []
                own_score = [None] * n if not first or not declared else column(rows, declared_out).to_pylist()
                for i in range(n if known.languages else 0):
                    own, m = _counted(np.sort(np.concatenate([c[e[i] : e[i + 1]] for c, e in zip(codes, ends, strict=True)])))
                    if not len(own):
                        continue
                    scores = known.scores(own[np.argsort(-m, kind="stable")[:PROFILE]])
                    top = int(scores.argmax())
                    if best[i] == UNDETERMINED or scores[top] > score[i]:
                        best[i], score[i] = known.languages[top], float(scores[top])
                    if declared and said[i] in number:
                        own_score[i] = float(scores[number[said[i]]])
                more = [pa.array(best, pa.string()), pa.array(score, pa.float64())] + [pa.array(own_score, pa.float64())] * (declared is not None)
                yield pa.RecordBatch.from_arrays([*(column(rows, f.name) for f in kept), *more], [*(f.name for f in kept), *names])

        df = df.mapInArrow(run, T.StructType([*kept, *added]))
    return df


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key, which is in no fold."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def in_fold(number: int, key: str = "doc_id", folds: int = 5) -> Column:
    """Whether the key is in that fold; false for a null key."""
    return F.coalesce(fold(key, folds) == number, F.lit(False))
