"""Benchmark decontamination by embedding edit distance into Hamming distance.

Texts are reduced to lower-case letters and digits with single blanks.  A random walk
reads a window of an item's size: at every step it emits the symbol under the pointer, and
a random bit chosen by step and symbol says whether the pointer moves on (the CGK
embedding; here no symbol holds the pointer over two steps).  Two windows a few edits
apart emit sequences that differ in few places, so samples of the places, hashed, often
agree.  Edits put the walks out of step sooner or later, and therefore the samples lie in
the first steps, and every place of a text and of an item begins a window: an item holds
as many windows as symbols, of which one must agree.  How many steps a sample spans
follows from item length and similarity: as many as k random edits leave whole for one
window at least with probability RECALL.  WALKS independent walks repeat this.

Samples are taken while walking: windows whose first steps begin no window of any item
are dropped at once.  An agreement puts the item at a place of the text.  The place is
kept if the text there has enough runs of five symbols of the item (what k edits at random
leave, less four standard deviations), and if up to 64 symbols of the item around the
window's begin are within the edits expected of them (bit-parallel edit distance of many
places at once).  Kept places are verified by exact approximate matching of the whole
item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.kernels import column, mix64, ranges, text_slices
from barloom.llm.langid import _lower
from barloom.llm.pretokens import NUMBER, classes
from barloom.llm.scratch import on_workers

#: Shorter items (in symbols) match exactly: on word boundaries, and under WHOLE symbols only a whole text.
SHORTEST, WHOLE = 16, 8
#: Share of items with random edits at the similarity asked for that one walk must find.
RECALL = 0.9
#: Independent walks, the share of the steps that a sample holds, and the most steps.
WALKS, SHARE, LONGEST = 2, 0.8, 24
#: Symbols of the runs that are counted, and bits of their hashes.
RUN, _RUN_BITS = 5, 13
#: Windows walked, and places places handled at once; bounds memory.
_BLOCK, _AT_ONCE, _PART = 1 << 15, 1 << 16, 1 << 13
#: Step after which windows are dropped at the earliest.
_EARLY = 8
#: Bytes of text handled at once.
SLICE = 1 << 20
#: Benchmark symbols handled in one pass over the texts; bounds what is broadcast.
PASS_SYMBOLS = 1 << 20
BLANK = 32


@lru_cache(1)
def _symbols() -> np.ndarray:
    """A byte for every code point: letters in lower case and digits, hashed above ASCII, else BLANK."""
    out = _lower().copy()
    digits = np.flatnonzero(classes() == NUMBER)
    out[digits] = digits
    return np.where(out == 0, BLANK, np.where(out < 128, out, 128 + (out * 40503 >> 7) % 128)).astype(np.uint8)


def reduce_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts, the offsets between texts, and each symbol's character number in its text."""
    pos = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[pos]
    sym = _symbols()[:128][np.minimum(lead, 127)]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        pad = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        at, top = pos[wide], lead[wide].astype(np.int32)
        b, c, d = (pad[at + j] & 0x3F for j in (1, 2, 3))
        sym[wide] = _symbols()[np.where(top < 0xE0, (top & 0x1F) << 6 | b, np.where(top < 0xF0, (top & 0x0F) << 12 | b << 6 | c, np.minimum((top & 7) << 18 | b << 12 | c << 6 | d, 0x10FFFF)))]
    heads = np.searchsorted(pos, offsets)
    first = np.zeros(len(sym) + 1, bool)
    first[heads] = True
    blank = sym == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~first[1:-1]  # the first blank after a symbol of the same text
    at = np.concatenate([[0], np.cumsum(keep)])[heads]
    where = np.flatnonzero(keep)
    return sym[keep], at, where - np.repeat(heads[:-1], np.diff(at))


def allowed_edits(m: int, similarity: float) -> int:
    return int(m * (1 - similarity) + 1e-9)


def sample_steps(m: int, similarity: float) -> int:
    """Steps that the samples of an item of m symbols span."""
    gaps = allowed_edits(m, similarity) + 1
    alive = 1 - (1 - RECALL) ** (1 / gaps)
    # A step reads a new symbol, and a symbol is read for one step (2/3) or two.
    whole = [1.0, similarity]
    while len(whole) <= min(m, LONGEST):
        whole.append(similarity * (2 * whole[-1] + whole[-2]) / 3)
    longest = max(1, min(m // gaps, LONGEST), *(t for t in range(len(whole)) if whole[t] >= alive))
    return max(2, longest // 2 * 2)


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """Symbols as 64 codes: letters, digits and the blank apart, the others hashed."""
    known = [*range(97, 123), *range(48, 58), BLANK]
    out = len(known) + np.arange(256) % (64 - len(known))
    out[known] = range(len(known))
    return out


@lru_cache(16)
def _walk(walk: int) -> np.ndarray:
    """For every two steps and every two symbols from the pointer on: how far it moves (two bits), and a hash of what is sampled."""
    rng = np.random.default_rng([walk, 1])
    moves, sampled = np.ones((LONGEST, 64), np.int64), rng.random(LONGEST) < SHARE
    for j in range(LONGEST):
        moves[j] = rng.integers(0, 2, 64)
        if j:
            moves[j][moves[j - 1] == 0] = 1
    sampled[0] = True
    random = rng.integers(-(1 << 60), 1 << 60, (LONGEST, 64)) * 4 * sampled[:, None]
    a, b = np.divmod(np.arange(64 * 64), 64)
    out = []
    for j in range(0, LONGEST, 2):
        second = np.where(moves[j][a], b, a)
        out.append(random[j][a] + random[j + 1][second] + moves[j][a] + moves[j + 1][second])
    return np.array(out)


def _twos(symbols: np.ndarray) -> np.ndarray:
    """The two symbols from each place on, as one number; goes on for LONGEST places."""
    codes = np.pad(_alphabet()[symbols], (0, LONGEST + 1))
    return codes[:-1] * 64 + codes[1:]


def _samples(twos: np.ndarray, at: np.ndarray, walk: int, stops: list[int], keep: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """After the steps of each stop: the stop, the windows, where their pointers stand, their sample hashes, and what ``keep`` says of them.

    Windows of which ``keep`` says 0 by their hashes are dropped.
    """
    pointer, h, says = at.copy(), np.zeros(len(at), np.int64), None
    for j, table in enumerate(_walk(walk)[: stops[-1] // 2]):
        step = table.take(twos.take(pointer))
        h += step
        step &= 3
        pointer += step
        if 2 * j + 2 in stops:
            if keep is not None:
                says = keep(2 * j + 2, h)
                left = np.flatnonzero(says)
                at, pointer, h, says = at[left], pointer[left], h[left], says[left]
            yield 2 * j + 2, at, pointer, h, says


def fewest_runs(m: int, similarity: float) -> int:
    """Runs of RUN symbols that an item of m symbols keeps in a text that holds it."""
    n, s, keep = m - RUN + 1, similarity, similarity**RUN
    spread = keep * (1 - keep) + 2 * sum(s ** (RUN + j) - keep**2 for j in range(1, RUN)) - (RUN * s ** (RUN - 1)) ** 2 * s * (1 - s)
    return max(0, n - RUN * allowed_edits(m, s), int(n * keep - 4 * math.sqrt(max(0.0, spread) * max(0, n))))


def _hashes(symbols: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length and the hashes of the runs of so many symbols from each place."""
    h = np.zeros(len(symbols), np.uint64)
    for q in range(1, min(longest, len(symbols)) + 1):
        h = h[: len(symbols) - q + 1] * np.uint64(0x9E3779B97F4A7C15)
        h += symbols[q - 1 :]
        h += np.uint64(1)
        yield q, h


def _run_codes(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> np.uint64(64 - _RUN_BITS)).astype(np.int32)


def _filter(h: np.ndarray, bits: int) -> np.ndarray:
    return h.view(np.uint64) >> np.uint64(64 - bits)


@dataclass
class Items:
    """Benchmark items as symbols, by walk the sorted samples of each span and filters of their first steps, and the runs of each item."""

    ids: list[int]
    symbols: list[bytes]
    similarity: float
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: By hash: 1 if some sample goes on from here, 2 more if one ends here.
    filters: dict[tuple[int, int], np.ndarray]
    stops: list[int]
    runs: np.ndarray
    flat: np.ndarray
    base: np.ndarray
    size: np.ndarray
    fewest: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def around(self) -> int:
        """Symbols by which places may reach out of the texts."""
        return 2 * int(self.size.max()) + 64

    @classmethod
    def build(cls, ids: list[int], symbols: list[bytes], similarity: float = 0.8) -> Items:
        size = np.array([len(s) for s in symbols], np.int64)
        base = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        flat = np.frombuffer(b"".join(symbols), np.uint8)
        steps = np.array([sample_steps(m, similarity) for m in size.tolist()])
        steps[size < SHORTEST] = 0
        short = {}
        runs = np.zeros((len(ids), 1 << _RUN_BITS), bool)
        for q, h in _hashes(flat, SHORTEST):
            if q < SHORTEST and (size == q).any():
                own = np.flatnonzero(size == q)
                seeds = mix64(h[base[own]])
                order = np.argsort(seeds, kind="stable")
                short[q] = seeds[order], own[order]
            if q == RUN:
                n = np.maximum(0, size - RUN + 1)
                runs[np.repeat(np.arange(len(ids)), n), _run_codes(h)[ranges(base, n)]] = True
        stops = sorted({*steps[steps > 0].tolist()})
        stops = sorted({*stops, *range(_EARLY, stops[0] if stops else 0, 2)})
        tables, filters = {}, {}
        own = np.flatnonzero(steps)
        start, item = ranges(base[own], size[own]), np.repeat(own, size[own])
        bits = min(24, max(16, int(len(start) * 8).bit_length()))
        twos = _twos(flat)
        for walk in range(WALKS) if len(own) else ():
            for t, at, pointer, h, _ in _samples(twos, start, walk, stops):
                inside = pointer <= (base + size)[item]
                mine = np.flatnonzero(inside & (steps[item] == t))
                order = mine[np.argsort(h[mine], kind="stable")]
                tables[walk, t] = h[order], item[order], (at - base[item])[order]
                filters[walk, t] = np.zeros(1 << bits, np.uint8)
                filters[walk, t][_filter(h[inside & (steps[item] >= t)], bits)] = 1
                filters[walk, t][_filter(h[mine], bits)] = 3
        fewest = np.array([fewest_runs(m, similarity) for m in size.tolist()])
        return cls(ids, symbols, similarity, tables, filters, stops, runs, flat, base, size, fewest, short)


def _enough_runs(items: Items, codes: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the text from each place has enough runs of the item."""
    order = np.argsort(-items.size[item], kind="stable")
    item, place = item[order], place[order]
    n = items.size[item] - RUN + 1
    count = np.zeros(len(item), np.int32)
    table, first = items.runs.ravel(), item << _RUN_BITS
    begin = place + items.around
    left = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
    for j, k in enumerate(left.tolist()):
        count[:k] += table[first[:k] + codes[begin[:k] + j]]
    out = np.empty(len(item), bool)
    out[order] = count >= items.fewest[item]
    return out


def _alike(items: Items, padded: np.ndarray, item: np.ndarray, seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether up to 64 symbols of the item around the seed are close to the text there."""
    s, size = items.similarity, items.size[item]
    m = np.minimum(64, size)
    a = np.clip((seed - 16) // 32 * 32, 0, size - m)
    edits = np.minimum(np.ceil(m * (1 - s) + 3 * np.sqrt(m * s * (1 - s))), np.floor(size * (1 - s) + 1e-9)).astype(np.int64)
    pieces, which = np.unique(np.stack([item, a, m]), axis=1, return_inverse=True)
    which = which.ravel()
    masks = np.zeros((pieces.shape[1], 256), np.uint64)
    row, head = np.arange(pieces.shape[1]), items.base[pieces[0]] + pieces[1]
    for j in range(int(m.max(initial=0))):
        k = row[j < pieces[2]]
        masks[k, items.flat[head[k] + j]] |= np.uint64(1 << j)
    masks = masks.ravel()
    one, top = np.uint64(1), np.uint64(1) << (m - 1).astype(np.uint64)
    up, down = np.full(len(item), ~np.uint64(0)), np.zeros(len(item), np.uint64)
    score, best, row = m.copy(), m.copy(), which.astype(np.int64) << 8
    begin, last = place + a - edits + items.around, len(padded) - 1
    for j in range(int((m + 2 * edits).max(initial=0))):
        eq = masks[row + padded[np.minimum(begin + j, last)]]
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        ph, mh = down | ~(d0 | up), up & d0
        score += (ph & top) != 0
        score -= (mh & top) != 0
        ph <<= one
        mh <<= one
        up, down = mh | ~(d0 | ph), ph & d0
        np.minimum(best, score, out=best)
    return best <= edits


def best_match(item: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """The least edit distance of ``item`` to a substring of ``text`` with its bounds, if at most ``limit``.

    Bit-parallel dynamic programming; of equal distances the earliest end, then the
    latest begin, wins.
    """

    def least(pattern: bytes, over: bytes, anchored: bool) -> tuple[int, int]:
        m = len(pattern)
        full, top = (1 << m) - 1, 1 << (m - 1)
        masks: dict[int, int] = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        up, down, score, best, at = full, 0, m, m, 0
        for j, c in enumerate(over, 1):
            eq = masks.get(c, 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            ph, mh = down | (full & ~(d0 | up)), up & d0
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full | anchored, (mh << 1) & full
            up, down = mh | (full & ~(d0 | ph)), ph & d0
            if score < best:
                best, at = score, j
        return best, at

    distance, end = least(item, text, False)
    if distance > limit:
        return None
    _, back = least(item[::-1], text[:end][::-1], True)
    return distance, end - back, end


def _checked(items: Items, codes: np.ndarray, padded: np.ndarray, at: np.ndarray, met: list[np.ndarray]) -> np.ndarray:
    """Text, item and place (from the text's begin) of the windows that pass both filters."""
    window, item, seed = np.concatenate(met, 1)
    place = window - seed
    order = np.lexsort((seed, place, item))
    window, item, seed, place = window[order], item[order], seed[order], place[order]
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(place) != 0)
    first = np.flatnonzero(new)
    enough = np.repeat(_enough_runs(items, codes, item[first], place[first]), np.diff(np.append(first, len(item))))
    new[1:] |= np.diff(seed // 32) != 0
    x = np.flatnonzero(enough & new)
    x = np.concatenate([x[:0], *(part[_alike(items, padded, item[part], seed[part], place[part])] for part in np.split(x, range(_PART, len(x), _PART)))])
    text = np.searchsorted(at, window[x], "right") - 1
    return np.stack([text, item[x], place[x] - at[text]])


def _places(items: Items, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and place of the item in the text, of the windows that pass both filters."""
    codes = np.zeros(len(symbols) + 2 * items.around, np.int32)
    padded = np.pad(symbols, items.around)
    for q, h in _hashes(symbols, RUN):
        if q == RUN:
            codes[items.around : items.around + len(h)] = _run_codes(h)
    found, met, size, twos = [], [], 0, _twos(symbols)
    for walk in range(WALKS):
        bits = len(items.filters[walk, items.stops[0]]).bit_length() - 1
        keep = lambda t, h: items.filters[walk, t].take(_filter(h, bits).view(np.int64))  # noqa: B023, E731
        ended: dict[int, list[np.ndarray]] = {t: [] for t in items.stops}
        for block in range(0, len(symbols), _BLOCK):
            for t, *windows, says in _samples(twos, np.arange(block, min(block + _BLOCK, len(symbols))), walk, items.stops, keep):
                ends = np.flatnonzero(says == 3)
                if len(ends):
                    ended[t].append(np.stack([x[ends] for x in windows]))
        for t, parts in ended.items():
            for window, pointer, h in [np.concatenate(parts, 1)] if parts else []:
                table, owner, shift = items.tables[walk, t]
                lo = np.searchsorted(table, h)
                n = np.searchsorted(table, h, "right") - lo
                good = np.flatnonzero(n)
                good = good[pointer[good] <= at[np.searchsorted(at, window[good], "right")]]
                who, lo, n = window[good], lo[good], n[good]
                total = np.cumsum(n)
                cuts = np.unique(np.searchsorted(total, np.arange(0, int(n.sum()) + _AT_ONCE, _AT_ONCE), "left"))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows = ranges(lo[a:b], n[a:b])
                    met.append(np.stack([np.repeat(who[a:b], n[a:b]), owner[rows], shift[rows]]))
                    size += len(rows)
                    if size >= _AT_ONCE:
                        found.append(_checked(items, codes, padded, at, met))
                        met, size = [], 0
    if met:
        found.append(_checked(items, codes, padded, at, met))
    return tuple(np.unique(np.concatenate(found, 1), axis=1)) if found else (np.zeros(0, np.int64),) * 3


def _find_short(items: Items, symbols: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The first exact match of each pair of a text and a short item."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    edge = np.zeros(len(symbols) + 1, bool)
    edge[at] = True
    begins, ends = edge.copy(), edge.copy()
    begins[1:] |= symbols == BLANK
    ends[:-1] |= symbols == BLANK
    for q, h in _hashes(symbols, max(items.short)):
        if q not in items.short:
            continue
        seeds, owner = items.short[q]
        start = np.flatnonzero(begins[: len(h)] & ends[q : q + len(h)])
        text = np.searchsorted(at, start, "right") - 1
        good = start + q <= at[text + 1]
        if q < WHOLE:
            rest = at[text + 1] - start - q
            good &= (start == at[text]) & ((rest == 0) | ((rest == 1) & (symbols[np.minimum(start + q, len(symbols) - 1)] == BLANK)))
        start, text = start[good], text[good]
        lo, hi = (np.searchsorted(seeds, mix64(h[start]), side) for side in ("left", "right"))
        for k in np.flatnonzero(hi > lo).tolist():
            t, b = int(text[k]), int(start[k])
            for i in owner[lo[k] : hi[k]].tolist():
                if items.symbols[i] == symbols[b : b + q].tobytes():
                    found.setdefault((t, i), (0, b - int(at[t]), b - int(at[t]) + q))
    return [(t, i, *m) for (t, i), m in found.items()]


def _find(items: Items, symbols: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, begin, end) of the best match of each pair, positions in symbols."""
    if not len(symbols):
        return []
    short = _find_short(items, symbols, at) if items.short else []
    if not items.tables:
        return short
    text, item, place = _places(items, symbols, at)
    if not len(text):
        return short
    # Places of a pair that are less than an item apart are verified as one.
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(place) > items.size[item[1:]])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(text)) - 1
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, lo, hi in zip(text[first].tolist(), item[first].tolist(), place[first].tolist(), place[final].tolist(), strict=True):
        m = len(items.symbols[i])
        limit = allowed_edits(m, similarity)
        known = found.get((t, i))
        if known and known[0] == 0:
            continue
        lo = max(0, lo - limit)
        whole = symbols[at[t] + lo : min(at[t + 1], at[t] + max(0, hi + m + limit))].tobytes()
        match = best_match(items.symbols[i], whole, limit if known is None else known[0] - 1)
        if match:
            found[t, i] = match[0], lo + match[1], lo + match[2]
    return short + [(t, i, *m) for (t, i), m in found.items()]


def passes(benchmark: DataFrame, similarity: float = 0.8, text: str = "text", key: str = "item_id", nameless: bool = False) -> Iterator[Items]:
    """The benchmark in passes of at most PASS_SYMBOLS symbols (or one item, if longer).

    Null and blank items are left out, and those without an id unless ``nameless``; equal texts under one id are taken once.
    """
    ids, symbols, total = [], [], 0
    slim = benchmark.where(F.col(text).isNotNull() & (F.lit(nameless) | F.col(key).isNotNull())).select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    for row in slim.toLocalIterator():
        raw = np.frombuffer(row.t.encode(), np.uint8)
        s = reduce_texts(raw, np.array([0, len(raw)]))[0].tobytes().strip()
        if not s:
            continue
        if ids and total + len(s) > PASS_SYMBOLS:
            yield Items.build(ids, symbols, similarity)
            ids, symbols, total = [], [], 0
        ids.append(row.i)
        symbols.append(s)
        total += len(s)
    if ids:
        yield Items.build(ids, symbols, similarity)


def matches(df: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, distance, similarity, begin, end for each text that holds an item.

    An item is held when some substring of the reduced text is within
    (1 - ``similarity``) * length edits of it; the best one found is reported, with
    character positions in the original text.  Null and empty texts hold nothing.
    Repeated rows are reported each; ties between substrings go to the earliest end.  An
    empty table or benchmark gives an empty result.
    """
    spark = df.sparkSession
    on_workers(spark)
    schema = "doc_id long, item_id long, distance int, similarity double, begin long, end long"
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for items in passes(benchmark, similarity):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = shipped.value
            for rows, data, offsets in text_slices(batches, limit=SLICE):
                symbols, at, where = reduce_texts(data, offsets)
                found = _find(items, symbols, at, similarity)
                keys = column(rows, "doc_id").take(pa.array([t for t, *_ in found], pa.int64()))
                place = lambda t, x: int(where[at[t] + x])  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "doc_id": keys,
                    "item_id": pa.array([items.ids[i] for _, i, *_ in found], pa.int64()),
                    "distance": pa.array([d for *_, d, _, _ in found], pa.int32()),
                    "similarity": pa.array([1 - d / len(items.symbols[i]) for _, i, d, _, _ in found], pa.float64()),
                    "begin": pa.array([place(t, b) for t, _, _, b, _ in found], pa.int64()),
                    "end": pa.array([place(t, e - 1) + 1 for t, _, _, _, e in found], pa.int64()),
                })

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def clean(df: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, unchanged; nothing is shuffled."""
    on_workers(df.sparkSession)
    for items in passes(benchmark, similarity, nameless=True):
        shipped = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in text_slices(batches, text, SLICE):
                symbols, at, _ = reduce_texts(data, offsets)
                good = np.ones(rows.num_rows, bool)
                good[[t for t, *_ in _find(shipped.value, symbols, at, similarity)]] = False
                yield rows.filter(pa.array(good))

        df = df.mapInArrow(run, T.StructType(df.schema.fields))
    return df
