"""N-gram Jaccard join by prefix filtering under several global token orders.

Two sets with Jaccard similarity t share a token among the first n - ceil(t n) + 1
tokens of each, under *every* global order of tokens.  Order 1 (rarest first) generates
candidates; orders 2 and 3 (other shuffles inside bands of rarity) must agree before a
candidate's sets are intersected.

Scale: tokens are ordered by a count sketch of bounded size, so the only corpus-wide
state on the driver is a few megabytes.  Equal sets collapse to one representative before
any token is shuffled.  A token shared by m representatives is first compared against one
centre (the set whose rarest tokens are most common), which joins a large group of near
copies with m comparisons; afterwards only pairs whose components still differ are
compared, minority against the rest, so no pair that could join two components is lost
and pairs inside a component are never listed.  Tokens of very many sets are dealt to
several tasks, each with a centre of its own, and where a token keeps many components
apart, pairs must share a token of the second order as well before they are listed.
Fingerprints of very many texts are looked up in a broadcast list instead of a join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import scratch
from barloom.llm.components import components
from barloom.llm.kernels import column, give_back, mix64, ranges, shingle_sets, text_slices

#: Two rows of counters, 8 MB for up to 512 MB of input and at most 32 MB.
SKETCH_BITS, MOST_BITS, _BYTES_A_SLOT = 20, 22, 512
_PART = 1 << 14
#: Prefix tokens that one task matches at once, and sets of a token that go to one task.
BUCKET, HOT = 1 << 22, 1 << 18
#: Sets outside a token's largest component above which its pairs are listed by two tokens.
CROWD = 1000
#: Bytes of text handled at once.
SLICE = 1 << 20
#: Bitmap that spares texts a shuffle; 8 MB.  Up to this share of bits set, it decides alone.
BITMAP_BITS, SPARSE = 26, 1 / 32


def _slots(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return tokens & mask, (tokens >> np.uint64(bits)) & mask


def sketch_bits(df: DataFrame) -> int:
    """Binary logarithm of the counters for a table of this estimated size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return SKETCH_BITS if size >> 60 else min(MOST_BITS, max(SKETCH_BITS, (size // _BYTES_A_SLOT).bit_length()))  # over an exabyte: not known


def count_sketch(df: DataFrame, k: int, text: str = "text", bits: int | None = None) -> np.ndarray:
    """In how many texts each token hash occurs, never too low, as a (2, 2^bits) table."""
    bits = bits or sketch_bits(df)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, any_rows = np.zeros((2, size), np.uint32), False
        for _, data, offsets in text_slices(batches, text, SLICE):
            any_rows = True
            tokens, _ = shingle_sets(data, offsets, k)
            for row, slot in enumerate(_slots(tokens, bits)):
                table[row] += np.bincount(slot.astype(np.int64), minlength=size).astype(np.uint32)
        if any_rows:
            flat = table.reshape(-1, _PART)
            some = np.flatnonzero(flat.any(1))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "counts": pa.array([flat[i].tobytes() for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        emit = lambda: pa.RecordBatch.from_pydict({"part": pa.array([held], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})
        for batch in batches:
            for part, counts in zip(column(batch, "part").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                if part != held:
                    if held is not None:
                        yield emit()
                    held, total = part, np.zeros(_PART, np.uint64)
                total += np.frombuffer(counts, np.uint32)
        if held is not None:
            yield emit()

    kind = "part int, counts binary"
    parts = df.select(text).mapInArrow(count, kind)
    rows = parts.repartition(2 * size // _PART, "part").sortWithinPartitions("part").mapInArrow(add, kind).collect()
    out = np.zeros((2 * size // _PART, _PART), np.uint32)
    for r in rows:
        out[r.part] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(2, size)


def _estimate(sketch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    a, b = _slots(tokens, sketch.shape[1].bit_length() - 1)
    return np.minimum(sketch[0][a], sketch[1][b])


def _spread(sketch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Over how many tasks each token's sets are dealt; counts near the mean of all counters are noise."""
    seen = _estimate(sketch, tokens).astype(np.int64) - 2 * int(sketch.mean())
    return np.maximum(1, -(-seen // HOT))


def prefix_length(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1


def _orders(sketch: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Ranks under three global orders; smaller comes first."""
    seen = _estimate(sketch, tokens)
    band = np.uint64(1) << np.uint64(58)
    twos = np.log2(np.maximum(seen, 1)).astype(np.uint64)
    salted = lambda s: mix64(tokens + np.uint64(s))
    return [
        (seen.astype(np.uint64) << np.uint64(32)) | (salted(1) >> np.uint64(32)),
        twos * band + (salted(2) >> np.uint64(6)),
        twos // np.uint64(4) * band + (salted(3) >> np.uint64(6)),
    ]


def _first(rank: np.ndarray, tokens: np.ndarray, m: int) -> np.ndarray:
    if m < len(rank):
        pick = np.argpartition(rank, m - 1)[:m]
        pick = pick[np.argsort(rank[pick])]
    else:
        pick = np.argsort(rank)
    return tokens[pick]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _short(tokens: np.ndarray) -> np.ndarray:
    """16 bits of each token; enough for a filter that may let a few extra pairs through."""
    return (tokens >> np.uint64(24)).astype(np.uint16).view(np.int16)


def _prefixes(df: DataFrame, shipped: Broadcast, k: int, t: Fraction) -> DataFrame:
    """doc_id, n, fingerprint, centre score and the prefixes under the three orders of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shipped.value
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            tokens, at = shingle_sets(data, offsets, k)
            orders = _orders(sketch, tokens)
            seen = orders[0] >> np.uint64(32)
            out, prints, score = ([], [], []), [], []
            for i in range(len(at) - 1):
                part = slice(at[i], at[i + 1])
                own = tokens[part]
                n = len(own)
                m = prefix_length(n, t) if n else 0
                prints.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8"))
                for to, rank in zip(out, orders, strict=True):
                    to.append(_first(rank[part], own, m) if n else own)
                score.append(int(np.log2(np.maximum(np.partition(seen[part], m - 1)[:m], 1)).sum() / m * 1000) if n else 0)
            both = np.array(prints).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "doc_id": column(rows, "doc_id"),
                "n": pa.array(np.diff(at), pa.int64()),
                "high": pa.array(both[:, 0]),
                "low": pa.array(both[:, 1]),
                "score": pa.array(score, pa.int64()),
                "prefix": _lists([x.view(np.int64) for x in out[0]], pa.int64()),
                "p2": _lists([_short(x) for x in out[1]], pa.int16()),
                "p3": _lists([_short(x) for x in out[2]], pa.int16()),
            })

    return df.mapInArrow(run, "doc_id long, n long, high long, low long, score long, prefix array<long>, p2 array<short>, p3 array<short>")


_SHARED = "token long, rep long, n long, pos int, key long, centre long, n_centre long, pos_centre int, key_centre long"


def _shared(reps: DataFrame, buckets: int, tasks: int, shipped: Broadcast) -> DataFrame:
    """A row for each prefix token that several representatives hold, with the token's centre.

    Tokens travel as packed arrays, one row per bucket and batch of sets, and are sorted
    and matched inside their bucket.  A token of very many sets has several buckets, with
    a centre in each, and keeps its sets even where they are alone in one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                rows = batch.slice(lo, 1 << 14)
                col = column(rows, "prefix")
                size = np.asarray(pc.list_value_length(col)).astype(np.int64)
                tokens = np.asarray(pc.list_flatten(col)).view(np.uint64)
                owner = np.repeat(np.arange(len(size), dtype=np.uint16), size)
                pos = ranges(np.zeros(len(size), np.int64), size).astype(np.uint32)
                spread = _spread(shipped.value, tokens)
                bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                many = np.flatnonzero(spread > 1)
                share = mix64(np.asarray(column(rows, "rep")).astype(np.int64).view(np.uint64))[owner[many]] % spread[many].astype(np.uint64)
                bucket[many] = (bucket[many] + share.astype(np.int64)) % buckets
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                sets = np.stack([np.asarray(column(rows, c)).astype(np.int64) for c in ("rep", "n", "score")])
                out = []
                for b in range(buckets):
                    part = order[ends[b] : ends[b + 1]]
                    if len(part):
                        used, local = np.unique(owner[part], return_inverse=True)
                        out.append((b, tokens[part].tobytes(), local.astype(np.uint16).tobytes(), pos[part].tobytes(), np.ascontiguousarray(sets[:, used]).tobytes()))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(("bucket", "tokens", "owner", "pos", "sets"))})

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != held and parts:
                    yield from _match(parts, shipped.value)
                    parts = []
                held = r["bucket"]
                sets = np.frombuffer(r["sets"], np.int64).reshape(3, -1)[:, np.frombuffer(r["owner"], np.uint16)]
                parts.append((np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["pos"], np.uint32), sets))
        if parts:
            yield from _match(parts, shipped.value)
        parts.clear()
        give_back()

    packed = reps.mapInArrow(pack, "bucket int, tokens binary, owner binary, pos binary, sets binary")
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(share, _SHARED)


def _match(parts: list, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    tokens, pos, sets = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts], 1)
    order = np.argsort(tokens, kind="stable")
    tokens, pos, (rep, n, score) = tokens[order], pos[order], sets[:, order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    size = np.diff(np.append(first, len(tokens)))
    some = (size > 1) | (_spread(sketch, tokens[first]) > 1)
    first, size = first[some], size[some]
    if not len(first):
        return
    rows = ranges(first, size)
    key = (score[rows] << 40) | (mix64(rep[rows].view(np.uint64)) >> np.uint64(24)).astype(np.int64)
    group = np.repeat(np.arange(len(first)), size)
    best = np.lexsort((key, group))[np.cumsum(size) - 1]
    centre = np.repeat(best, size)
    out = {"token": tokens[rows].view(np.int64), "rep": rep[rows], "n": n[rows], "pos": pos[rows].astype(np.int32), "key": key}
    out |= {"centre": rep[rows][centre], "n_centre": n[rows][centre], "pos_centre": pos[rows][centre].astype(np.int32), "key_centre": key[centre]}
    for lo in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_pydict({c: pa.array(v[lo : lo + 100_000]) for c, v in out.items()})


def _sets(df: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep and the whole token set of the texts whose id is in ``wanted`` (doc_id), and of few others.

    A bitmap of fixed size drops most other texts.  While at most SPARSE of it is set, the
    few it lets through stay, and the joins on ``rep`` that follow drop them; with more
    ids an exact semi-join comes before the sets are made.  Either way a stage has one
    Python node: with two, each task takes two workers, and Spark keeps them all.
    """
    bits = 1 << BITMAP_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            slot = _slot(np.asarray(column(batch, "doc_id")))
            np.bitwise_or.at(packed, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        packed = packed.reshape(-1, 1 << 16)
        full = np.flatnonzero(packed.any(1))
        if len(full):
            yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "bits": pa.array([zlib.compress(packed[i].tobytes(), 1) for i in full], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        emit = lambda: pa.RecordBatch.from_pydict({"part": pa.array([held], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != held:
                    if held is not None:
                        yield emit()
                    held, total = r["part"], np.zeros(1 << 16, np.uint8)
                total |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        if held is not None:
            yield emit()

    kind = "part int, bits binary"
    rows = wanted.mapInArrow(mark, kind).repartition(bits // 8 >> 16, "part").sortWithinPartitions("part").mapInArrow(merge, kind).collect()
    packed = np.zeros((bits // 8 >> 16, 1 << 16), np.uint8)
    for r in rows:
        packed[r.part] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    shipped = df.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(np.asarray(pc.fill_null(column(batch, "doc_id"), 0)))
            near = shipped.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(near.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            tokens, at = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_pydict({"rep": column(rows, "doc_id"), "n": pa.array(np.diff(at), pa.int64()), "tokens": _lists([tokens[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())})

    kind = "rep long, n long, tokens array<long>"
    if int(np.bitwise_count(packed).sum()) <= SPARSE * bits:
        return df.mapInArrow(lambda batches: run(maybe(batches)), kind)
    return df.mapInArrow(maybe, df.schema).join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(run, kind)


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _links(pairs: DataFrame, docs: DataFrame, filters: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    Pairs must also share a prefix token under orders 2 and 3 before any set is fetched.
    """
    one = lambda df, s: df.select(*(F.col(c).alias(s if c == "rep" else f"{c}_{s}") for c in df.columns))
    near = pairs.join(one(filters, "a"), "a").join(one(filters, "b"), "b").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
    near = scratch.write(near.select("a", "b").distinct(), "candidates")
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = scratch.write(_sets(docs, wanted, k), "sets")
    both = near.join(one(sets, "a"), "a").join(one(sets, "b"), "b")
    inter = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    p, q = t.numerator, t.denominator
    return scratch.write(both.where(inter * F.lit(p + q) >= (F.col("n_a") + F.col("n_b")) * F.lit(p)).select("a", "b").distinct(), "links")


def _possible(t: Fraction, x: str, y: str) -> Column:
    """Sizes and the token's positions still allow the threshold, if it is the first common token."""
    p, q = t.numerator, t.denominator
    n, m, i, j = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"pos{x}"), F.col(f"pos{y}")
    return (n * q >= m * p) & (m * q >= n * p) & (F.least(n - i, m - j) * (p + q) >= (n + m) * p)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _unsettled(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tokens that still hold several components, and each such token's largest one."""
    rows = shared.select("token", "rep", "n", "pos", "key").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rows = scratch.write(rows, "labelled")
    best = lambda c, o: F.max_by(c, o).alias(c if c.endswith("_centre") or c == "centre" else {"rep": "centre"}.get(c, f"{c}_centre"))
    own = rows.groupBy("token", "label").agg(F.count("*").alias("m"), best("rep", "key"), best("n", "key"), best("pos", "key"))
    order = F.col("m") * F.lit(1 << 40) + F.pmod(F.xxhash64("label"), F.lit(1 << 40))
    most = own.withColumn("order", order).groupBy("token").agg(F.count("*").alias("several"), (F.sum("m") - F.max("m")).alias("outside"), F.max_by("label", "order").alias("major"), best("centre", "order"), best("n_centre", "order"), best("pos_centre", "order"))
    return rows, most.where("several > 1").drop("several")


def _second(shared: DataFrame, labels: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of what the first centres left apart with the centre of each token's largest component."""
    rows, most = _unsettled(shared, labels)
    return rows.join(most, "token").where("label <> major").where(_possible(t, "", "_centre")).select(*_pair("rep", "centre")).distinct()


def _rest(shared: DataFrame, labels: DataFrame, filters: DataFrame, t: Fraction) -> DataFrame:
    """All remaining pairs between components: rows outside a token's largest one against the others.

    Where more than CROWD are outside, the pairs must share a token under the second order too.
    """
    rows, most = _unsettled(shared, labels)
    rows = rows.join(most.select("token", "major", "outside"), "token")

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        few = rows.where("label <> major").select(*on, "rep", "n", "pos", F.col("label").alias("own"))
        every = rows.select(*on, F.col("rep").alias("other"), F.col("n").alias("n_other"), F.col("pos").alias("pos_other"), "label", "major")
        met = few.join(every, on).where("own <> label and (label = major or rep < other)").where(_possible(t, "", "_other"))
        return met.select(*_pair("rep", "other"))

    crowded = rows.where(F.col("outside") > CROWD).join(filters.select("rep", F.explode("p2").alias("second")), "rep")
    return pairs(rows.where(F.col("outside") <= CROWD), ["token"]).unionByName(pairs(crowded, ["token", "second"])).distinct()


def classes(df: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``df``.

    Words are maximal runs without ASCII white space of the whole text, A-Z lower-cased;
    a set holds the distinct ``k``-word shingles (the whole sequence if it is shorter).
    Rows link when intersection / union reaches ``threshold``; component_id is the
    smallest key reachable by links, the row's own included.  Null, empty and blank texts
    have empty sets, link with nothing and keep their own key.  Repeated rows appear as
    often as they came; rows that share a key count as one node; a null key joins its
    class but never names it.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch.on_workers(spark)
    with scratch.scope() as around:
        docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        shipped = spark.sparkContext.broadcast(count_sketch(docs, k))
        packed = scratch.write(_prefixes(docs, shipped, k, threshold), "prefixes")
        filters = packed.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), "p2", "p3")

        reps = packed.where("n > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("score").alias("score"), F.first("prefix").alias("prefix"))
        rows, tokens = packed.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * (1 - threshold.numerator / threshold.denominator) + 1), F.lit(0.0))).first()
        tasks = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
        shared = scratch.write(_shared(reps.select("rep", "n", "score", "prefix"), max(tasks, int(tokens) // BUCKET), tasks, shipped), "shared")

        first = shared.where("rep <> centre").where(_possible(threshold, "", "_centre"))
        first = first.groupBy("rep").agg(F.max_by("centre", "key_centre").alias("centre")).select(*_pair("rep", "centre")).distinct()
        links = _links(first, docs, filters, k, threshold)
        links = links.unionByName(_links(_second(shared, components(links), threshold), docs, filters, k, threshold))
        links = links.unionByName(_links(_rest(shared, components(links), filters, threshold), docs, filters, k, threshold))
        labels = components(links)
        members = packed.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
        named = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("high", "low", "m", F.coalesce("label", "rep").alias("label"))
        named = scratch.write(named, "classes", around)
        texts = scratch.write(packed.select("doc_id", F.col("n").alias("n_shingles"), "high", "low"), "texts", around)
    # Of the fingerprints that more than a task's share of the texts have, there are fewer than tasks.
    hot = named.where(F.col("m") > max(1, rows // tasks)).select("high", "low", F.col("label").alias("often"))
    met = texts.where("n_shingles > 0").join(F.broadcast(hot), ["high", "low"], "left")
    rest = met.where("often is null").drop("often").join(named.select("high", "low", "label"), ["high", "low"], "left")
    parts = [texts.where("n_shingles = 0").withColumn("label", F.col("doc_id")), met.where("often is not null").withColumnRenamed("often", "label"), rest]
    return reduce(DataFrame.unionByName, (x.select("doc_id", "n_shingles", F.col("label").alias("component_id")) for x in parts))
