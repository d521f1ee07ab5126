"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are put in order of a cheap similarity key (the signs of fixed projections) and
cut into shards; inside a shard, splits at the median of the widest term make document
ranges of alike vectors: blocks of LEAF vectors inside super-blocks of SUPER.  Of each
the largest and smallest weight of every term is kept.  For a query the terms' maxima sum
to an upper bound of any score in the block.  Super-blocks are taken from the highest
bound down, blocks in them whose bound reaches the query's k-th best score so far are
scored through their forward index, and the query ends where the bounds fall below it.

Round 1 searches each query's own shard, where it stands beside its likes, which needs no
shuffle and gives a first k-th score.  Round 2 sends only the super-blocks' maxima to the
queries.  Round 3 sends the queries, with their k-th scores, to the shards that still have
a super-block at or above it; blocks move once.  Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import scratch
from barloom.llm.kernels import column

#: Vectors in a block, a super-block and a shard; queries that travel together; shards whose maxima do.
LEAF, SUPER, SHARD, CHUNK, GROUP = 2, 256, 1 << 15, 1 << 10, 32
#: Super-blocks of a query between two looks at its bounds.
TOGETHER = 4
#: Projections of the similarity key.
_SIGNS = 24

#: Sums below this are exact in float64.
_EXACT = float(1 << 53)
_LONG = 2**63 - 1
_NONE = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def weights(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; shorter vectors are padded with weight 0."""
    size = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    flat = np.floor(np.asarray(pa.compute.list_flatten(vectors)).astype(np.float64) * scale)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def similarity_key(x: np.ndarray) -> np.ndarray:
    """Signs of fixed projections as a number whose neighbours differ in few signs."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    planes = np.concatenate([np.random.default_rng(d).choice([-1.0, 1.0], (1, _SIGNS)) for d in range(x.shape[1])])
    with np.errstate(all="ignore"):
        signs = (x @ planes > 0).astype(np.int64)
    # Gray code: bit i is the parity of the signs up to i.
    return (np.cumsum(signs, axis=1) & 1) @ (1 << np.arange(_SIGNS - 1, -1, -1))


def ranges_of_alike(x: np.ndarray) -> np.ndarray:
    """An order of the vectors in which each range of LEAF, and of SUPER, holds alike ones."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF or not x.shape[1]:
            out.append(rows)
            continue
        part = x[rows]
        term = int((part.max(0) - part.min(0)).argmax())
        # Cut at the largest power of two blocks, so that every range but the last is full.
        unit = LEAF
        while unit * 2 < len(rows):
            unit *= 2
        order = rows[np.argpartition(part[:, term], unit - 1)]
        todo += [order[unit:], order[:unit]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Shard:
    """Vectors in blocks and super-blocks, with the largest and smallest weights of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.most, self.least = _limits(x, LEAF)
        self.super_most, self.super_least = _limits(x, SUPER)

    def search(self, queries: np.ndarray, names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> int:
        """Improve each query's best ``ids`` and ``scores`` (best first, -inf where free) and return how many blocks were scored.

        A vector of the query's own name takes no part; ties go to the smaller id.
        """
        d = max(queries.shape[1], self.x.shape[1])
        queries = _widen(queries, d)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = up @ _widen(self.super_most, d).T + down @ _widen(self.super_least, d).T
        order = np.argsort(-bound, axis=1, kind="stable")
        active, scored, k = np.arange(len(queries)), 0, ids.shape[1]
        for r in (0, *range(1, bound.shape[1], TOGETHER)):
            block = order[active, r : r + (TOGETHER if r else 1)]
            alive = bound[active[:, None], block] >= scores[active, -1:]
            rows_of, at = np.nonzero(alive)
            block, rows_of = block[rows_of, at], active[rows_of]
            active = active[alive[:, -1]]
            by_block = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by_block], prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows, number = rows_of[by_block[lo:hi]], int(block[by_block[lo]])
                rows = rows[bound[rows, number] >= scores[rows, -1]]
                if not len(rows):
                    continue
                first, last = number * SUPER // LEAF, min(len(self.most), (number + 1) * SUPER // LEAF)
                near = up[rows] @ _widen(self.most[first:last], d).T + down[rows] @ _widen(self.least[first:last], d).T >= scores[rows, -1:]
                scored += int(near.sum())
                some = np.flatnonzero(near.any(0))
                at = (first * LEAF + some[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.ids)]
                if not len(at):
                    continue
                s = queries[rows] @ _widen(self.x[at], d).T
                s[self.ids[at] == names[rows, None]] = -np.inf
                hit = np.flatnonzero((s >= scores[rows, -1:]).any(1))
                if not len(hit):
                    continue
                rows, s = rows[hit], s[hit]
                s = np.concatenate([scores[rows], s], 1)
                i = np.concatenate([ids[rows], np.broadcast_to(self.ids[at], (len(rows), len(at)))], 1)
                best = np.lexsort((i, -s))[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        return scored


def _limits(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.arange(0, len(x), size)
    if not len(x) or not x.shape[1]:
        return (np.zeros((len(first), x.shape[1])),) * 2
    return np.maximum.reduceat(x, first), np.minimum.reduceat(x, first)


def _widen(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _pack(x: np.ndarray) -> bytes:
    small = not x.size or np.abs(x).max() < 1 << 24
    return (b"f" if small else b"d") + x.astype(np.float32 if small else np.float64).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1)
    return x.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _wide(largest: float, length: int) -> bool:
    """Whether scores of such weights may be too large for exact sums in float64."""
    return largest * largest * max(1, length) >= _EXACT


_TABLE = "shard long, kind int, n int, ids binary, x binary, y binary, best binary, scores binary"
_KINDS = dict(zip("shard kind n ids x y best scores".split(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True))
_VECTORS, _MAXIMA, _QUERIES = 0, 1, 2


def _row(shard: int, kind: int, n: int, *parts: bytes | None) -> pa.RecordBatch:
    values = [shard, kind, n, *parts, *[None] * (5 - len(parts))]
    return pa.RecordBatch.from_pydict({c: pa.array([v], t) for (c, t), v in zip(_KINDS.items(), values, strict=True)})


def _queries(r: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], np.int64), _unpack(r["x"], r["n"]), np.frombuffer(r["best"], np.int64).reshape(-1, k).copy(), np.frombuffer(r["scores"]).reshape(-1, k).copy()


def _query_row(shard: int, names: np.ndarray, x: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return _row(shard, _QUERIES, len(names), names.tobytes(), _pack(x), None, ids.tobytes(), scores.tobytes())


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product.

    Every usable row is a candidate, except rows with the query's own id.  Vectors that
    are null or hold a null or non-finite component, and rows with a null id, take no
    part; an empty vector scores 0 with everything; of two lengths the shorter is padded
    with zeros.  A query id that repeats is asked once, with its smallest vector;
    repeated candidate rows are listed as often as they came.  Ties go to the smaller
    id.  A score beyond a 64-bit integer is cut to its range.  No usable query gives an
    empty result.
    """
    spark = df.sparkSession
    scratch.on_workers(spark)
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, longest, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if _wide((largest or 0.0) * abs(scale) + 1, longest or 0):
        return _top_k_wide(rows, k, scale)
    shards = max(1, -(-n // SHARD))
    both = rows.select("id", "v", F.lit(False).alias("asked")).unionByName(rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("asked", F.lit(True)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = weights(column(part, "v"), scale)
                size = np.asarray(pa.compute.list_value_length(column(part, "v")))
                yield pa.RecordBatch.from_pydict({"key": pa.array(similarity_key(x)), "id": column(part, "id"), "asked": column(part, "asked"), "x": pa.array([x[i, : size[i]].astype("<f8").tobytes() for i in range(len(x))], pa.binary())})

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, bytes]] = []

        def done(number: int) -> Iterator[pa.RecordBatch]:
            asked = np.array([a for _, a, _ in held])
            ids = np.array([i for i, _, _ in held], np.int64)
            x = np.zeros((len(held), max(len(v) for _, _, v in held) // 8))
            for at, (_, _, v) in enumerate(held):
                x[at, : len(v) // 8] = np.frombuffer(v, "<f8")
            order = ranges_of_alike(x[~asked])
            own = Shard(ids[~asked][order], x[~asked][order])
            yield _row(number, _VECTORS, len(own.ids), own.ids.tobytes(), _pack(own.x))
            yield _row(number, _MAXIMA, len(own.super_most), None, _pack(own.super_most), _pack(own.super_least))
            for lo in range(0, int(asked.sum()), CHUNK):
                names, q = ids[asked][lo : lo + CHUNK], x[asked][lo : lo + CHUNK]
                best, scores = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
                own.search(q, names, best, scores)
                yield _query_row(number, names, q, best, scores)

        part = number = None
        for batch in batches:
            if part is None and batch.num_rows:
                part = number = column(batch, "part")[0].as_py() << 32
            for i, a, v in zip(column(batch, "id").to_pylist(), column(batch, "asked").to_pylist(), column(batch, "x").to_pylist(), strict=True):
                held.append((i, a, v))
                if len(held) >= 2 * SHARD:
                    yield from done(number)
                    held, number = [], number + 1
        if held:
            yield from done(number)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which queries of other shards some super-block of a shard may still concern."""
        maxima: list[tuple[int, np.ndarray, np.ndarray]] = []
        group = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    maxima, group = [], r["group"]
                if r["kind"] == _MAXIMA:
                    maxima.append((r["shard"], _unpack(r["x"], r["n"]), _unpack(r["y"], r["n"])))
                    continue
                names, q, best, scores = _queries(r, k)
                for number, most, least in maxima:
                    if number == r["shard"]:
                        continue
                    d = max(q.shape[1], most.shape[1])
                    x = _widen(q, d)
                    bound = (np.maximum(x, 0) @ _widen(most, d).T + np.minimum(x, 0) @ _widen(least, d).T).max(1)
                    on = np.flatnonzero(bound >= scores[:, -1])
                    if len(on):
                        yield _query_row(number, names[on], q[on], best[on], scores[on])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == _VECTORS:
                    at = Shard(np.frombuffer(r["ids"], np.int64), _unpack(r["x"], r["n"]))
                    continue
                names, q, best, scores = _queries(r, k)
                # Only what this shard adds; the bar is the k-th score so far.
                ids, found = np.full_like(best, np.iinfo(np.int64).max), np.repeat(scores[:, -1:], k, 1)
                at.search(q, names, ids, found)
                yield _found(names, ids, found)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names, _, best, scores = _queries(r, k)
                yield _found(names, best, scores)

    def _found(names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        real = (ids != np.iinfo(np.int64).max) & np.isfinite(scores)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(names, k)[real.ravel()]), "vec_id": pa.array(ids[real]), "score": pa.array(scores[real].astype(np.int64))})

    answer = "query_id long, vec_id long, score long"
    placed = both.mapInArrow(keyed, "key long, id long, asked boolean, x binary").repartitionByRange(shards, "key", "id").sortWithinPartitions("key", "id").withColumn("part", F.spark_partition_id())
    table = scratch.write(placed.mapInArrow(shard, _TABLE), "shards")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = -(-2 * shards // GROUP)
    maxima = table.where(F.col("kind") == _MAXIMA).withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    asked = table.where(F.col("kind") == _QUERIES)
    packs = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    left = maxima.unionByName(packs).repartition(min(tasks, groups), "group").sortWithinPartitions("group", "kind").mapInArrow(compare, _TABLE)
    wanted = scratch.write(left, "wanted")
    rest = table.where(F.col("kind") == _VECTORS).unionByName(wanted).repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(search, answer)
    near = asked.mapInArrow(listed, answer).unionByName(rest)
    return _ranked(near, k)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k_wide(rows: DataFrame, k: int, scale: float) -> DataFrame:
    """The same for weights that float64 can't sum exactly, in integers of any size.

    Queries meet every vector in bounded chunks, without bounds: such weights mean a scale
    or data that are out of the ordinary, and right results come first.
    """
    spark = rows.sparkSession
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    count = max(1, -(-asked.count() // CHUNK))
    packed = asked.select((F.pmod(F.xxhash64("id"), F.lit(count))).cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "v")
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // count)
    spread = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    against = rows.select(spread.alias("chunk"), F.lit(1).alias("kind"), "id", "v").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    both = packed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).unionByName(against)
    cut = lambda s: max(-_LONG - 1, min(_LONG, s))
    whole = lambda v: [int(x) for x in np.floor(np.array(v, float) * scale)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {}, None

        def done() -> pa.RecordBatch:
            out = [(q, i, -s) for q, (_, best) in held.items() for s, i in best]
            return pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

        for batch in batches:
            for r in batch.to_pylist():
                if (r["chunk"], r["slice"]) != at:
                    if held:
                        yield done()
                    held, at = {}, (r["chunk"], r["slice"])
                v = whole(r["v"])
                if r["kind"] == 0:
                    held[r["id"]] = v, []
                    continue
                for q, (x, best) in held.items():
                    if q != r["id"]:
                        best.append((-cut(sum(a * b for a, b in zip(x, v, strict=False))), r["id"]))
                        if len(best) > 4 * k:
                            best.sort()
                            del best[k:]
        if held:
            yield done()

    near = both.repartition("chunk", "slice").sortWithinPartitions("chunk", "slice", "kind").mapInArrow(run, "query_id long, vec_id long, score long")
    return _ranked(near, k)
