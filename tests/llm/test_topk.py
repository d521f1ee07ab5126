import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.llm import topk


def brute(rows, k):
    whole = {}
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in usable:
        if i % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable if j != i)
            whole[i] = [(j, -s) for s, j in scored[:k]]
    return whole


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in sorted(topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, size in (("SUPER", 8), ("SHARD", 64), ("CHUNK", 3), ("GROUP", 2)):
            monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (550, []), (551, [2.0, -1.0]), (None, [1.0])]
    want = brute(rows, 5)
    assert run(spark, rows) == want


def test_few_rows_huge_weights_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    rows = [(0, [1e14, 1.0]), (1, [1e14, 2.0]), (2, [-1e30, 0.5]), (50, [3.0, 1e3])]
    assert run(spark, rows) == brute(rows, 5)


def search(x, queries, names, k):
    order = topk.ranges_of_alike(x)
    shard = topk.Shard(np.arange(len(x))[order], x[order])
    ids, scores = np.full((len(queries), k), np.iinfo(np.int64).max), np.full((len(queries), k), -np.inf)
    return ids, scores, shard.search(queries, names, ids, scores), len(shard.most)


def test_bounds_stop_the_search():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.floor(rng.normal(0, 5, (128, 4)) + 60 * (b == 3)) for b in range(10)])
    queries = np.full((6, 4), 7.0)
    ids, _, scored, blocks = search(x, queries, np.full(6, -1), 5)
    assert (ids // 128 == 3).all() and scored <= 6 * topk.SUPER // topk.LEAF < 6 * blocks / 4  # one super-block a query


def test_fewer_blocks_are_scored_than_there_are_on_the_vectors_of_a_fixture():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    x = np.floor(256 * np.array([v for v in table["embedding"] if v is not None], float))
    ids, scores, scored, blocks = search(x, x[::50], np.arange(0, len(x), 50), 5)
    assert scored < 0.95 * blocks * len(x[::50])
    whole = x[::50] @ x.T
    whole[np.arange(len(whole)), np.arange(0, len(x), 50)] = -np.inf
    assert (scores == -np.sort(-whole, 1)[:, :5]).all()


def test_ranges_hold_every_vector_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 127, 129, 1000):
        assert sorted(topk.ranges_of_alike(rng.normal(0, 1, (n, 3))).tolist()) == list(range(n))
    assert sorted(topk.ranges_of_alike(np.zeros((9, 0))).tolist()) == list(range(9))
