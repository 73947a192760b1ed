import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylark.llm import topk

VECTORS = "vec_id bigint, embedding array<float>"


def brute(rows, every, k):
    use = []
    for i, e in rows:
        if i is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    out = []
    for n, (i, q) in enumerate(use):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(use) if m != n and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=4):
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("own")).withColumn("dims", F.lit(1))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.repartition(3), every, k).collect())


@pytest.mark.parametrize("block", [3, 64])
def test_against_brute_force(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("CHUNK", block), ("TILE_BYTES", block * 12), ("HELD", block)):
        monkeypatch.setattr(topk, name, value)
    random.seed(block)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(6)]) for i in range(100)]
    rows += [(200 + i, [0.5, 0.0, 0.0, 0.25, 0.0, 0.0]) for i in range(60)]  # one very common vector
    rows += [(300, None), (305, []), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (315, [float("nan")] * 6), (320, [float("inf")] * 6),
             (None, [0.1] * 6), (325, [0.2, 0.1]), (326, [0.3, 0.1]), (330, [0.1]), (5, rows[5][1]), (5, rows[5][1])]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_few_and_no_rows(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.25, -1.0])]
    assert run(spark, rows, k=10) == brute(rows, 5, 10)
    assert run(spark, [], k=10) == []
    assert run(spark, [(1, [0.1])]) == []


def test_large_values_stay_exact():
    a = np.array([[1 << 30, 3]], np.int64)
    b = np.array([[1 << 30, 1], [(1 << 30) - 1, -1]], np.int64)
    assert topk.product(a, b).tolist() == [[(1 << 60) + 3, (1 << 60) - (1 << 30) - 3]]


@pytest.mark.parametrize("seed", range(10))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    rows, queries = rng.integers(-500, 500, (20, 8)), rng.integers(-500, 500, (5, 8))
    found = topk.bounds(queries, rows.min(axis=0)[None], rows.max(axis=0)[None])[:, 0]
    assert (found >= (queries @ rows.T).max(axis=1)).all()


def test_no_bounds_of_queries_and_blocks_are_stored(spark, monkeypatch):
    """What one round leaves to the next grows with queries times k, not with queries times blocks."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    kept = {}
    real = topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, label: kept.setdefault(label, real(df, label)))
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4)]) for i in range(400)]
    assert run(spark, rows, 10, 3) == brute(rows, 10, 3)
    assert set(kept) == {"vectors", "blocks", "chunks", "first"}
    assert kept["blocks"][0].count() >= 100 and kept["first"][0].count() == 40 * 3


def test_scores_to_reach_rise_on_the_way():
    kept = topk.Kept(np.array([0, topk.LOWEST]), 2)
    ids = np.arange(4)
    kept.add(np.array([0, 0, 0, 1]), np.array([5, 9, 5, 1]), ids, ids)
    query, score, names, _ = kept.settle()
    assert (query.tolist(), score.tolist(), names.tolist()) == ([0, 0, 1], [9, 5, 1], [1, 0, 3])
    assert kept.least.tolist() == [5, topk.LOWEST]
