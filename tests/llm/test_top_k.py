"""Exact top-k search against a plain version."""

import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyclerk.llm import top_k


def found(spark, rows, k=5, divisor=5, kind="float", partitions=3):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({c: F.lit("clash") for c in ("n", "id", "v", "rank", "score", "label")})
    return sorted(tuple(r) for r in top_k.top_k(df.repartition(partitions), F.col("vec_id") % divisor == 0, k).collect())


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.fixture(params=["dense", "sparse", "coarse", "positive", "negative"])
def vectors(request):
    rng = random.Random(request.param)
    draw = {
        "dense": lambda: rng.gauss(0, 0.3), "sparse": lambda: rng.gauss(0, 1) if rng.random() < 0.1 else 0.0, "coarse": lambda: rng.choice([-1.0, 0.0, 1.0]),
        "positive": rng.random, "negative": lambda: -rng.random(),
    }[request.param]
    return [(i, [draw() for _ in range(12)]) for i in range(400)]


def test_against_plain_version(spark, vectors, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_BYTES", 8 * 12 * 16)  # many shards, so bounds are at work
    assert found(spark, vectors) == brute.top_k(as_floats(vectors), lambda i: i % 5 == 0, 5)


def test_passes_of_queries_and_copies(spark, monkeypatch):
    rng = random.Random(4)
    few = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)] for _ in range(7)]
    rows = [(i, few[0] if i % 3 else rng.choice(few)) for i in range(120)]
    monkeypatch.setattr(top_k, "QUERY_BYTES", 8 * 6 * 9)
    assert found(spark, rows) == brute.top_k(as_floats(rows), lambda i: i % 5 == 0, 5)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf]), (5, [-1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (10, []), (0, [1.0, 2.0]), (0, [2.0]), (7, [1.0, 2.0, 3.0]), (15, None), (-5, [0.5])]
    want = brute.top_k(as_floats(rows), lambda i: i % 5 == 0, 5)
    assert found(spark, rows) == want and len(want) > 10
    assert found(spark, rows[:1]) == [] and found(spark, [(1, None)]) == []
    big = [(i, [x, 1.0, -x]) for i, x in enumerate([1e30, -1e30, 3e37, 1e18, 2.0**40, 0.1, 1e10, 1e10])]
    assert found(spark, big, kind="double") == brute.top_k(big, lambda i: i % 5 == 0, 5)
    assert found(spark, [*big, (20, [1e308])], kind="double") == brute.top_k(big, lambda i: i % 5 == 0, 5)


def test_weak_terms_are_not_traversed(monkeypatch):
    """Once the k-th best is known, non-essential terms are read of vectors that can still get in, only."""
    values = np.zeros((300, 4))
    values[:, 0], values[:3, 1], values[:, 2] = 0.01, 9, 0.01
    shard = top_k.Shard(np.arange(300), top_k.integers(pa.array(values.tolist()), 4))
    best, probed = top_k.Best(2), []
    best.put(np.array([5_000, 4_900]), np.array([1000, 1001]))
    plain = shard._probe

    def probe(score, vectors, query, weak, *rest):
        probed.append((score.tolist(), sorted(weak.tolist())))
        plain(score, vectors, query, weak, *rest)

    monkeypatch.setattr(shard, "_probe", probe)
    shard.search(np.array([[256, 256, 256, 0]]), [-1], [best])
    assert probed == [([256 * 2304.0] * 3 + [0.0] * 297, [0, 2, 3])]
    assert best.id.tolist() == [0, 1] and best.score.tolist() == [256 * (2304 + 2 + 2)] * 2
