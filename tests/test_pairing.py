"""Rows of repeated keys paired at the least cost, against all assignments of small groups."""

import itertools
import random

import pytest

from tallyclerk.operators import reconcile as R


def cost(a, b):
    """How many values stand at or after the first difference."""
    return next((len(a) - i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)


def cheapest(a, b):
    """The least cost of pairing as many rows as the smaller side has."""
    if len(a) > len(b):
        a, b = b, a
    return min(sum(map(cost, a, chosen)) for chosen in itertools.permutations(b, len(a)))


def by_key(rows):
    out = {}
    for k, *values in rows:
        out.setdefault(k, []).append(tuple(values))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_least_cost(spark, seed):
    rng = random.Random(seed)

    def rows():
        return [(k, *(rng.choice([None, 1, 2, 3]) for _ in range(3))) for k in range(30) for _ in range(rng.randrange(6))]

    left, right = rows(), rows()
    a, b = (spark.createDataFrame(x, "k int, u int, v int, w int") for x in (left, right))
    found = R.pair_rows(a, b, ["k"], ["u", "v", "w"]).collect()
    want_a, want_b = by_key(left), by_key(right)
    got_a, got_b, costs, pairs = {}, {}, {}, {}
    for r in found:
        one, other = (r.u_a, r.v_a, r.w_a), (r.u_b, r.v_b, r.w_b)
        if r.in_a:
            got_a.setdefault(r.k, []).extend([one] * r.n)
        if r.in_b:
            got_b.setdefault(r.k, []).extend([other] * r.n)
        if r.in_a and r.in_b:
            costs[r.k] = costs.get(r.k, 0) + r.n * cost(one, other)
            pairs[r.k] = pairs.get(r.k, 0) + r.n

    def ordered(groups):
        return {k: sorted(v, key=repr) for k, v in groups.items()}

    assert ordered(got_a) == ordered(want_a) and ordered(got_b) == ordered(want_b)
    for k in set(want_a) | set(want_b):
        assert pairs.get(k, 0) == min(len(want_a.get(k, [])), len(want_b.get(k, [])))
        assert costs.get(k, 0) == cheapest(want_a.get(k, []), want_b.get(k, []))


def test_hot_key_and_copies(spark):
    """One key of many rows, and more copies of a row than one array writes out."""
    left = spark.range(20000).selectExpr("1 AS k", "id % 5000 AS u", "CAST(0 AS BIGINT) AS v")
    left = left.union(spark.range(9000).selectExpr("2", "7", "7"))
    right = spark.range(20000).selectExpr("1 AS k", "id % 5000 AS u", "id % 2 AS v")
    found = R.reconcile(left, right, ["k"], ["u", "v"], pair_repeats=True)
    got = {(r.k, r.status): r.n for r in found.groupBy("k", "status").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    # id % 2 follows from id % 5000, so half the values of u agree in v and half differ
    assert got == {(1, "OK"): 10000, (1, "MISMATCH"): 10000, (2, "NEEDS_REVIEW"): 9000}


def test_odd_rows(spark):
    """Empty tables, NULL keys and tolerance; the order inside a group keeps near numbers together."""
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 5.0), (None, "y", 2.0), (None, "y", 2.0), (3, None, 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 5.1), (1, "x", 1.1), (4, "z", 0.0)], "k int, s string, v double")

    def outcome(x, y):
        rows = R.reconcile(x, y, ["k"], ["s", "v"], tolerances={"v": 0.5}, pair_repeats=True).collect()
        return sorted((str(r.k), r.v_a, r.v_b, r.status, r.review_reason, r.n) for r in rows) if rows else []

    assert outcome(a.limit(0), b.limit(0)) == []
    assert outcome(a.limit(0), b.filter("k = 4")) == [("4", None, 0.0, "NEEDS_REVIEW", "missing_value", 1)]
    got = {x[:1] + x[1:3]: x[3:] for x in outcome(a, b)}
    assert got == {
        ("1", 1.0, 1.1): ("OK", None, 1), ("1", 5.0, 5.1): ("OK", None, 1), ("3", 1.0, None): ("NEEDS_REVIEW", "missing_value", 1),
        ("4", None, 0.0): ("NEEDS_REVIEW", "missing_value", 1), ("None", 2.0, None): ("NEEDS_REVIEW", "null_key", 2)}
