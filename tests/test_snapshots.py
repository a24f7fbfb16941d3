"""Differences of two versions of a table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyclerk.operators import snapshots as S

SCHEMA = "k bigint, k2 string, change string, leaf int, v double"


def versions():
    before = [(i % 40, "ab"[i % 2], f"x{i % 7}", i % 3, float(i)) for i in range(400)]
    before += [(None, "a", "x", 1, 1.0), (None, None, None, None, None), (None, None, None, None, None), (7, None, "x", 1, float("nan"))]
    before += [(500, "hot", "same", 1, 2.0)] * 3000
    after = [r for i, r in enumerate(before) if i % 50 != 3]
    after += [(1000, "new", None, 5, None), (None, "a", "x", 1, 1.0), (500, "hot", "other", 1, 2.0)]
    return before, [(k, k2, "y" if v == 21.0 else c, leaf, v) for k, k2, c, leaf, v in after]


def brute(before, after):
    """By key: change, rows of either side without an equal one, differing columns of a single pair."""
    sides = defaultdict(lambda: (Counter(), Counter()))
    for side, rows in enumerate((before, after)):
        for r in rows:
            sides[r[:2]][side][tuple(map(repr, r))] += 1
    out = set()
    for key, (a, b) in sides.items():
        gone, come = a - b, b - a
        if not gone and not come:
            continue
        n, m = gone.total(), come.total()
        names = ()
        if (n, m) == (1, 1):
            names = tuple(c for c, x, y in zip(("k", "k2", "change", "leaf", "v"), next(iter(gone)), next(iter(come))) if x != y)
        out.add((key, "added" if not n else "removed" if not m else "changed", n, m, tuple(sorted(names))))
    return out


def rows_of(found):
    return {((r[0], r[1]), r[2], r.n_before, r.n_after, tuple(sorted(r.differing))) for r in found.collect()}


@pytest.mark.parametrize("bits", [8, 11, 12])
def test_equals_brute_force(spark, bits):
    before, after = versions()
    got = S.diff(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA).repartition(3), ["k", "k2"], bits)
    want = brute(before, after)
    assert rows_of(got) == want and len(want) > 5


def test_equal_and_empty_tables(spark):
    before, _ = versions()
    df, none = spark.createDataFrame(before, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert S.diff(df, df.repartition(5), ["k", "k2"]).count() == 0
    assert S.diff(none, none, ["k"]).count() == 0
    assert {r[2] for r in S.diff(none, df, ["k", "k2"]).collect()} == {"added"}
    with pytest.raises(ValueError):
        S.diff(df, df.drop("v"), ["k"])


def test_digests_add_up(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    tree = S.digest_tree(S.leaf_digests(df, ["k"], ["k", "v"], 10), 10)
    per_level = {r.level: (r.n, r.h, r.nodes) for r in tree.groupBy("level").agg(F.sum("n").alias("n"), F.sum("high").alias("h"), F.count("*").alias("nodes")).collect()}
    assert {v[:2] for v in per_level.values()} == {per_level[0][:2]} and per_level[0][0] == 5000
    assert per_level[0][2] == 1 and per_level[1][2] == 16 and per_level[3][2] <= 1024


def test_repeated_rows_that_swap_are_seen(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y")], "k int, v string")
    assert [tuple(r) for r in S.diff(a, b, ["k"]).collect()] == [(1, "changed", 1, 1, ["v"])]


def test_stored_snapshots_read_only_what_differs(spark, tmp_path):
    df = spark.range(20000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    changed = df.withColumn("v", F.when(F.col("k") == 77, "other").otherwise(F.col("v"))).filter("k <> 78")
    for name, rows in (("a", df), ("b", changed)):
        S.write_snapshot(rows, ["k"], str(tmp_path / name))
    found = S.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"])
    assert sorted((r.k, r.change, r.differing) for r in found.collect()) == [(77, "changed", ["v"]), (78, "removed", [])]
    read = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert read.count("PartitionFilters: [_branch") == 2  # at most two of 256 folders on either side
    assert S.diff_snapshots(spark, str(tmp_path / "a"), str(tmp_path / "a"), ["k"]).count() == 0
