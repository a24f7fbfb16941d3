"""Rows of ordinary keys are paired where one exchange put them; very large keys are spread, with equal pairs."""

import random

from tallyclerk.operators import reconcile as R


def tables(spark):
    rng = random.Random(5)

    def rows(size):
        return [(k, rng.choice([None, "x", "y"]), rng.choice([None, 1.5, 2.5, -0.0, 0.0]), rng.choice([None, 1, 2, 3])) for k in range(25) for _ in range(rng.randrange(size if k else 60))]

    return [spark.createDataFrame(rows(7), "k int, u string, v double, w int") for _ in range(2)]


def test_nothing_is_exchanged_after_the_rows_were_dealt(spark):
    a, b = tables(spark)
    paired = R.pair_rows(a, b, ["k"], ["u", "v", "w"])
    paired.collect()
    plan = paired._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # There were two exchanges and a checkpoint for each value.
    assert len([line for line in plan.split("\n") if "Exchange" in line and "ReusedExchange" not in line]) == 1


def test_large_keys_pair_like_others(spark, monkeypatch):
    a, b = tables(spark)

    def costs():
        rows = R.pair_rows(a, b, ["k"], ["u", "v", "w"]).collect()
        out = {}
        for r in rows:
            depth = next((i for i, n in enumerate("uvw") if r[f"{n}_a"] != r[f"{n}_b"]), 3) if r.in_a and r.in_b else -1
            out[r.k, depth] = out.get((r.k, depth), 0) + r.n
        return out

    near = costs()
    monkeypatch.setattr(R, "_HOT", 40)
    mixed = costs()
    monkeypatch.setattr(R, "_HOT", 0)
    assert near == mixed == costs() and len(near) > 50
