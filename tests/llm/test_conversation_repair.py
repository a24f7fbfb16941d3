"""Conversation repair against a plain version."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyclerk.llm import conversation_repair as cr
from tallyclerk.llm import queries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, costs=cr.Costs()):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    return {c: brute.repaired(r, costs) for c, r in by.items()}


def some_rows(n, seed):
    rng = random.Random(seed)
    roles, words = ["system", "user", "assistant", "user", "assistant", "tool", "", "User"], ["yes.", "no", "why?", " ", "", "go! \n", "a ", "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            role = rng.choice(roles) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn + rng.choice([0, 0, 2]), role, rng.choice(words) if rng.random() < 0.5 else f"{conv} {turn} ok."))
    rows += [(None, 1, "user", "hi."), (None, None, None, None), (None, None, "system", "be kind."), (n, -(1 << 63), "user", "low."), (n, (1 << 63) - 1, "assistant", "high.")]
    rows += [(n + 1, t, "user", "same") for t in range(40)] + [(n + 1, 3, "user", "same")] * 3 + [(n + 2, None, "user", "a."), (n + 2, None, "user", "a.")]
    return rows


def outcome(df, costs=cr.Costs()):
    found, rows = cr.repair(df, costs)
    lines = {r.conv_id: r.sha256 for r in cr.digests(rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines.get(r.conv_id, empty)) for r in found.collect()}


def wanted(rows, costs=cr.Costs()):
    limit = (1 << 63) - 1
    return {c: (min(x[0], limit), *x[1:7], hashlib.sha256("\n".join(x[7]).encode()).hexdigest()) for c, x in plain(rows, costs).items()}


@pytest.mark.parametrize("costs", [cr.Costs(), cr.Costs(delete=20), cr.Costs(0, 7, 9, 2, 3), cr.Costs(1, 1, 1, 1, 1)])
def test_tables(costs):
    rng, known = random.Random(2), cr.Tables(costs)
    assert known.block_before.shape[1] == cr.SYMBOLS**cr.BLOCK
    for _ in range(1500):
        symbols = [rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 40]))]
        texts = [" " if s == cr.GONE else f"{i}." if s % 2 == 0 else str(i) for i, s in enumerate(symbols)]
        rows = [(i, "-" if s == cr.GONE else cr.ROLES[s // 2], t) for i, (s, t) in enumerate(zip(symbols, texts))]
        cost, actions = known.repair(np.array(symbols, np.int64))
        assert (cost, "".join(actions).translate(str.maketrans("UAua", "RRII"))) == brute.repaired(rows, costs)[5:7]


def test_against_plain_version(spark, monkeypatch):
    rows = some_rows(150, 1)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(0) for c in ("n", "part", "first", "codes", "action", "_kind")}).repartition(4)
    assert outcome(df) == wanted(rows)
    monkeypatch.setattr(cr, "PIECE", 4)  # conversations over several pieces
    assert outcome(df, cr.Costs(delete=9)) == wanted(rows, cr.Costs(delete=9))
    assert outcome(df.limit(0)) == {}


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["ok.", f"{i}.", f"{i}", "same."])) for i in range(9000)] + [(2, 0, "user", "x.")]
    assert outcome(spark.createDataFrame(rows, TURNS).repartition(5)) == wanted(rows)


def test_query_on_damaged_rows(spark, tmp_path):
    rows = some_rows(60, 7) + [(900, 38, "user", "gone")]
    dropped = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    lone = next(c for c in range(1000, 2000) if dropped(c, 0) == 0)
    rows.append((lone, 0, "user", "nothing of this stays."))
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    damaged = []
    for conv, turn, role, text in rows:
        kind, role, text = dropped(conv, turn), " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = wanted(damaged)
    for conv in {r[0] for r in rows} - want.keys():
        want[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    out = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == want and len(out) == len(want)
    assert want[lone][6] == ""
