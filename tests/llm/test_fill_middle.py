"""Fill-in-the-middle against a plain version, and its boundary set by itself."""

import random

import brute
from pyspark.sql import functions as F

from tallyclerk.llm import fill_middle as fim


def texts():
    rng = random.Random(8)
    out = ["", "a", ".", "é", "abc def", "a<P>b", "x <S>", "<M>", "<S<P <", "\n\t  ", "😀é漢 abc", "a" * 70_000, ". " * 40_000, "ab " * 30_000, "." * (1 << 16), "." * ((1 << 16) + 1)]
    for alphabet in ("ab .", "a" * 30 + " ", "é漢😀a", "<PSM>", "abc"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 7, 60, 400]))) for _ in range(60)]
    out.append("".join(rng.choice("abcde .,\n") for _ in range(300_000)))
    return out


def test_boundary_set():
    rng, kinds = random.Random(9), set()
    for text in texts():
        want, got = brute.boundaries(text), fim.Boundaries(text)
        kinds |= {c.kind for c in got.containers}
        assert len(got) == len(want)
        for k in {0, len(want) - 1, *(rng.randrange(len(want)) for _ in range(20))}:
            assert got.select(k) == want[k]
    assert kinds == {fim.ARRAY, fim.BITMAP, fim.RUNS}


def test_against_plain_version_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (5000, None), (3, "same id, another text"), (4, texts()[4]), (-7, "negative id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "output", "draws", "prefix_chars")}).repartition(4)
    out = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((i, *brute.fill_middle(i, t)) for i, t in rows), key=repr)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_no_mark_arises_across_a_cut(spark):
    pieces = ["<", "<S", "S>", ">", "<P", "M>", "P>", "<M", ""]
    rows = [(i, a + " " + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in pieces for b in pieces for c in pieces)]
    rows = [(i, t) for i, t in rows if not any(m in t for m in ("<P>", "<S>", "<M>"))]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string"), rate=100, spm_rate=50)
    back = {r.doc_id: r.t for r in out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert back == dict(rows)
