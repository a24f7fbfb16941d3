"""Scalar functions on tables of input and expected output."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyclerk.functions import normalize as N
from tallyclerk.functions import text as T


def check(spark, fn, cases, schema="v string"):
    rows = spark.createDataFrame([(v,) for v, _ in cases], schema).select("v", fn(F.col("v")).alias("got")).collect()
    got = {r["v"]: r["got"] for r in rows}
    assert got == dict(cases)


def test_blank(spark):
    yes = ["", "   ", "???", "N/A", "TBA", "TBC", "_______", "____MT", "-", None, "to be advised", " _TBA_ "]
    no = ["0", "SINGAPORE", "3", "_ _TBA"]
    check(spark, N.is_blank, [(v, True) for v in yes] + [(v, False) for v in no])


def test_party(spark):
    check(
        spark,
        N.norm_party,
        [
            ("ACME CO., LTD", "ACME"),
            ("Globex Pte. Ltd.", "GLOBEX"),
            ("INITECH SDN BHD", "INITECH"),
            ("ACME TRADING CO., LTD\n12 HARBOUR RD", "ACME TRADING"),
            ("ACME CO LTD | 12 HARBOUR RD", "ACME"),
            ("UMBRELLA CO., LTD", "UMBRELLA"),
            ("CO LTD", None),
        ],
    )


def test_port(spark):
    check(
        spark,
        N.norm_port,
        [
            ("MOMBASA, KENYA (KEMBA)", "MOMBASA KENYA"),
            ("TUTICORIN, INDIA (KEMBA)", "TUTICORIN INDIA"),
            ("Singapore  (SGSIN)", "SINGAPORE"),
            ("Port Klang (Westport), Malaysia (MYPKG)", "PORT KLANG WESTPORT MALAYSIA"),
            ("busan (krpus)", "BUSAN KRPUS"),
        ],
    )


def test_count(spark):
    cases = [("3", 3), ("3 x 40'HC", 3), ("THREE", 3), ("Four", 4), ("1,0", 10), ("several", None), ("TWO 7", 2), ("007", 7), ("0", 0)]
    check(spark, N.norm_count, cases)
    check(spark, N.count_text, [("0" * 3 + "9" * 30, "9" * 30), ("none", "")])


def test_weight(spark):
    cases = [
        ("22,000 KG", 22000), ("22000", 22000), ("22000.00 kgs", 22000), ("131,322 KG", 131322), ("22 MT", 22000),
        ("48501 LBS", 22000), ("0.5 KG", 0), ("1.5 KG", 2), ("2.5 KG", 2), ("none", None), ("1.5 TONNES", 1500),
    ]
    check(spark, N.norm_weight, cases)
    check(spark, N.weight_text, [("9" * 25 + " KG", "1" + "0" * 25)])


def test_fold_matches_nfkc(spark):
    texts = ["Gross Weight毛重(KGS):", "Ｓhipper：ACME", "㎏", "é é x́", "ﬁne print", "plain", "½ kg", "Ⅳ", "𝐁old"]
    want = {t: "".join(c for c in unicodedata.normalize("NFKC", t) if ord(c) < 128).strip() for t in texts}
    check(spark, T.strip_non_ascii, list(want.items()))


def test_fold_class_covers_every_code_point(spark):
    points = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    hard = [chr(c) for c in points if any(ord(x) < 128 for x in unicodedata.normalize("NFKC", chr(c)))]
    df = spark.createDataFrame([(c,) for c in hard], "c string")
    assert df.filter(~F.col("c").rlike(T.FOLDS_TO_ASCII)).count() == 0


def test_decode_ladder(spark):
    blobs = [b"plain", "毛重".encode(), b"caf\xe9 \x80", b"\x81\xe9", b"", b"\xef\xbb\xbfx"]

    def ladder(b):
        for enc in ("utf-8", "cp1252", "latin-1"):
            try:
                return b.decode(enc)
            except UnicodeDecodeError:
                pass

    rows = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary").select("b", T.decode_bytes("b").alias("t")).collect()
    assert {bytes(r["b"]): r["t"] for r in rows} == {b: ladder(b) for b in blobs}


@pytest.mark.parametrize("path,ext", [("a/b.PDF", ".pdf"), ("a.b/c", ""), ("x/.hidden", ""), ("r.tar.gz", ".gz")])
def test_extension(spark, path, ext):
    check(spark, T.extension, [(path, ext)])
