"""The check reads each document once, and brings to its joins no more than was asked for."""

import pytest
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.normalize import NORMALIZERS
from tallyclerk.operators import report as P
from tallyclerk.operators import reviews as W
from tallyclerk.operators.documents import extract_documents
from tallyclerk.operators.extract import _ascii_normalizers
from tallyclerk.operators.numbering import written
from tallyclerk.plans.inbox import check_messages

BODY = "\nShipper: A CO\nConsignee: {}\nNotify: C\nPort of Loading: D\nPort of Discharge: E\nNo. of Containers: {}\nGross Weight: 5 KG"


@pytest.fixture
def inbox(spark):
    texts = spark.createDataFrame(
        [("a", "SHIPPING INSTRUCTION" + BODY.format("B", 6), "text", True, []), ("b", "BILL OF LADING" + BODY.format("X", 7), "text", True, []),
         ("c", "BILL OF LADING" + BODY.format("B", 6), "ocr", True, []), ("d", "BILL OF LADING" + BODY.format("TBA", 6), "text", True, [])],
        "path string, text string, method string, readable boolean, warnings array<string>")
    rows = [("m1", "Please compare the SI and draft BL", ["a", "b"]), ("m2", "Please compare the SI and draft BL", ["a", "c"]),
            ("m3", "Please compare the SI and draft BL", ["a", "gone"]), ("m4", "hello", []), ("m5", "x", ["a", "d"]), ("m6", "x", ["a", None])]
    return spark.createDataFrame(rows, "email_id string, body string, attachments array<string>"), texts


def rows(df):
    return sorted(map(str, df.collect()))


def test_documents_are_extracted_once(spark, inbox):
    messages, texts = inbox
    log = spark.createDataFrame([(1, "m1", "confirm", None, None)], "id long, email_id string, action string, field string, corrected_value string")
    whole = check_messages(messages, extract_documents(texts.repartition(2)))
    for df in (whole.select("email_id", "notes"), P.review_export(whole), P.first_mismatch(whole), W.apply_reviews(whole, log)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # The joins were given other columns of the documents, so each extracted them for itself.
        assert plan.count("ArrowEvalPython [") == 1


def test_narrow_comparisons_say_the_same(inbox):
    messages, texts = inbox
    whole = check_messages(messages, extract_documents(texts))
    some = check_messages(messages, extract_documents(texts, readings=("value", "line")), readings=("value", "line"))
    assert some.schema["comparisons"].dataType.elementType["si"].dataType.names == ["value", "line"]
    assert rows(P.first_mismatch(some)) == rows(P.first_mismatch(whole)) != []
    cols = ("email_id", "record_status", "field", "status", "reason", "si_value", "bl_value", "si_line", "bl_line")
    assert rows(P.comparison_rows(some).select(*cols)) == rows(P.comparison_rows(whole).select(*cols)) != []
    bare = check_messages(messages, extract_documents(texts, readings=()), readings=())
    assert bare.schema["comparisons"].dataType.elementType.names == ["field", "status", "reason"]
    assert rows(bare.drop("comparisons")) == rows(whole.drop("comparisons"))
    assert rows(P.review_export(bare)) == rows(P.review_export(whole))


def test_quick_normalizers_equal_the_columns(spark):
    said = ["ACME Pte. Ltd", "A_B_LTD x", "LTD_ CO|y", "co", "", "  ", "Port (ABCDE), x (abcde)", "((ABCDE))", "3 x 40'HC", "0007", "THREE and two", "TWO_1 9", "one", "no",
            "1,234.50 KG", "12.5 MT", "7 LB", "2 LBS TONNE", "5.5.5 TON", "x.5", "0.5", "1.5", "2.5 kg", "999999999999999", "1000000000000000", "1" * 50, "1e5", "\x1f9\x00MT", "A&B-CO.", "S.A. x", "MT5", "5 mt"]
    df = spark.createDataFrame([(x,) for x in said], "v string")
    for field, quick in _ascii_normalizers().items():
        for r in df.select("v", NORMALIZERS[field](F.col("v")).alias("n")).collect():
            got = quick(r["v"])
            assert got == r["n"] or got is None and field in V.WEIGHT_FIELDS and len(r["n"]) > 15, (field, r["v"])


def test_written_table_is_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(1)
            yield b

    df = written(spark.range(3, numPartitions=1).mapInArrow(count, "id long"))
    assert sorted(r[0] for r in df.union(df).collect()) == [0, 0, 1, 1, 2, 2]
    assert runs.value == 1 and df.schema.names == ["id"]
