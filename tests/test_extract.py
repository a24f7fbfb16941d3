"""Extraction corner cases, both paths, and the verdict rules."""

from pyspark.sql import functions as F

from tallyclerk.operators.extract import doc_type, extract_fields

DOCS = {
    "wrapped_beats_colon": ("Shipper: LATER CO\nShipper\n   FIRST CO\n", {"shipper": ("FIRST", 0.80, 3)}),
    "first_label_beats_form": ("Shipper: A\nShipper/Exporter B\n", {"shipper": ("B", 0.70, 2)}),
    "unindented_is_no_value": ("Consignee\nNOT INDENTED\nConsignee: REAL\n", {"consignee": ("REAL", 0.95, 3)}),
    "only_first_alone_line": ("Consignee\nX\nConsignee\n   SECOND\n", {"consignee": (None, 0.0, -1)}),
    "blank_line_between": ("Notify Party\n\n   CERIEX\n", {"notify_party": ("CERIEX", 0.80, 3)}),
    "fragment": ("Notify Party/Intermediate Consignee\nCERIEX\n", {"notify_party": (None, 0.0, -1)}),
    "blank_stops": ("Gross Weight (KG): TBA\nGross Weight: 5 KG\n", {"gross_weight_kg": (None, 0.0, 1)}),
    "unusable_goes_on": ("No. of Containers: several\nContainer Count: 4\n", {"container_count": ("4", 0.95, 2)}),
    "unusable_same_label": ("Container Count: many\nContainer Count  7\n", {"container_count": ("7", 0.85, 2)}),
    "total_prefix": ("TOTAL  Gross Wt (kgs): 1,200\n", {"gross_weight_kg": ("1200", 0.95, 1)}),
    "noise": ("Gross Weightnn(KGS): 9 KG\n", {"gross_weight_kg": ("9", 0.95, 1)}),
    "pipe_skipped": ("Shipper: | x\nShipper: REAL\n", {"shipper": ("REAL", 0.95, 2)}),
    "suffix_only_skipped": ("Shipper: CO LTD\nShipper: ACME LTD\n", {"shipper": ("ACME", 0.95, 2)}),
    "crlf": ("Shipper: ACME\r\nPOL: X\r\n", {"shipper": ("ACME", 0.95, 1), "port_of_loading": ("X", 0.95, 2)}),
}


def run(spark, **options):
    df = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "id string, text string")
    return {r["id"]: {f["field"]: f for f in r["fields"]} for r in extract_fields(df, **options).collect()}


def test_priorities(spark):
    got = run(spark)
    for name, (_, want) in DOCS.items():
        for field, (value, confidence, line) in want.items():
            f = got[name][field]
            assert (f["value"], f["confidence"], f["line"]) == (value, confidence, line), name


def test_quick_and_thorough_agree(spark):
    assert run(spark) == run(spark, always_thorough=True)


def test_learned_label(spark):
    from tallyclerk import vocab as V

    labels = V.distinct_labels({"shipper": ["Sender of goods"]})
    df = spark.createDataFrame([("Sender of goods: ACME\n",)], "text string")
    row = extract_fields(df, labels=labels).select(F.col("fields")[0]["value"].alias("v")).first()
    assert row["v"] == "ACME"


def test_doc_type(spark):
    cases = {"PACKING LIST for bill of lading": "OTHER", "Shipping Instruction": "SI", "Bill of Lading": "BL", "x": "UNKNOWN", "y" * 500 + "BILL OF LADING": "UNKNOWN"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", doc_type("t").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == cases


def test_scanned_values_never_mismatch(spark):
    from tallyclerk.plans.inbox import check_messages
    from tallyclerk.operators.documents import extract_documents

    body = "\nShipper: A CO\nConsignee: B\nNotify: C\nPort of Loading: D\nPort of Discharge: E\nNo. of Containers: 6\nGross Weight 128{}544 KG"
    docs = spark.createDataFrame(
        [("a", "SHIPPING INSTRUCTION" + body.format("."), "ocr", True, []), ("b", "BILL OF LADING" + body.format(","), "text", True, [])],
        "path string, text string, method string, readable boolean, warnings array<string>",
    )
    msgs = spark.createDataFrame([("m", "x", "s", "Please compare the SI and draft BL", ["a", "b"])], "email_id string, `from` string, subject string, body string, attachments array<string>")
    r = check_messages(msgs, extract_documents(docs)).first()
    assert (r["status"], r["review_reason"]) == ("NEEDS_REVIEW", "unreadable")
    assert {c["status"] for c in r["comparisons"]} == {"uncertain"}


def test_exploding_fields_does_not_compute_them_twice(spark):
    from tallyclerk.operators.documents import extract_documents, field_rows

    docs = spark.createDataFrame([("p", "Shipper: ACME\nConsignee: B and many more words", "text", True, [])], "path string, text string, method string, readable boolean, warnings array<string>")
    rows = field_rows(extract_documents(docs.repartition(2)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # The filter that an explode brings along held a copy of the fields' whole expression.
    assert not [line for line in plan if line.lstrip(" :+-").startswith("Filter") and "transform(" in line]
    assert rows.filter("value = 'ACME'").count() == 1


def test_leaders_agree_with_the_contest_on_odd_lines(spark):
    texts = [
        "TOTAL TOTAL Gross Weight (KG): 5 KG", "TOTAL\tcontainers\t\t7", "TOTAL", "\x1cShipper\x1f:\x1eACME\x1d", "Shipper", "Shipper\n\n",
        "Shipper\n\u3000WIDE SPACE", "Shipper\n\x85NEXT LINE", "Ｓｈｉｐｐｅｒ： ＡＣＭＥ", "Shipper毛重: A\nShipper: B", "POL (x): _ _TBA", "POL (x) : __-__",
        "Notify  Party/Intermediate Consignee", "Notify: \nNotify Party: X", "Consignee::: Y", "Consignee|z", "shipper\r\n  a\r", "Gross Weight\n \n \n 5",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    quick, thorough = [extract_fields(df, always_thorough=t).orderBy("i").collect() for t in (False, True)]
    for text, a, b in zip(texts, quick, thorough):
        assert a["fields"] == b["fields"], text


def test_text_that_is_not_utf8(spark):
    df = spark.range(1).select(F.expr("cast(unhex('536869707065723A2041FF43') as string)").alias("text"))
    assert extract_fields(df).select(F.col("fields")[0]["value"].alias("v")).first()["v"] == "AC"


def test_a_summary_brings_only_values_to_the_join(spark):
    from tallyclerk.operators.documents import extract_documents
    from tallyclerk.operators.report import inbox_summary
    from tallyclerk.plans.inbox import check_messages

    docs = spark.createDataFrame([("a", "x", "text", True, [])], "path string, text string, method string, readable boolean, warnings array<string>")
    msgs = spark.createDataFrame([("m", "x", "s", "y", ["a", "b"])], "email_id string, `from` string, subject string, body string, attachments array<string>")
    plan = inbox_summary(check_messages(msgs, extract_documents(docs)))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sides = [line for line in plan if " AS _path#" in line and "path#" in line.split(" AS _path#")[0][-12:]]
    # Whole documents, with every snippet and line, used to go through both joins.
    assert len(sides) == 2 and not [line for line in sides if "struct(path" in line]
