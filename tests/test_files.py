"""Files in and out, the store, and the stream."""

import json

from pyspark.sql import functions as F

from tallyclerk.operators.documents import extract_documents, ingest
from tallyclerk.plans.inbox import check_inbox, check_messages, submission
from tallyclerk.sources import inbox as S
from tallyclerk.sources.store import ResultStore
from tallyclerk.streaming.inbox import check_stream, read_message_stream

TEXT = "{}\n\nShipper: ACME CO\nConsignee: B LTD\nNotify: C\nPort of Loading: D\nPort of Discharge: E\nNo. of Containers: {}\nGross Weight: 5 KG\n"


def bundle(root):
    (root / "inbox").mkdir()
    (root / "attachments").mkdir()
    for i in range(6):
        paths = [f"attachments/email_{i}_SI.txt", f"attachments/email_{i}_BL.txt"]
        (root / paths[0]).write_text(TEXT.format("SHIPPING INSTRUCTION", 3))
        if i != 4:
            (root / paths[1]).write_text(TEXT.format("BILL OF LADING", 3 + i % 2))
        msg = {"email_id": f"email_{i}", "from": "a@b", "subject": "s", "body": "Please compare the SI and\n draft BL", "attachments": paths}
        (root / "inbox" / f"email_{i}.json").write_text(json.dumps(msg, indent=1))
    return str(root)


def statuses(df):
    return {r["email_id"]: r["status"] for r in df.select("email_id", "status").collect()}


WANT = {f"email_{i}": "MISMATCH" if i % 2 else "OK" for i in range(6)} | {"email_4": "NEEDS_REVIEW"}


def test_folder_to_submission(spark, tmp_path):
    root = bundle(tmp_path)
    r = check_inbox(S.read_messages(spark, root), S.read_attachments(spark, root))
    assert statuses(r) == WANT
    S.write_submission(r, f"{root}/out")
    back = spark.read.json(f"{root}/out")
    assert back.count() == 6 and "defect_fields" in back.columns
    S.write_reports(r, f"{root}/full")
    assert spark.read.json(f"{root}/full").count() == 6
    assert S.file_inventory(spark, root + "/attachments").filter("extension = '.txt'").count() == 11


def test_records_file(spark, tmp_path):
    p = tmp_path / "truth.json"
    p.write_text(json.dumps({"a": {"category": "SPAM", "status": "OK", "review_reason": None, "has_defect": False, "defect_fields": []}}))
    row = S.read_records(spark, str(p)).first()
    assert (row["email_id"], row["category"], row["has_defect"]) == ("a", "SPAM", False)


def test_readers(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.txt", bytearray(b"y" * 50)), ("c.pdf", bytearray(b"bad")), ("d.txt", None)], "path string, content binary")

    def pdf(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return "text " * 20, True, []

    got = {r["path"]: r for r in ingest(df, {".pdf": pdf}).collect()}
    assert got["a.pdf"]["readable"] and got["a.pdf"]["method"] == "pdf"
    assert got["b.txt"]["readable"] and got["b.txt"]["method"] == "text"
    assert not got["c.pdf"]["readable"] and "broken" in got["c.pdf"]["warnings"][0]
    assert got["d.txt"]["warnings"] == ["attachment not found"]
    bare = {r["path"]: r for r in ingest(df).collect()}
    assert not bare["a.pdf"]["readable"] and bare["a.pdf"]["warnings"] == ["no reader for pdf"]


def test_metrics_and_store(spark, tmp_path):
    m = spark.createDataFrame([("r1", 0.9)], "run string, score double")
    for _ in range(2):
        S.append_metrics(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    store = ResultStore(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "email_id string, status string")
    store.upsert(rows, 1)
    store.upsert(spark.createDataFrame([("a", "2")], rows.schema), 2)
    store.upsert(spark.createDataFrame([("a", "2")], rows.schema), 2)
    assert statuses(store.read()) == {"a": "2", "b": "1"}
    assert statuses(store.compact(str(tmp_path / "t2")).read()) == {"a": "2", "b": "1"}
    store.replace(rows.filter("email_id = 'b'"))
    assert statuses(store.read()) == {"b": "1"}


def test_stream_equals_batch(spark, tmp_path):
    root = bundle(tmp_path)
    docs = extract_documents(ingest(S.read_attachments(spark, root)))
    store = ResultStore(spark, f"{root}/store")
    check_stream(read_message_stream(spark, root, 4), docs, store, f"{root}/cp").awaitTermination(180)
    batch = check_messages(S.read_messages(spark, root), docs)
    assert statuses(store.read()) == statuses(batch) == WANT
    assert submission(store.read()).count() == 6


def test_partitions_do_not_matter(spark, tmp_path):
    root = bundle(tmp_path)
    m, a = S.read_messages(spark, root), S.read_attachments(spark, root)
    assert statuses(check_inbox(m.repartition(1), a.repartition(1))) == statuses(check_inbox(m.repartition(5), a.repartition(7)))
    assert F.col is not None
