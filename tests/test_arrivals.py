"""Messages and documents that arrive over time, in any order, and the review log on results."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_files import TEXT, statuses

from tallyclerk.operators import reviews as W
from tallyclerk.operators.documents import extract_documents, ingest
from tallyclerk.plans.inbox import check_inbox, check_messages
from tallyclerk.sources import inbox as S
from tallyclerk.sources.store import ResultStore
from tallyclerk.streaming.inbox import check_arrivals, read_attachment_stream, read_message_stream

START = 1_700_000_000


def arrivals():
    """(relative path, text, second) of 8 messages and their documents; message 4 lacks its BL, 6 names nothing, 7 asks nothing."""
    files = []
    for i in range(8):
        paths = [f"attachments/email_{i}_SI.txt", f"attachments/email_{i}_BL.txt"] if i < 6 else []
        body = "Please compare the SI and\n draft BL" if i < 7 else "CONGRATULATIONS you won the lottery"
        msg = {"email_id": f"email_{i}", "from": "a@b", "subject": "s", "body": body, "attachments": paths}
        files.append((f"inbox/email_{i}.json", json.dumps(msg, indent=1), 60 * i))
        for j, p in enumerate(paths):
            if (i, j) != (4, 1):
                text = TEXT.format(("SHIPPING INSTRUCTION", "BILL OF LADING")[j], 3 + (i % 2) * j)
                files.append((p, text, 60 * i + (-200 if i % 3 else 300) * (j + 1)))
    return files


def deliver(root, files):
    for path, text, second in files:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)
        os.utime(full, (START + second, START + second))


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_shuffled_arrivals_equal_batch(spark, tmp_path, two_partitions):
    root, files = str(tmp_path), arrivals()
    random.Random(1).shuffle(files)
    for folder in ("inbox", "attachments"):
        os.makedirs(f"{root}/{folder}")
    store = ResultStore(spark, f"{root}/store")

    def turn():
        documents = read_attachment_stream(spark, root)
        texts = extract_documents(ingest(documents, keep=("arrived",)), keep=("arrived",))
        check_arrivals(read_message_stream(spark, root), texts, store, f"{root}/cp", "20 minutes", "30 minutes").awaitTermination(180)

    half = len(files) // 2
    deliver(root, files[:half])
    turn()
    deliver(root, files[half:])
    turn()
    early = statuses(store.read())
    assert early["email_6"] == "NEEDS_REVIEW" and early["email_7"] == "OK"  # not held
    assert "email_4" not in early  # still waits for its BL
    # Time passes for both streams.
    later = {"email_id": "email_9", "from": "a@b", "subject": "s", "body": "lottery", "attachments": []}
    deliver(root, [("inbox/email_9.json", json.dumps(later), 90000), ("attachments/email_9.txt", "x", 90000)])
    turn()
    batch = check_inbox(S.read_messages(spark, root), S.read_attachments(spark, root))
    columns = ["email_id", "status", "review_reason", "has_defect", "defect_fields", "notes"]
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(store.read()) == key(batch)
    assert {r.email_id: r.review_reason for r in store.read().collect()}["email_4"] == "unreadable"


def test_notes_stay_rows_for_a_record_with_very_many_reviews(spark, tmp_path):
    deliver(str(tmp_path), arrivals())
    root = str(tmp_path)
    documents = extract_documents(ingest(S.read_attachments(spark, root)))
    results = check_messages(S.read_messages(spark, root), documents)
    log = spark.range(20000).select(
        F.col("id"), F.lit("email_1").alias("email_id"), F.when(F.col("id") % 2 == 0, "consignee").alias("field"),
        F.col("id").cast("string").alias("corrected_value"), F.when(F.col("id") % 2 == 0, "correct").otherwise("confirm").alias("action"))
    lean = {r.email_id: r for r in W.apply_reviews(results, log, notes=False).collect()}
    full = {r.email_id: r for r in W.apply_reviews(results, log).collect()}
    assert lean["email_1"].reviews == full["email_1"].reviews == 20000
    assert [c.human_correction for c in lean["email_1"].comparisons if c.reviewed] == ["19998"]
    before = len(lean["email_1"].notes)
    assert [n for n in full["email_1"].notes[before:]] == [r.note for r in W.review_notes(results, log).orderBy("id").collect()]
    assert lean["email_0"] == full["email_0"]
    plan = W.apply_reviews(results, log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/inbox") == 0 and plan.count("Join") == 3  # two documents and the log: the check stands once
