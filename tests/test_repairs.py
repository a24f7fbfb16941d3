"""Cases found in review: linear gates, paths, stores, keys, labels, model hooks, snapshots."""

import random
import time

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_files import WANT, bundle, statuses

from tallyclerk import vocab as V
from tallyclerk.functions import text as T
from tallyclerk.operators import classify as C
from tallyclerk.operators import documents as D
from tallyclerk.operators import evaluate as E
from tallyclerk.operators import predict as P
from tallyclerk.operators import reconcile as R
from tallyclerk.operators import report
from tallyclerk.operators import reviews as W
from tallyclerk.operators.extract import extract_fields
from tallyclerk.plans.inbox import check_inbox, check_messages, recheck_inbox
from tallyclerk.sources import inbox as S
from tallyclerk.sources import store as ST
from tallyclerk.streaming import inbox as stream


def test_text_gate_is_linear(spark):
    df = spark.createDataFrame([("=" * 200_000,), ("alpha b2c (delta) epsilon " * 4,)], "t string")
    df.select(T.is_poor("t")).collect()
    start = time.time()
    got = [r[0] for r in df.select(T.is_poor("t")).collect()]
    assert got == [True, False] and time.time() - start < 3


def test_paths_are_taken_as_they_are(spark, tmp_path):
    root = tmp_path / "box"
    nested = root / "attachments" / "box" / "attachments"
    nested.mkdir(parents=True)
    names = ["p%41q.txt", "x%zz.txt", "a+b c.txt", "box/attachments/n.txt"]
    for n in names:
        (root / "attachments" / n).write_text("x")
    got = {r["path"] for r in S.read_attachments(spark, str(root)).collect()}
    assert got == {"attachments/" + n for n in names}


def test_nan_confidence(spark):
    row = spark.range(1).select(C.validated_answer(F.lit("SPAM"), F.lit("NaN")).alias("a"), C.validated_answer(F.lit("SPAM"), F.lit("7")).alias("b")).first()
    assert (row.a.confidence, row.b.confidence) == (0.0, 1.0)


def test_reconcile_odd_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (None, "x"), (3, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "x"), (3, "y"), (4, "x")], "k int, v string")
    got = sorted((r.k or 0, r.status, r.review_reason or "") for r in R.reconcile(a, b, ["k"], ["v"]).collect())
    assert got == [
        (0, "NEEDS_REVIEW", "null_key"), (0, "NEEDS_REVIEW", "null_key"), (1, "OK", ""), (2, "NEEDS_REVIEW", "repeated_key"),
        (3, "MISMATCH", ""), (4, "NEEDS_REVIEW", "missing_value")]


def test_store_keeps_what_it_has(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "email_id string, status string, n int")
    store = ST.ResultStore(spark, str(tmp_path / "a"))
    store.upsert(rows(("a", "1", 1), ("a", "2", 2), ("b", "1", 1)), 0, ST.writer_of("/cp1"), ["n"])
    store.upsert(rows(("c", "1", 1)), 0, ST.writer_of("/cp2"))
    assert statuses(store.read()) == {"a": "2", "b": "1", "c": "1"}
    store.upsert(rows(("a", "3", 1)), 1, ST.writer_of("/cp2"))
    store.upsert(rows(("a", "1", 1), ("a", "2", 2), ("b", "1", 1)), 0, ST.writer_of("/cp1"), ["n"])  # a batch repeated later stays where it was
    assert statuses(store.read()) == {"a": "3", "b": "1", "c": "1"}
    fresh = store.compact(str(tmp_path / "b"))
    fresh.upsert(rows(("x", "9", 1)), 0)
    fresh.upsert(rows(("b", "9", 1)), 0, ST.writer_of("/cp3"))
    assert statuses(fresh.read()) == {"a": "3", "b": "9", "c": "1", "x": "9"}


def test_store_log(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    rows = lambda *r: spark.createDataFrame(list(r), "email_id string, status string")
    store = ST.ResultStore(spark, str(tmp_path / "a"))
    store.upsert(rows(("a", "0")), 0)
    with monkeypatch.context() as m:  # an upsert reads no data
        m.setattr(ST.ResultStore, "changes", lambda self: 1 / 0)
        store.upsert(rows(("a", "1"), ("b", "1")), 1)
        store.upsert(rows(("a", "0")), 0)  # repeated, so it stays behind
        # Writers at once take versions of their own.
        with ThreadPoolExecutor(6) as pool:
            list(pool.map(lambda i: store.upsert(rows((f"w{i}", "x"), ("last", str(i))), 7, f"writer{i}"), range(6)))
    stored = store.changes().select("writer", "batch", "version").distinct().collect()
    assert len(stored) == 8 and [r.version for r in stored if r.writer == "main" and r.batch == 0] == [1]
    newest = max((r.version, r.writer) for r in stored)[1]
    assert {r.email_id: r.status for r in store.read().collect()} == {"a": "1", "b": "1", **{f"w{i}": "x" for i in range(6)}, "last": newest[-1]}
    # A store from before there was a log gets one; one that cannot be read is not taken for an empty one.
    old = ST.ResultStore(spark, str(tmp_path / "old"))
    rows(("a", "5")).withColumn("version", F.lit(9).cast("bigint")).write.parquet(f"{tmp_path}/old/writer=main/batch=3")
    old.upsert(rows(("a", "6")), 4)
    assert [r.status for r in old.read().collect()] == ["6"]
    odd = ST.ResultStore(spark, str(tmp_path / "odd"))
    spark.range(3).write.parquet(f"{tmp_path}/odd/writer=main/batch=1")
    with pytest.raises(AnalysisException):
        odd.upsert(rows(("a", "1")), 2)


def test_rules_as_a_long_table(spark, monkeypatch):
    phrases = [(i, "C", f"WORD {i} END", 0.5) for i in range(300)] + [(400, "D", "W", 0.1), (401, "D", "", 0.1), (402, "D", None, 0.1)]
    rules = spark.createDataFrame(phrases, "priority int, category string, phrase string, confidence double")
    bodies = [(str(i), f"X WORD {i * 7 % 400} END, WORD {i} END") for i in range(200)] + [("n", None), ("e", ""), ("w", "W"), ("z", "nothing")]
    messages = spark.createDataFrame(bodies, "email_id string, canonical_body string")
    short = {r.email_id: r.rule and r.rule.evidence for r in C.match_rules_table(messages, rules).collect()}
    monkeypatch.setattr(C, "BROADCAST_RULES", 10)
    assert {r.email_id: r.rule and r.rule.evidence for r in C.match_rules_table(messages, rules).collect()} == short
    assert short["0"] == "WORD 0 END" and short["w"] == "W" and short["n"] is short["e"] is short["z"] is None


def test_a_worker_holds_one_block_of_rules(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_RULES", 2)
    monkeypatch.setattr(C, "AUTOMATON_CHARS", 12)
    rules = spark.createDataFrame([(n, "SPAM", f"W{n:02}", 0.5) for n in range(20)] + [(3, "SPAM", "W17", 0.5)], "priority int, category string, phrase string, confidence double")
    bodies = [(n, " ".join(f"W{m:02}" for m in range(19, n - 1, -1))) for n in range(20)] + [(20, "none"), (21, None), (22, "W17")]
    messages = spark.createDataFrame(bodies, "id int, canonical_body string").repartition(3)
    got = C.match_rules_table(messages, rules)
    # One Python stage a block used to stand in the plan, each with a worker and an automaton.
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    want = {n: f"W{n:02}" if n <= 3 else "W17" for n in range(18)} | {18: "W18", 19: "W19", 20: None, 21: None, 22: "W17"}
    assert {r.id: r.rule and r.rule.evidence for r in got.collect()} == want


def fields_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = extract_fields(df, **options).orderBy("i").collect()
    return [{f.field: (f.value, f.confidence, f.line, f.label_seen) for f in r.fields} for r in rows]


def test_labels_shared_and_many(spark):
    shared = V.distinct_labels({"shipper": ["Party name"], "consignee": ["Party name"]})
    quick = fields_of(spark, ["Party name: ACME"], labels=shared)
    assert quick == fields_of(spark, ["Party name: ACME"], labels=shared, always_thorough=True)
    assert quick[0]["shipper"][0] == quick[0]["consignee"][0] == "ACME"
    many = V.distinct_labels({"shipper": [f"Zq{i:05}" for i in range(4200)]})
    got = fields_of(spark, ["Zq04190: ACME"], labels=many)[0]
    assert got["shipper"][0] == "ACME" and got["shipper"][3] == "Zq04190" and got["consignee"][0] is None


def test_quick_and_thorough_agree(spark):
    rng = random.Random(11)
    extra = {"shipper": ["Party name"], "consignee": ["Party name"]}
    labels = V.distinct_labels(extra)
    known = [x for xs in labels.values() for x in xs]
    texts = []
    for _ in range(400):
        lines = []
        for _ in range(rng.randint(1, 9)):
            label = rng.choice(known)
            head = rng.choice(["", "", "TOTAL ", "TOTAL TOTAL ", "  "]) + rng.choice([label, label.upper(), label.lower()])
            value = rng.choice(["ACME CO", "12,500 KG", "5", "TBA", "", "SINGAPORE (SGSIN)", "| x", "3 x 40'HC"])
            lines.append(head + rng.choice([": ", "   ", " ", ":\n   ", "\n  ", " (KGS): "]) + value)
        texts.append("\n".join(lines))
    texts += ["TOTAL Total Containers: 5", "TOTAL TOTAL Gross Weight (KG): 7 KG"]
    quick, thorough = fields_of(spark, texts, labels=labels), fields_of(spark, texts, labels=labels, always_thorough=True)
    different = [(t, f, a[f], b[f]) for t, a, b in zip(texts, quick, thorough) for f in a if a[f] != b[f]]
    assert not different, (len(different), different[:3])


def test_own_normalizers(spark):
    got = fields_of(spark, ["Shipper: Acme Co"], normalizers={"shipper": lambda c: F.lower(c)})[0]
    assert got["shipper"][0] == "acme co"


def test_recheck_opens_only_what_is_asked(spark, tmp_path):
    root = bundle(tmp_path)
    ST.snapshot_sources(S.read_messages(spark, root), S.read_attachments(spark, root), f"{root}/kept")
    messages, attachments = ST.stored_sources(spark, f"{root}/kept")
    old = check_inbox(messages, attachments).withColumn("status", F.lit("OLD"))
    ids = spark.createDataFrame([("email_1",), ("email_4",), ("gone",)], "email_id string")
    opened = spark.sparkContext.accumulator(0)

    def reader(raw):
        opened.add(1)
        return raw.decode(), True, []

    pdf = attachments.withColumn("path", F.regexp_replace("path", r"\.txt$", ".pdf"))
    renamed = messages.withColumn("attachments", F.transform("attachments", lambda a: F.regexp_replace(a, r"\.txt$", ".pdf")))
    out = recheck_inbox(old, renamed, pdf, ids, readers={".pdf": reader})
    assert statuses(out) == {k: (WANT[k] if k in ("email_1", "email_4") else "OLD") for k in WANT}
    assert 3 <= opened.value <= 6  # two documents of one message, one of the other; once or twice


def test_reviews_are_kept(spark, tmp_path):
    root = bundle(tmp_path)
    r = check_inbox(S.read_messages(spark, root), S.read_attachments(spark, root))
    log = spark.createDataFrame(
        [(1, "email_1", "container_count", "3", "correct"), (2, "email_1", None, None, "confirm"), (3, "email_0", "vessel", "EVER", "correct"), (4, "email_0", None, None, "dismiss")],
        "id bigint, email_id string, field string, corrected_value string, action string")
    W.append_reviews(log, f"{root}/log")
    W.append_reviews(log.filter("id = 9"), f"{root}/log")
    stored = spark.read.parquet(f"{root}/log")
    assert stored.count() == 3 and stored.filter("created_at IS NULL").count() == 0
    done = {x.email_id: x for x in W.apply_reviews(r, stored).collect()}
    assert done["email_1"].status == "OK" and len(done["email_1"].notes) == 3 and "container_count" in done["email_1"].notes[1]
    assert done["email_0"].human_corrections == {"vessel": "EVER"} and len(done["email_2"].notes) == 1
    assert all(c.si.file == "attachments/email_1_SI.txt" for c in done["email_1"].comparisons)


def test_runs_and_summary(spark, tmp_path):
    root = bundle(tmp_path)
    r = check_inbox(S.read_messages(spark, root), S.read_attachments(spark, root))
    sub = r.select("email_id", F.col("classification.category").alias("category"), "status", "review_reason", "has_defect", "defect_fields")
    score = E.final_score(E.score_join(sub, sub))
    run = E.run_record(r, score, "d", 42, requested_n=6, llm_enabled=False, rules_score=0.9)
    run.write.mode("append").parquet(f"{root}/runs")
    back = spark.read.parquet(f"{root}/runs")
    one = back.first()
    assert (one.processed, one.ok, one.mismatches, one.needs_review, one.evaluation.final_score > 0.6) == (6, 2, 3, 1, True)
    assert E.newest(back, "created_at", 0).count() == 1 and E.newest(spark.range(99), "id", 500).count() == 50
    rows = {(x.section, x.name): x.value for x in report.validation_summary(back, E.status_counts(r)).collect()}
    assert rows["volume", "ok"] == "2" and rows["selected_run", "seed"] == "42" and rows["dashboard_snapshot", "total"] == "6"
    S.write_csv(report.validation_summary(back, E.status_counts(r)), f"{root}/csv")


def test_lines_shown(spark, tmp_path):
    root = bundle(tmp_path)
    texts = D.ingest(S.read_attachments(spark, root))
    r = check_messages(S.read_messages(spark, root), D.extract_documents(texts))
    ids = spark.createDataFrame([("email_1",)], "email_id string")
    lines = report.highlighted_lines(r, texts, ids).collect()
    assert {x.email_id for x in lines} == {"email_1"} and len(lines) == 2 * len(TEXT_LINES)
    marked = {(x.which, x.line): x.line_text for x in report.marked_lines(r).filter("email_id = 'email_1'").collect()}
    assert marked == {(x.which, x.line): x.line_text for x in lines if x.marks}


TEXT_LINES = "title\n\n1\n2\n3\n4\n5\n6\n7\n".split("\n")


def test_model_hooks(spark):
    messages = spark.createDataFrame(
        [(f"m{i}", "a@b", "s", f"hello {i % 3}", []) for i in range(9)], "email_id string, `from` string, subject string, body string, attachments array<string>")
    empty = spark.createDataFrame([], "prompt_key string, category string, confidence double, why string")

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"prompt_key": pdf["prompt_key"], "category": "SPAM", "confidence": 0.9, "why": "w"})

    answers, fresh = P.answer_unsure(C.classify(messages), empty, model)
    assert fresh.count() == 3 and {(r.category, r.confidence) for r in answers.collect()} == {("SPAM", 0.9)} and answers.count() == 9
    prompts = P.batch_prompts(messages, size=4).collect()
    assert sorted(len(p.ids) for p in prompts) == [1, 4, 4] and prompts[0].prompt.startswith("--- id: m")

    docs = spark.createDataFrame([("p", "SHIPPING INSTRUCTION\nShipper: ACME CO LTD AND SOME MORE WORDS", "text", True, [])], "path string, text string, method string, readable boolean, warnings array<string>")
    found = D.extract_documents(docs)
    asked = D.ask_missing(docs.join(found.select("path", "fields"), "path"), lambda text, names: {"consignee": ("B LTD", 0.99), "shipper": ("NO", 1.0)})
    guesses = asked.first().guesses
    assert [g.field for g in guesses] == ["consignee"]
    filled = D.extract_documents(asked.drop("fields"), recovered=True).first().fields
    assert {f.field: f.value for f in filled}["consignee"] == "B" and {f.field: f.method for f in filled}["consignee"] == "llm"


def test_stream_counts_and_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, "OK" if i % 2 else "MISMATCH", f"2024-01-01 00:{i:02}:00") for i in range(20)], "id int, status string, ts string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, status string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(stream.dedupe_stream(source, "id", "ts", "1 hour"), "deduped", "append")) == 5
    counts = run(stream.counts_stream(source, "ts", "10 minutes", "1 minute"), "counted", "complete")
    assert sorted((r.total, r.ok, r.mismatches) for r in counts) == [(10, 5, 5), (10, 5, 5)]


@pytest.mark.parametrize("times", [1, 2])
def test_stream_takes_the_newest_copy(spark, tmp_path, times):
    schema = "email_id string, `from` string, subject string, body string, attachments array<string>, n int"
    versions = [("m", "a", "s", "nothing", [], 1), ("m", "a", "s", "You have won: congratulations", [], 2)]
    for i in range(times):
        spark.createDataFrame(versions, schema).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    docs = D.extract_documents(spark.createDataFrame([], "path string, text string, method string, readable boolean, warnings array<string>"))
    store = ST.ResultStore(spark, str(tmp_path / "store"))
    stream.check_stream(source, docs, store, str(tmp_path / "cp"), order=["n"]).awaitTermination(120)
    assert [r.classification.category for r in store.read().collect()] == ["SPAM"]
