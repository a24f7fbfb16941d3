"""Extraction with labels that are a table equals extraction with the same labels in the plan."""

import random

from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.operators.documents import learned_labels
from tallyclerk.operators.extract import extract_fields
from tallyclerk.operators.learned import extract_fields_learned


def fields_of(df):
    rows = df.select("id", F.explode("fields").alias("f")).select("id", "f.*").collect()
    return sorted(((r.id, r.field, r.value, r.raw, r.confidence, r.line, r.label_seen, r.snippet) for r in rows), key=repr)


def test_table_equals_plan(spark):
    rng = random.Random(3)
    learned = [("shipper", "Sender of goods"), ("shipper", "sender of GOODS"), ("consignee", "Sender of goods Agent"), ("consignee", "Taker"), ("shipper", "Taker"), ("shipper", "Total Giver"),
               ("gross_weight_kg", "Heft"), ("gross_weight_kg", "Heft Net"), ("container_count", "Box (pcs)"), ("nonsense", "Taker"), ("shipper", ""), (None, "x"), ("notify_party", "Told")]
    labels = ["Sender of goods", "Sender of goods Agent", "Taker", "Giver", "Total Giver", "Heft", "Heft Net", "Box (pcs)", "Told", "Consignee", "Shipper", "Notify Party", "TOTAL Heft", "Gross Weight"]
    values = ["ACME", "Agent", "Net", "N/A", "", "12 KG", "3 x 40'HC", "Agent Smith & Co", "| odd", "TBA", "Port, Land (ABCDE)", "Ag"]
    rows = [(None, None), ("", "")]
    for i in range(300):
        lines = []
        for _ in range(rng.randint(1, 6)):
            label = rng.choice(labels)
            label = rng.choice([label, label.upper(), label.lower()])
            lines.append(rng.choice(["", "  ", "TOTAL "]) + label + rng.choice([": ", "   ", " ", ":", "\n   ", "\n\n  ", " (x): "]) + rng.choice(values))
        rows.append((f"d{i}", "\n".join(lines)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "id bigint, text string").repartition(3)
    table = spark.createDataFrame(learned, "field string, label_seen string")
    got = fields_of(extract_fields_learned(docs, table, "id"))
    want = fields_of(extract_fields(docs, labels=learned_labels(table), always_thorough=True))
    assert got == want
    assert len({r[6] for r in got}) > 10
    plain = fields_of(extract_fields(docs, labels=V.distinct_labels(), always_thorough=True))
    assert fields_of(extract_fields_learned(docs, table.limit(0), "id")) == plain != got


def test_vocabulary_is_never_broadcast(spark):
    """Estimated as small, a vocabulary grown by explodes would be gathered on the driver."""
    docs = spark.createDataFrame([(1, "BILL OF LADING\nTaker: Acme")], "id bigint, text string")
    table = spark.createDataFrame([("shipper", "Taker"), ("consignee", "Taker Agent")], "field string, label_seen string")
    out = extract_fields_learned(docs, table, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 5
    assert ("shipper", "ACME") in {r[1:3] for r in fields_of(out)}
