"""Queries over the rendered corpus: classification, extraction, verdicts, reports, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions import text as T
from tallyclerk.operators import classify as C
from tallyclerk.operators import documents as D
from tallyclerk.operators import evaluate as E
from tallyclerk.operators import reconcile as R
from tallyclerk.operators import report as P
from tallyclerk.operators import reviews as W
from tallyclerk.operators.extract import doc_type
from tallyclerk.operators.numbering import written
from tallyclerk.plans import corpus as K
from tallyclerk.plans import inbox as I
from tallyclerk.plans.queries_text import FIELD_LIST, LOG_SQL, read, review_events
from tallyclerk.plans.registry import COMPARED_SQL, FIELDS_SQL, SHIP_SQL, query, with_


def inbox(spark, sf):
    return K.messages(K.shipments(spark, sf))


def documents(spark, sf):
    return K.document_text(K.shipments(spark, sf))


def results(spark, sf):
    """The check of all messages, for what needs no more of the documents than the verdicts on them."""
    return results_with(spark, sf)


def results_with(spark, sf, *readings):
    """The check of all messages; comparisons hold these parts of what either document says, so no others travel."""
    ships = written(K.shipments(spark, sf))
    documents = D.extract_documents(K.document_text(ships), readings=readings)
    return I.check_messages(K.messages(ships), documents, readings=readings)


def scored(spark, sf):
    """Truth joined to what the check reports, from the planted columns."""
    ships = K.shipments(spark, sf)
    t = K.truth(ships)
    fixes = F.when(F.col("kind").isin("pair", "silent"), F.col("defect"))
    category = F.when(F.col("kind") == "invoice_trap", "INVOICE_QUERY").when(F.col("kind") == "quiet_spam", "GENERAL")
    sub = ships.select(
        K.email_id().alias("email_id"),
        category.alias("_c"),
        fixes.isNotNull().alias("_d"),
        F.array_compact(F.array(fixes)).alias("_f"),
    ).join(t.select("email_id", "category", "status"), "email_id")
    sub = sub.select(
        "email_id",
        F.coalesce("_c", "category").alias("category"),
        F.when(F.col("_c") == "INVOICE_QUERY", "OK").otherwise(F.col("status")).alias("status"),
        F.col("_d").alias("has_defect"),
        F.col("_f").alias("defect_fields"),
        F.when(F.col("_c").isNotNull(), "llm").otherwise("rule").alias("decided_by"),
    )
    return E.score_join(t, sub)


def checked(spark, sf):
    """Truth joined to what the check itself reports on the rendered texts."""
    ships = written(K.shipments(spark, sf))
    r = I.check_messages(K.messages(ships), D.extract_documents(K.document_text(ships), readings=()), readings=())
    return E.score_join(K.truth(ships), I.submission(r))


# ---- classification ------------------------------------------------------------------
EVIDENCE = """CASE kind WHEN 'one_doc' THEN 'SEND THE DRAFT BL' WHEN 'silent' THEN 'has attachments' WHEN 'invoice_trap' THEN 'INVOICE'
 WHEN 'si_request' THEN 'PLEASE FIND SHIPPING INSTRUCTION' WHEN 'invoice' THEN 'QUERY ON INVOICE' WHEN 'general' THEN 'BERTHING REPORT'
 WHEN 'spam' THEN 'CONGRATULAT' WHEN 'quiet_general' THEN 'no signal matched' WHEN 'quiet_spam' THEN 'no signal matched'
 ELSE 'PLEASE COMPARE THE SI AND DRAFT BL' END"""
CONF = "CASE WHEN kind IN ('silent', 'invoice_trap') THEN 0.75 WHEN kind IN ('quiet_general', 'quiet_spam') THEN 0.4 ELSE 0.95 END"


@query("classify_rules", with_(SHIP_SQL, f"SELECT email_id, category, CAST({CONF} AS DOUBLE) AS confidence, 'rule' AS method, {EVIDENCE} AS evidence FROM ship"))
def classify_rules(spark, sf):
    return C.classify(inbox(spark, sf)).select("email_id", "classification.*")


@query("classify_structural", with_(SHIP_SQL, "SELECT email_id FROM ship WHERE kind = 'silent'"))
def classify_structural(spark, sf):
    done = C.classify(inbox(spark, sf))
    return done.filter(F.col("classification.evidence") == V.ATTACHMENT_EVIDENCE).select("email_id")


@query("unsure", with_(SHIP_SQL, "SELECT email_id FROM ship WHERE kind IN ('quiet_general', 'quiet_spam')"))
def unsure(spark, sf):
    return C.unsure(C.classify(inbox(spark, sf))).select("email_id")


@query(
    "model_fallback",
    with_(SHIP_SQL, """SELECT email_id, CASE WHEN kind IN ('quiet_general', 'quiet_spam') THEN CASE WHEN k % 2 = 0 THEN 'GENERAL' ELSE 'SPAM' END ELSE category END AS category,
    CASE WHEN kind IN ('quiet_general', 'quiet_spam') THEN 'llm' ELSE 'rule' END AS method FROM ship"""),
)
def model_fallback(spark, sf):
    done = C.classify(inbox(spark, sf))
    a = C.offline_answer("from", "mock", K.OWN_DOMAIN)
    told = C.apply_model(done.withColumn("a", a), F.col("a.category"), F.col("a.confidence"))
    return told.select("email_id", "classification.category", "classification.method")


@query("missing_attachment", with_(SHIP_SQL, "SELECT email_id FROM ship WHERE kind = 'no_docs'"))
def missing_attachment(spark, sf):
    m = inbox(spark, sf)
    return m.filter(C.attachments_missing(T.canonical("body"), "attachments")).select("email_id")


@query(
    "reference_no",
    with_(SHIP_SQL, "SELECT email_id, CASE k % 3 WHEN 0 THEN 'SIJ' || lpad(CAST(k AS VARCHAR), 7, '0') WHEN 1 THEN 'OOLU' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE '' END AS reference FROM ship"),
)
def reference_no(spark, sf):
    subject = F.regexp_replace("subject", r"CMA\(SIJ", "CMA (SIJ")
    return inbox(spark, sf).select("email_id", T.reference_number(subject).alias("reference"))


# ---- documents ---------------------------------------------------------------------------
@query(
    "doc_type",
    with_(SHIP_SQL, """SELECT email_id, 'SI' AS side, 'SI' AS doc_type FROM ship WHERE kind IN ('one_doc','unreadable','wrong_type','absent_file','invoice_trap','scanned','blank_weight','silent','pair')
    UNION ALL SELECT email_id, 'BL', CASE kind WHEN 'wrong_type' THEN 'OTHER' WHEN 'unreadable' THEN 'UNKNOWN' ELSE 'BL' END
    FROM ship WHERE kind IN ('unreadable','wrong_type','invoice_trap','scanned','blank_weight','silent','pair')"""),
)
def doc_types(spark, sf):
    d = documents(spark, sf)
    return d.select(_path_id().alias("email_id"), _path_side().alias("side"), doc_type("text").alias("doc_type"))


def _path_id():
    return F.regexp_extract("path", r"(msg_\d+)_", 1)


def _path_side():
    return F.regexp_extract("path", r"_(SI|BL)\.", 1)


def _field_rows(spark, sf):
    d = D.extract_documents(documents(spark, sf))
    rows = D.field_rows(d)
    return rows.select(_path_id().alias("email_id"), _path_side().alias("side"), *[c for c in rows.columns if c != "path"])


@query("extract_fields", with_(FIELDS_SQL, "SELECT email_id, side, field, value, raw, CAST(confidence AS DOUBLE) AS confidence, method FROM fields"))
def extract_fields(spark, sf):
    return _field_rows(spark, sf).select("email_id", "side", "field", "value", "raw", "confidence", "method")


@query("provenance", with_(FIELDS_SQL, "SELECT email_id, side, field, 'attachments/' || email_id || '_' || side AS file, CAST(line AS INTEGER) AS line, label_seen, line >= 1 AS shown FROM fields"))
def provenance(spark, sf):
    """Where each value was read: the snippet of its line holds what was captured."""
    shown = F.contains("snippet", F.coalesce("raw", F.lit(""))) & (F.col("snippet") != "")
    file = F.regexp_replace("file", r"\.[a-z]+$", "")
    return _field_rows(spark, sf).select("email_id", "side", "field", file.alias("file"), "line", "label_seen", shown.alias("shown"))


@query("extract_wrapped", with_(FIELDS_SQL, "SELECT email_id, side, field, value FROM fields WHERE k % 4 = 3 AND kind <> 'scanned' AND value IS NOT NULL"))
def extract_wrapped(spark, sf):
    rows = _field_rows(spark, sf)
    return rows.filter(F.col("confidence") == V.CONF_WRAP).select("email_id", "side", "field", "value")


@query("blank_stop", with_(FIELDS_SQL, "SELECT email_id, side, field, raw FROM fields WHERE value IS NULL AND raw IS NOT NULL"))
def blank_stop(spark, sf):
    rows = _field_rows(spark, sf)
    return rows.filter(F.col("value").isNull() & F.col("raw").isNotNull()).select("email_id", "side", "field", "raw")


@query("ocr_cap", with_(FIELDS_SQL, "SELECT side, field, method, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM fields GROUP BY ALL"))
def ocr_cap(spark, sf):
    return _field_rows(spark, sf).groupBy("side", "field", "method", "confidence").agg(F.count("*").alias("n"))


@query("missing_fields", with_(FIELDS_SQL, "SELECT email_id, side, 'fields not found: ' || string_agg(field, ', ' ORDER BY field_no) AS warning FROM fields WHERE value IS NULL GROUP BY ALL"))
def missing_fields(spark, sf):
    d = D.extract_documents(documents(spark, sf)).filter(F.size("warnings") > 0)
    return d.select(_path_id().alias("email_id"), _path_side().alias("side"), F.element_at("warnings", 1).alias("warning"))


@query(
    "fill_missing",
    with_(FIELDS_SQL, """SELECT email_id, side, field, CASE WHEN value IS NULL THEN '7500' ELSE value END AS value,
    CASE WHEN value IS NULL THEN 'llm' ELSE method END AS method, CAST(CASE WHEN value IS NULL THEN 0.8 ELSE confidence END AS DOUBLE) AS confidence FROM fields"""),
)
def fill_missing(spark, sf):
    guesses = F.array(
        F.struct(F.lit("gross_weight_kg").alias("field"), F.lit("7,500 KG").alias("raw"), F.lit(0.99).alias("confidence")),
        F.struct(F.lit("shipper").alias("field"), F.lit("TBA").alias("raw"), F.lit(0.99).alias("confidence")),
        F.struct(F.lit("vessel").alias("field"), F.lit("EVER").alias("raw"), F.lit(0.99).alias("confidence")),
    )
    d = D.extract_documents(documents(spark, sf).withColumn("guesses", guesses), recovered=True)
    return D.field_rows(d).select(_path_id().alias("email_id"), _path_side().alias("side"), "field", "value", "method", "confidence")


@query(
    "label_fragment",
    with_(SHIP_SQL, "SELECT email_id, CASE WHEN k % 2 = 0 THEN 'CUSTOMER ' || substr(c_name, 10) END AS notify_party FROM ship"),
)
def label_fragment(spark, sf):
    """A long label on a line of its own: its tail must not be read as the company."""
    long = F.lit("Notify Party/Intermediate Consignee")
    value = F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n\n   "), "c_name")).otherwise(F.concat(F.lit("\n"), "c_name"))
    docs = K.shipments(spark, sf).select(K.email_id().alias("email_id"), F.concat(F.lit("BILL OF LADING\n"), long, value).alias("text"))
    from tallyclerk.operators.extract import extract_fields as run

    return run(docs).select("email_id", F.get("fields", F.lit(2))["value"].alias("notify_party"))


@query(
    "attachment_join",
    with_(SHIP_SQL, """SELECT email_id, kind IN ('unreadable','wrong_type','invoice_trap','scanned','blank_weight','silent','pair','absent_file','one_doc') AS si_found,
    kind IN ('unreadable','wrong_type','invoice_trap','scanned','blank_weight','silent','pair') AS bl_found FROM ship"""),
)
def attachment_join(spark, sf):
    ships = K.shipments(spark, sf)
    docs = K.document_text(ships).select("path", "method")
    both = I.pair_documents(K.messages(ships), docs)
    return both.select("email_id", F.col("si").isNotNull().alias("si_found"), F.col("bl").isNotNull().alias("bl_found"))


# ---- verdicts ------------------------------------------------------------------------------
@query("compare_fields", with_(COMPARED_SQL, "SELECT email_id, field, status, reason, si_value, bl_value FROM cmp"))
def compare_fields(spark, sf):
    rows = P.comparison_rows(results_with(spark, sf, "value"))
    return rows.select("email_id", "field", "status", "reason", "si_value", "bl_value")


@query(
    "decide",
    with_(COMPARED_SQL, """SELECT email_id, CASE WHEN bool_or(status = 'uncertain') THEN 'NEEDS_REVIEW' WHEN bool_or(status = 'mismatch') THEN 'MISMATCH' ELSE 'OK' END AS status,
    CASE WHEN bool_or(reason LIKE '%confidence%') THEN 'low_confidence' WHEN bool_or(status = 'uncertain') THEN 'missing_value' END AS review_reason FROM cmp GROUP BY email_id"""),
)
def decide(spark, sf):
    return R.decide_rows(P.comparison_rows(results(spark, sf)), "email_id")


@query(
    "inbox_verdicts",
    with_(SHIP_SQL, """SELECT email_id, category, status, review_reason, planted IS NOT NULL AS has_defect, coalesce(planted, '') AS defect_fields FROM verdict"""),
)
def inbox_verdicts(spark, sf):
    sub = I.submission(results(spark, sf))
    return sub.withColumn("defect_fields", F.concat_ws(",", "defect_fields"))


@query("route", with_(SHIP_SQL, "SELECT category, status, review_reason, status = 'NEEDS_REVIEW' AS needs_review, count(*) AS n FROM verdict GROUP BY ALL"))
def route(spark, sf):
    r = results(spark, sf)
    return r.groupBy(F.col("classification.category").alias("category"), "status", "review_reason", "needs_review").agg(F.count("*").alias("n"))


@query("submission", with_(SHIP_SQL, """SELECT email_id, category, status, coalesce(review_reason, 'null') AS review_reason, CAST(planted IS NOT NULL AS VARCHAR) AS has_defect,
 '[' || CASE WHEN status = 'MISMATCH' THEN '"' || planted || '"' ELSE '' END || ']' AS defect_fields FROM verdict"""))
def submission(spark, sf):
    j = F.to_json(F.struct(*[F.col(c) for c in ("category", "status", "review_reason", "has_defect", "defect_fields")]), {"ignoreNullFields": "false"})
    rows = I.submission(results(spark, sf)).select("email_id", j.alias("j"))
    names = ("category", "status", "review_reason", "has_defect", "defect_fields")
    got = [F.get_json_object("j", f"$.{c}") for c in names]
    return rows.select("email_id", *[F.coalesce(g, F.lit("null")).alias(n) for g, n in zip(got, names)])


@query("defect_fields", with_(SHIP_SQL, "SELECT email_id, planted AS defect_fields FROM verdict WHERE status = 'MISMATCH'"))
def defect_fields(spark, sf):
    r = results(spark, sf).filter("has_defect")
    return r.select("email_id", F.concat_ws(",", "defect_fields").alias("defect_fields"))


@query("unconfirmed", with_(COMPARED_SQL, "SELECT email_id, string_agg(field, ',' ORDER BY field) AS fields FROM cmp WHERE kind = 'blank_weight' AND status = 'mismatch' GROUP BY email_id"))
def unconfirmed(spark, sf):
    r = results(spark, sf).filter(F.size("unconfirmed_mismatches") > 0)
    return r.select("email_id", F.concat_ws(",", "unconfirmed_mismatches").alias("fields"))


def _quote(text):
    return text.replace("'", "''")


NOTE_SQL = f"""CASE WHEN category <> 'BL_COMPARISON' THEN '' WHEN kind = 'no_docs' THEN '{_quote(V.NOTE_MISSING_ATTACHMENT)}'
 WHEN kind = 'one_doc' THEN '{_quote(V.NOTE_NOTHING_TO_COMPARE)}' WHEN kind IN ('unreadable', 'absent_file') THEN '{_quote(V.NOTE_UNREADABLE.format(side='BL'))}'
 WHEN kind = 'wrong_type' THEN '{_quote(V.NOTE_WRONG_TYPE)}' WHEN kind = 'scanned' THEN '{_quote(V.NOTE_SCANNED)}'
 WHEN kind = 'blank_weight' THEN '' WHEN planted IS NOT NULL THEN 'Discrepancy found in: ' || planted || '.' ELSE '{V.NOTE_OK}' END"""


@query("notes", with_(SHIP_SQL, f"SELECT email_id, {NOTE_SQL} AS notes FROM verdict"))
def notes(spark, sf):
    return results(spark, sf).select("email_id", F.concat_ws(" | ", "notes").alias("notes"))


@query(
    "reconcile_orders_lineitem",
    """WITH l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total, count(*) AS lines FROM lineitem GROUP BY 1),
    j AS (SELECT coalesce(o_orderkey, k) AS k, o_totalprice AS a, total AS b, lines, o_orderkey FROM orders FULL JOIN l ON k = o_orderkey)
    SELECT k AS orderkey, CASE WHEN a IS NULL THEN 'value not found in the orders' WHEN b IS NULL THEN 'value not found in the lineitem' END AS total_reason,
    CASE WHEN a IS NULL OR b IS NULL THEN 'NEEDS_REVIEW' WHEN abs(a - b) <= 50000 THEN 'OK' ELSE 'MISMATCH' END AS status,
    CASE WHEN a IS NULL OR b IS NULL THEN 'missing_value' END AS review_reason FROM j""",
)
def reconcile_orders_lineitem(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("total"))
    li = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    r = R.reconcile(o, li, ["orderkey"], ["total"], tolerances={"total": 50000.0}, sides=("orders", "lineitem"))
    return r.select("orderkey", "total_reason", "status", "review_reason")


# ---- reports -----------------------------------------------------------------------------------
@query("inbox_summary", with_(SHIP_SQL, "SELECT email_id, category, status, status = 'NEEDS_REVIEW' AS needs_review, planted IS NOT NULL AS has_defect, review_reason FROM verdict"))
def inbox_summary(spark, sf):
    return P.inbox_summary(results(spark, sf))


@query("inbox_filter", with_(SHIP_SQL, "SELECT email_id FROM verdict WHERE category = 'BL_COMPARISON' AND status = 'OK'"))
def inbox_filter(spark, sf):
    return P.filter_inbox(P.inbox_summary(results(spark, sf)), "BL_COMPARISON", "OK").select("email_id")


@query("review_queue", with_(SHIP_SQL, "SELECT email_id, review_reason FROM verdict WHERE status = 'NEEDS_REVIEW'"))
def review_queue(spark, sf):
    return P.review_queue(results(spark, sf)).select("email_id", "review_reason")


@query(
    "review_export",
    with_(COMPARED_SQL, f""", pairs AS (SELECT email_id, string_agg(field || ':' || status, ' | ' ORDER BY field_no) AS cf, coalesce(string_agg(CASE WHEN status = 'mismatch' THEN field END, ' | ' ORDER BY field), '') AS um FROM cmp GROUP BY email_id)
    SELECT email_id, category, review_reason, {NOTE_SQL} AS notes, coalesce(um, '') AS unconfirmed_mismatches, coalesce(cf, '') AS comparison_fields,
    CASE WHEN kind = 'no_docs' THEN '' ELSE 'attachments/' || email_id || '_SI.txt' END AS si_path,
    CASE kind WHEN 'no_docs' THEN '' WHEN 'wrong_type' THEN 'OTHER' WHEN 'unreadable' THEN 'UNKNOWN' WHEN 'absent_file' THEN 'UNKNOWN' ELSE 'BL' END AS bl_doc_type,
    CASE kind WHEN 'no_docs' THEN '' WHEN 'scanned' THEN 'ocr' ELSE 'text' END AS bl_ingest_method
    FROM verdict LEFT JOIN pairs USING (email_id) WHERE status = 'NEEDS_REVIEW'"""),
)
def review_export(spark, sf):
    x = P.review_export(results(spark, sf))
    return x.select("email_id", "category", "review_reason", "notes", "unconfirmed_mismatches", "comparison_fields", "si_path", "bl_doc_type", "bl_ingest_method")


@query(
    "highlights",
    with_(COMPARED_SQL, """SELECT email_id, 'si' AS which, CAST(si_line AS INTEGER) AS line, field, status, si_label AS label FROM cmp WHERE si_line >= 1
    UNION ALL SELECT email_id, 'bl', CAST(bl_line AS INTEGER), field, status, bl_label FROM cmp WHERE bl_line >= 1"""),
)
def highlights(spark, sf):
    return P.highlights(results_with(spark, sf, "line", "label_seen"))


@query(
    "highlighted_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS email_id, w.which, CAST(line AS INTEGER) AS line, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line_text,
    concat_ws(',', CASE WHEN line = doc_id % 3 + 1 THEN 'shipper:match' END, CASE WHEN w.which = 'bl' AND line = doc_id % 5 + 1 THEN 'consignee:mismatch' END) AS marks
    FROM l, (SELECT unnest(['si', 'bl']) AS which) w""",
)
def highlighted_lines(spark, sf):
    """Every line of every document, shown on both sides of a record with two verdicts."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    at = lambda n: F.struct((F.col("doc_id") % n + 1).cast("int").alias("line"))
    nowhere = F.struct(F.lit(-1).alias("line"))
    seen = F.array(
        F.struct(F.lit("shipper").alias("field"), F.lit("match").alias("status"), at(3).alias("si"), at(3).alias("bl")),
        F.struct(F.lit("consignee").alias("field"), F.lit("mismatch").alias("status"), nowhere.alias("si"), at(5).alias("bl")),
    )
    r = docs.select(F.col("path").alias("email_id"), F.struct("path").alias("si"), F.struct("path").alias("bl"), seen.alias("comparisons"))
    return P.highlighted_lines(r, docs.select("path", "text"))


@query(
    "marked_lines",
    with_(COMPARED_SQL, """, marks AS (SELECT email_id, 'si' AS which, si_line AS line, field || ':' || status AS m FROM cmp WHERE si_line >= 1
    UNION ALL SELECT email_id, 'bl', bl_line, field || ':' || status FROM cmp WHERE bl_line >= 1)
    SELECT email_id, which, CAST(line AS INTEGER) AS line, m AS mark FROM marks"""),
)
def marked_lines(spark, sf):
    return P.marked_lines(results_with(spark, sf, "line", "snippet")).select("email_id", "which", "line", "mark")


@query("first_mismatch", with_(COMPARED_SQL, "SELECT email_id, CAST(min(bl_line) AS INTEGER) AS line FROM cmp WHERE status = 'mismatch' GROUP BY email_id"))
def first_mismatch(spark, sf):
    return P.first_mismatch(results_with(spark, sf, "line"))


_LABELS = "{" + ", ".join(f"'{k}': '{v}'" for k, v in V.REPORT_LABELS.items()) + "}"
FACTS = f"""facts AS (SELECT email_id, k, field, (MAP {_LABELS})[field] AS label, si_raw AS si, bl_raw AS bl,
 email_id || '_SI.txt line ' || si_line AS si_source, email_id || '_BL.txt line ' || bl_line AS bl_source
 FROM cmp WHERE status = 'mismatch' AND kind IN ('pair', 'silent'))"""


@query("amendment_facts", with_(COMPARED_SQL + ",\n" + FACTS, "SELECT email_id, field, label, si, bl, si_source, bl_source FROM facts"))
def amendment_facts(spark, sf):
    return P.amendment_facts(results_with(spark, sf, "raw", "line"))


def _sql_text(text):
    return "'" + _quote(text).replace("\n", "' || chr(10) || '") + "'"


@query(
    "amendment_text",
    with_(COMPARED_SQL + ",\n" + FACTS, f"""SELECT email_id, '{V.AMENDMENT_SUBJECT}' || CASE WHEN ref <> '' THEN ' — ' || ref ELSE '' END AS subject,
    {_sql_text(V.AMENDMENT_OPENING)} || CASE WHEN ref <> '' THEN ' (' || ref || ')' ELSE '' END || {_sql_text(V.AMENDMENT_MIDDLE)}
    || '- ' || label || ': the Shipping Instruction states ' || si || ', the draft Bill of Lading states ' || bl || '.' || {_sql_text(V.AMENDMENT_CLOSING)} AS body
    FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'SIJ' || lpad(CAST(k AS VARCHAR), 7, '0') WHEN 1 THEN 'OOLU' || lpad(CAST(k AS VARCHAR), 7, '0') ELSE '' END AS ref FROM facts)"""),
)
def amendment_text(spark, sf):
    r = results_with(spark, sf, "raw")
    ref = inbox(spark, sf).select("email_id", T.reference_number("subject").alias("reference"))
    return P.amendment_text(r.join(ref, "email_id"), F.col("reference"))


# ---- reviews on checked results -------------------------------------------------------------------
APPLIED = f"""{LOG_SQL}, n AS (SELECT email_id, count(*) AS reviews, max(id) AS last_review FROM ok GROUP BY 1)"""


@query(
    "apply_reviews",
    with_(SHIP_SQL + ",\n" + APPLIED, f""", last AS (SELECT email_id, field, arg_max(corrected_value, id) AS v FROM ok WHERE action = 'correct' GROUP BY 1, 2),
    fix AS (SELECT email_id, string_agg(field || '=' || v, ',' ORDER BY field) AS corrected FROM last GROUP BY 1),
    said AS (SELECT ok.email_id, string_agg(CASE WHEN action = 'confirm' THEN '{V.NOTE_CONFIRMED}'
      WHEN field <> 'vessel' AND kind IN ('pair', 'silent', 'blank_weight', 'scanned') THEN 'Human reviewer corrected ' || field || ' to ' || corrected_value || '.'
      ELSE 'Human reviewer supplied ' || field || ': ' || corrected_value || '.' END, ' | ' ORDER BY id) AS told FROM ok JOIN verdict USING (email_id) GROUP BY 1)
    SELECT email_id, CASE WHEN reviews IS NOT NULL THEN 'OK' ELSE status END AS status, CASE WHEN reviews IS NULL THEN review_reason END AS review_reason,
    planted IS NOT NULL AS has_defect, coalesce(reviews, 0) AS reviews, coalesce(corrected, '') AS corrected,
    concat_ws(' | ', nullif({NOTE_SQL}, ''), told) AS notes
    FROM verdict LEFT JOIN n USING (email_id) LEFT JOIN fix USING (email_id) LEFT JOIN said USING (email_id)"""),
)
def apply_reviews(spark, sf):
    done = W.apply_reviews(results(spark, sf), W.valid_reviews(review_events(spark, sf)))
    on_fields = F.transform(F.filter("comparisons", lambda c: c["reviewed"]), lambda c: F.concat_ws("=", c["field"], c["human_correction"]))
    beside = F.transform(F.map_entries("human_corrections"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    corrected = F.concat_ws(",", F.array_sort(F.concat(on_fields, beside)))
    return done.select("email_id", "status", "review_reason", "has_defect", "reviews", corrected.alias("corrected"), F.concat_ws(" | ", "notes").alias("notes"))


@query(
    "review_notes",
    with_(SHIP_SQL + ",\n" + LOG_SQL, f"""SELECT ok.email_id, ok.id, CASE WHEN action = 'confirm' THEN '{V.NOTE_CONFIRMED}'
    WHEN field <> 'vessel' AND kind IN ('pair', 'silent', 'blank_weight', 'scanned') THEN 'Human reviewer corrected ' || field || ' to ' || corrected_value || '.'
    ELSE 'Human reviewer supplied ' || field || ': ' || corrected_value || '.' END AS note FROM ok JOIN verdict USING (email_id)"""),
)
def review_notes(spark, sf):
    return W.review_notes(results(spark, sf), W.valid_reviews(review_events(spark, sf)))


@query("has_source", with_(SHIP_SQL, "SELECT email_id FROM verdict WHERE k IN (SELECT l_orderkey FROM lineitem)"))
def has_source(spark, sf):
    stored = read(spark, sf, "lineitem").select(F.concat(F.lit("msg_"), F.col("l_orderkey").cast("string")).alias("email_id"))
    return W.with_stored_source(inbox(spark, sf), stored).select("email_id")


def _asked(ships, ids):
    """The documents of the messages in `ids`, extracted; no other document is opened."""
    chosen = K.messages(ships).join(ids.distinct(), "email_id", "left_semi")
    return D.extract_documents(I.attachments_of(chosen, K.document_text(ships)))


@query(
    "reprocess_subset",
    with_(SHIP_SQL, "SELECT email_id, CASE WHEN k IN (SELECT user_id FROM events) THEN status ELSE 'OLD' END AS status FROM verdict"),
)
def reprocess_subset(spark, sf):
    ships = K.shipments(spark, sf)
    docs = D.extract_documents(K.document_text(ships))
    old = I.check_messages(K.messages(ships), docs).withColumn("status", F.lit("OLD"))
    ids = read(spark, sf, "events").select(F.concat(F.lit("msg_"), F.col("user_id").cast("string")).alias("email_id"))
    return I.recheck(old, K.messages(ships), _asked(ships, ids), ids).select("email_id", "status")


@query(
    "reprocess_preserve",
    with_(SHIP_SQL + ",\n" + APPLIED, "SELECT email_id, CASE WHEN reviews IS NOT NULL THEN 'OK' WHEN k IN (SELECT user_id FROM events) THEN status ELSE 'OLD' END AS status FROM verdict LEFT JOIN n USING (email_id)"),
)
def reprocess_preserve(spark, sf):
    ships = K.shipments(spark, sf)
    docs = D.extract_documents(K.document_text(ships))
    old = I.check_messages(K.messages(ships), docs).withColumn("status", F.lit("OLD"))
    ids = read(spark, sf, "events").select(F.concat(F.lit("msg_"), F.col("user_id").cast("string")).alias("email_id"))
    again = I.recheck(old, K.messages(ships), _asked(ships, ids), ids)
    return W.apply_reviews(again, W.valid_reviews(review_events(spark, sf))).select("email_id", "status")


# ---- counts and scores ---------------------------------------------------------------------------------
@query("status_counts", with_(SHIP_SQL, "SELECT count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'MISMATCH') AS mismatches, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review FROM verdict"))
def status_counts(spark, sf):
    return E.status_counts(results(spark, sf))


@query("reason_breakdown", with_(SHIP_SQL, "SELECT coalesce(review_reason, 'unspecified') AS reason, count(*) AS n FROM verdict GROUP BY 1"))
def reason_breakdown(spark, sf):
    return E.count_by(results(spark, sf), F.col("review_reason"), "reason", "unspecified")


@query("method_counts", with_(SHIP_SQL, "SELECT 'rule' AS method, count(*) AS n FROM verdict"))
def method_counts(spark, sf):
    return E.count_by(C.classify(inbox(spark, sf)), F.col("classification.method"), "method")


@query(
    "score_join",
    """SELECT o_orderkey AS orderkey, o_orderstatus AS actual, coalesce(s, 'GENERAL') AS predicted, s IS NOT NULL AS submitted
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def score_join(spark, sf):
    none = F.array().cast("array<string>")
    t = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("category"), F.lit("OK").alias("status"),
        F.lit(None).cast("string").alias("review_reason"), F.lit(False).alias("has_defect"), none.alias("defect_fields"))
    s = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max("l_linestatus").alias("category"))
    s = s.select("orderkey", "category", F.lit("OK").alias("status"), F.lit(False).alias("has_defect"), none.alias("defect_fields"))
    return E.score_join(t, s, "orderkey").select("orderkey", "actual", "predicted", "submitted")


@query("missing_ids", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_ids(spark, sf):
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return E.missing_ids(t, read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


@query("confusion", with_(SHIP_SQL, "SELECT actual, predicted, count(*) AS n FROM scored GROUP BY ALL"))
def confusion(spark, sf):
    return E.confusion(scored(spark, sf))


@query("errors", with_(SHIP_SQL, "SELECT actual, predicted, count(*) AS n FROM scored WHERE actual <> predicted GROUP BY ALL"))
def errors(spark, sf):
    return E.errors(scored(spark, sf))


_CLASSES = "[" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "]"
CLASS_SQL = f"""cls AS (SELECT unnest({_CLASSES}) AS category),
cnt AS (SELECT category, count(*) FILTER (actual = category AND predicted = category) AS tp, count(*) FILTER (actual <> category AND predicted = category) AS fp,
  count(*) FILTER (actual = category AND predicted <> category) AS fn FROM cls, scored GROUP BY category),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cnt),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return df


@query("per_class", with_(SHIP_SQL + ",\n" + CLASS_SQL, "SELECT category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f"))
def per_class(spark, sf):
    return rounded(E.per_class(checked(spark, sf)), "precision", "recall", "f1")


@query("macro_f1", with_(SHIP_SQL + ",\n" + CLASS_SQL, "SELECT round(avg(f1), 6) AS macro_f1, (SELECT round(avg(CAST(actual = predicted AS INT)), 6) FROM scored) AS accuracy FROM f"))
def macro_f1(spark, sf):
    return rounded(E.classification_score(scored(spark, sf)), "macro_f1", "accuracy").select("macro_f1", "accuracy")


@query("rule_share", with_(SHIP_SQL, "SELECT round(avg(CASE WHEN kind IN ('invoice_trap', 'quiet_spam') THEN 0 ELSE 1 END), 6) AS rule_share FROM ship"))
def rule_share(spark, sf):
    return rounded(E.classification_score(scored(spark, sf)), "rule_share").select("rule_share")


DEFECT_SCORE = """d AS (SELECT *, predicted = 'BL_COMPARISON' AND found IS NOT NULL AS said FROM scored WHERE actual = 'BL_COMPARISON' AND t_status <> 'NEEDS_REVIEW'),
s AS (SELECT count(*) FILTER (gold IS NOT NULL AND said) AS tp, count(*) FILTER (gold IS NULL AND said) AS fp, count(*) FILTER (gold IS NOT NULL AND NOT said) AS fn,
 count(*) FILTER (gold = found AND said) AS f_tp, count(*) FILTER (said AND gold IS DISTINCT FROM found) AS f_fp, count(*) FILTER (gold IS NOT NULL AND (NOT said OR gold <> found)) AS f_fn,
 count(*) FILTER ((CASE WHEN said THEN found END) IS NOT DISTINCT FROM gold) AS exact, count(*) AS doc_total FROM d)"""


@query("defect_prf", with_(SHIP_SQL + ",\n" + DEFECT_SCORE, "SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS defect_precision, round(tp / (tp + fn), 6) AS defect_recall, doc_total FROM s"))
def defect_prf(spark, sf):
    s = rounded(E.defect_score(scored(spark, sf)), "defect_precision", "defect_recall")
    return s.select("tp", "fp", "fn", "defect_precision", "defect_recall", "doc_total")


@query("field_f1", with_(SHIP_SQL + ",\n" + DEFECT_SCORE, "SELECT f_tp AS field_tp, f_fp AS field_fp, f_fn AS field_fn, round(2 * f_tp / (2 * f_tp + f_fp + f_fn), 6) AS field_f1 FROM s"))
def field_f1(spark, sf):
    return rounded(E.defect_score(scored(spark, sf)), "field_f1").select("field_tp", "field_fp", "field_fn", "field_f1")


@query("exact_match", with_(SHIP_SQL + ",\n" + DEFECT_SCORE, "SELECT exact, round(exact / doc_total, 6) AS exact_match_rate FROM s"))
def exact_match(spark, sf):
    return rounded(E.defect_score(scored(spark, sf)), "exact_match_rate").select("exact", "exact_match_rate")


ESC = """e AS (SELECT count(*) FILTER (t_status = 'NEEDS_REVIEW' AND p_status = 'NEEDS_REVIEW') AS tp, count(*) FILTER (t_status = 'NEEDS_REVIEW') AS gold_review,
 count(*) FILTER (p_status = 'NEEDS_REVIEW') AS pred_review FROM scored)"""


@query("escalation", with_(SHIP_SQL + ",\n" + ESC, "SELECT gold_review, pred_review, round(tp / gold_review, 6) AS escalation_recall, round(tp / pred_review, 6) AS escalation_precision FROM e"))
def escalation(spark, sf):
    s = rounded(E.escalation_score(checked(spark, sf)), "escalation_recall", "escalation_precision")
    return s.select("gold_review", "pred_review", "escalation_recall", "escalation_precision")


_REASONS = "[" + ", ".join(f"'{c}'" for c in V.SCORED_REASONS) + "]"


@query("per_reason", with_(SHIP_SQL, f"""SELECT r AS review_reason, count(review_reason) AS total, count(review_reason) FILTER (p_status = 'NEEDS_REVIEW') AS caught
    FROM (SELECT unnest({_REASONS}) AS r) LEFT JOIN (SELECT * FROM scored WHERE t_status = 'NEEDS_REVIEW') ON r = review_reason GROUP BY r"""))
def per_reason(spark, sf):
    return E.per_reason(checked(spark, sf))


FINAL = CLASS_SQL + ",\n" + DEFECT_SCORE + """,
x AS (SELECT count(*) AS total, count(*) FILTER (predicted = 'BL_COMPARISON' AND gold = found) AS success FROM scored WHERE actual = 'BL_COMPARISON' AND gold IS NOT NULL),
parts AS (SELECT (SELECT avg(f1) FROM f) AS macro_f1, (SELECT 2 * tp / (2 * tp + fp + fn) FROM s) AS defect_f1, (SELECT success / total FROM x) AS end_to_end)"""


@query("end_to_end", with_(SHIP_SQL + ",\n" + FINAL, "SELECT success, total, round(success / total, 6) AS rate FROM x"))
def end_to_end(spark, sf):
    return rounded(E.end_to_end_score(checked(spark, sf)), "rate")


@query("final_score", with_(SHIP_SQL + ",\n" + FINAL, "SELECT round(macro_f1, 6) AS macro_f1, round(defect_f1, 6) AS defect_f1, round(end_to_end, 6) AS end_to_end, round(0.3 * macro_f1 + 0.2 * defect_f1 + 0.5 * end_to_end, 6) AS final_score FROM parts"))
def final_score(spark, sf):
    s = rounded(E.final_score(checked(spark, sf)), "macro_f1", "defect_f1", "end_to_end", "final_score")
    return s.select("macro_f1", "defect_f1", "end_to_end", "final_score")


@query(
    "headroom",
    with_(SHIP_SQL + ",\n" + FINAL, """, g AS (SELECT 'macro_f1' AS metric, (1 - macro_f1) * 0.3 AS points FROM parts UNION ALL SELECT 'defect_f1', (1 - defect_f1) * 0.2 FROM parts
    UNION ALL SELECT 'end_to_end', (1 - end_to_end) * 0.5 FROM parts)
    SELECT metric, round(points, 6) AS points, round(CASE WHEN sum(points) OVER () > 0 THEN points / sum(points) OVER () * 100 ELSE 0 END, 6) AS share FROM g"""),
)
def headroom(spark, sf):
    m = E.metrics_long(E.final_score(scored(spark, sf)), list(V.SCORE_WEIGHTS))
    return rounded(E.headroom(m), "points", "share").select("metric", "points", "share")


@query(
    "metric_delta",
    with_(SHIP_SQL + ",\n" + CLASS_SQL, """, a AS (SELECT avg(CAST(actual = predicted AS INT)) AS accuracy FROM scored), b AS (SELECT avg(CAST(actual = 'BL_COMPARISON' AS INT)) AS accuracy FROM scored)
    SELECT 'accuracy' AS metric, round(b.accuracy, 6) AS before, round(a.accuracy, 6) AS after, round(a.accuracy - b.accuracy, 6) AS delta,
    CASE WHEN abs(a.accuracy - b.accuracy) < 1e-9 THEN 'no change' WHEN a.accuracy > b.accuracy THEN 'up' ELSE 'down' END AS change FROM a, b"""),
)
def metric_delta(spark, sf):
    j = scored(spark, sf)
    guess = j.withColumn("predicted", F.lit("BL_COMPARISON"))
    long = [E.metrics_long(E.classification_score(x), ["accuracy"]) for x in (guess, j)]
    return rounded(E.metric_delta(*long), "before", "after", "delta")


@query(
    "run_diff",
    with_(SHIP_SQL, """SELECT email_id, v.category AS a, t.category AS b, t.category AS gold, 'fixed' AS effect FROM verdict v JOIN truth t USING (email_id) WHERE v.category <> t.category AND v.kind = 'quiet_spam'
    UNION ALL SELECT email_id, v.category, 'SPAM', t.category, 'broken' FROM verdict v JOIN truth t USING (email_id) WHERE v.kind = 'quiet_general'"""),
)
def run_diff(spark, sf):
    ships = K.shipments(spark, sf)
    a = C.classify(K.messages(ships)).select("email_id", F.col("classification.category").alias("category"), "classification")
    told = C.apply_model(a, F.lit("SPAM"), F.lit(0.9)).select("email_id", F.col("classification.category").alias("category"))
    return E.run_diff(K.truth(ships), a, told)


@query(
    "quality_checks",
    with_(SHIP_SQL + ",\n" + FINAL, """SELECT 'macro_f1' AS "check", round(macro_f1, 6) AS got, macro_f1 > 0.9 AS passed FROM parts
    UNION ALL SELECT 'defect_precision', 1.0, true UNION ALL SELECT 'end_to_end', round(end_to_end, 6), abs(end_to_end - 1) < 0.002 FROM parts
    UNION ALL SELECT 'accuracy', (SELECT round(avg(CAST(actual = predicted AS INT)), 6) FROM scored), (SELECT avg(CAST(actual = predicted AS INT)) > 0.98 FROM scored)"""),
)
def quality_checks(spark, sf):
    s = E.final_score(scored(spark, sf))
    checks = E.quality_checks(s, [("macro_f1", ">", 0.9), ("defect_precision", "=", 1.0), ("end_to_end", "=", 1.0), ("accuracy", ">", 0.98)])
    return rounded(checks, "got").select("check", "got", "passed")
