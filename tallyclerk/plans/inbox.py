"""The whole check: messages and documents in, one reconciled result per message out.

    classify -> pair with extracted documents -> compare -> decide -> route

Documents are extracted where they are scanned; after that only extracted values travel.
The only shuffles are the two equi-joins that bring a message's documents to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.operators import classify as C
from tallyclerk.operators import reconcile as R
from tallyclerk.operators.documents import extract_documents, ingest
from tallyclerk.operators.extract import computed_once


SIDES = ("si", "bl")


def _joined(messages: DataFrame, documents: DataFrame, wanted: Column | None) -> DataFrame:
    """`messages` with what is known of their documents in columns of its own, `_si_found`, `_si_fields`, `_bl_found` ...

    Columns, not records: what nobody asks for is left out of both joins alike, so both read one exchange
    of the documents, which are extracted once.
    """
    wanted = F.lit(True) if wanted is None else wanted
    out = messages
    for i, name in enumerate(SIDES):
        path = F.get(F.col("attachments"), F.lit(i))
        spread = F.concat(F.lit("\x00"), F.col("email_id").cast("string"))
        keyed = out.withColumn("_path", F.coalesce(F.when(wanted, path), spread)).withColumn("_hash", F.xxhash64("_path"))
        known = [F.col(c).alias(f"_{name}_{c}") for c in documents.columns if c != "path"]
        right = documents.select(
            F.xxhash64("path").alias("_hash"), F.col("path").alias("_path"), F.lit(True).alias(f"_{name}_found"), *known)
        # What a few bytes of keys became is not to be sent to every executor, nor extracted for each join.
        out = keyed.join(right.hint("merge"), ["_hash", "_path"], "left").drop("_hash", "_path")
    return out


def _apart(readings: tuple[str, ...] | None) -> dict[str, None]:
    """Parts of the fields that stand in arrays of their own, as verdicts and narrow comparisons bring no others to a join."""
    return dict.fromkeys(("value", "confidence", *(readings or ())))


def _found_path(name: str) -> Column:
    return F.when(F.col(f"_{name}_found"), F.get(F.col("attachments"), F.lit(SIDES.index(name))))


def pair_documents(messages: DataFrame, documents: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Attach the first attachment as `si` and the second as `bl`, by exact path.

    `documents` is unique by path.  A path that is not stored leaves a NULL side.  Messages
    that want no documents join on a key of their own: a NULL or constant key would send
    all of them to one task.  A path many messages share is split by adaptive skew joins.
    Paths begin alike, so a hash of the path is the first key: sorting by it settles most at once.
    """
    joined = _joined(messages, documents, wanted)

    def side(name):
        known = [(_found_path(name) if c == "path" else F.col(f"_{name}_{c}")).alias(c) for c in documents.columns]
        return F.when(F.col(f"_{name}_found"), F.struct(*known)).alias(name)

    return joined.select(*messages.columns, *[side(name) for name in SIDES])


def _unreadable_stub(path: Column) -> Column:
    """The document record of a path that is not stored."""
    text = F.lit("text")
    return F.struct(
        path.alias("path"),
        F.lit("UNKNOWN").alias("doc_type"),
        text.alias("ingest_method"),
        F.lit(False).alias("readable"),
        F.array(F.lit(V.WARN_NOT_FOUND)).alias("warnings"),
    )


def route(paired: DataFrame, readings: tuple[str, ...] | None = None) -> DataFrame:
    """Verdict of every message from its classification and its two documents.

    Input columns: email_id, classification, canonical_body flag `asks_comparison`,
    attachments, si, bl.  Output is the full result record; with `readings`, its comparisons hold
    of either side these parts only, and with none of them no sides at all.
    """
    known = ("path", "doc_type", "ingest_method", "readable", "warnings", "fields")
    flat = {f"_{side}_{c}": F.col(side)[c] for side in SIDES for c in known}
    return _routed(paired.select("email_id", "classification", "asks_comparison", "attachments", *[c.alias(n) for n, c in flat.items()]), readings)


def _routed(paired: DataFrame, readings: tuple[str, ...] | None = None) -> DataFrame:
    """`route` of messages whose documents stand in columns of their own."""
    pieces = ("path", "doc_type", "ingest_method", "readable", "warnings", "fields", *_apart(readings))
    arrays = {f"_{side}_{c}": F.col(f"_{side}_fields")[c] for side in SIDES for c in _apart(readings)}
    paired = paired.withColumns({n: c for n, c in arrays.items() if n not in paired.columns})
    si, bl = [{c: F.col(f"_{side}_{c}") for c in pieces} for side in SIDES]
    comparison = F.col("classification")["category"] == V.COMPARISON_CATEGORY
    few = C.attachment_count("attachments") < 2
    missing = few & F.col("asks_comparison")
    si_ok = F.coalesce(si["readable"], F.lit(False))
    bl_ok = F.coalesce(bl["readable"], F.lit(False))
    wrong = (si["doc_type"] == "OTHER") | (bl["doc_type"] == "OTHER")
    scanned = (si["ingest_method"] == "ocr") | (bl["ingest_method"] == "ocr")

    outcome = (
        F.when(~comparison, "other")
        .when(missing, "missing_attachment")
        .when(few, "nothing_to_compare")
        .when(~si_ok | ~bl_ok, "unreadable")
        .when(wrong, "wrong_doc_type")
        .when(scanned, "scanned")
        .otherwise("compared")
    )
    compared = F.col("_outcome").isin("compared", "scanned")
    step = paired.withColumn("_outcome", outcome)
    step = step.withColumn(
        "_verdicts", computed_once(F.when(compared, R.field_verdicts(si, bl)))
    )
    # Verdicts stand apart: what asks for nothing else brings no snippet and no line to the join.
    comparisons = F.col("_verdicts")
    if readings is None or readings:
        said = [x["fields"] if readings is None else {c: x[c] for c in readings} for x in (si, bl)]
        comparisons = computed_once(F.when(compared, R.compare_documents(comparisons, *said)))
    step = step.withColumn("comparisons", comparisons)
    step = step.withColumn(
        "_decision", F.when(F.col("_outcome") == "compared", R.decide_comparisons(F.col("_verdicts")))
    )
    escalated = F.col("_outcome").isin("missing_attachment", "unreadable", "wrong_doc_type", "scanned")
    step = step.withColumn(
        "status",
        F.when(escalated, "NEEDS_REVIEW").otherwise(F.coalesce(F.col("_decision")["status"], F.lit("OK"))),
    ).withColumn(
        "review_reason",
        F.when(F.col("_outcome") == "scanned", "unreadable")
        .when(escalated, F.col("_outcome"))
        .otherwise(F.col("_decision")["review_reason"]),
    )
    step = step.withColumn("_differing", R.mismatched_fields(F.col("_verdicts")))
    nothing = F.array().cast("array<string>")
    step = step.withColumn(
        "defect_fields", F.when(F.col("status") == "MISMATCH", F.col("_differing")).otherwise(nothing)
    ).withColumn(
        "unconfirmed_mismatches",
        F.coalesce(F.when(F.col("status") == "NEEDS_REVIEW", F.col("_differing")), nothing),
    )
    note = (
        F.when(F.col("_outcome") == "missing_attachment", V.NOTE_MISSING_ATTACHMENT)
        .when(F.col("_outcome") == "nothing_to_compare", V.NOTE_NOTHING_TO_COMPARE)
        .when(
            F.col("_outcome") == "unreadable",
            F.when(~si_ok, V.NOTE_UNREADABLE.format(side="SI")).otherwise(V.NOTE_UNREADABLE.format(side="BL")),
        )
        .when(F.col("_outcome") == "wrong_doc_type", V.NOTE_WRONG_TYPE)
        .when(F.col("_outcome") == "scanned", V.NOTE_SCANNED)
        .when(
            F.col("status") == "MISMATCH",
            F.replace(
                F.lit(V.NOTE_MISMATCH), F.lit("{fields}"), F.concat_ws(", ", F.col("defect_fields"))
            ),
        )
        .when((F.col("_outcome") == "compared") & (F.col("status") == "OK"), V.NOTE_OK)
    )

    def opened(doc, position):
        """The document as reported: only messages that got that far have one."""
        stub = _unreadable_stub(F.get(F.col("attachments"), F.lit(position)))
        summary = F.struct(*[doc[c].alias(c) for c in ("path", "doc_type", "ingest_method", "readable", "warnings")])
        reached = comparison & ~few
        return F.when(reached & doc["path"].isNull(), stub).when(reached, summary)

    empty = F.array().cast(step.schema["comparisons"].dataType)
    return step.select(
        "email_id",
        "classification",
        "status",
        "review_reason",
        (F.col("status") == "MISMATCH").alias("has_defect"),
        (F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
        "defect_fields",
        "unconfirmed_mismatches",
        F.coalesce("comparisons", empty).alias("comparisons"),
        opened(si, 0).alias("si"),
        opened(bl, 1).alias("bl"),
        F.array_compact(F.array(note)).alias("notes"),
    )


def classified(messages: DataFrame, rules=None, *keep: str) -> DataFrame:
    """What pairing and routing need of `messages`, with the columns `keep` beside it."""
    asks = C.attachments_missing("canonical_body", "attachments").alias("asks_comparison")
    return C.classify(messages, rules=rules).select("email_id", "classification", "attachments", asks, *keep)


def wants_documents() -> Column:
    """Whether a classified message is to be compared by its documents."""
    return (F.col("classification")["category"] == V.COMPARISON_CATEGORY) & (C.attachment_count("attachments") >= 2)


def check_messages(
    messages: DataFrame,
    documents: DataFrame,
    answers: DataFrame | None = None,
    rules=None,
    readings: tuple[str, ...] | None = None,
) -> DataFrame:
    """Results for `messages` given extracted `documents`.

    `answers` (email_id, category, confidence), unique by email_id, settles messages no
    rule could.  `readings` are the parts of what either document says that comparisons are to
    hold, all by default; `documents` must have them (see `extract_documents`).
    """
    step = classified(messages, rules)
    if answers is not None:
        told = answers.select(
            "email_id", F.col("category").alias("_category"), F.col("confidence").alias("_confidence")
        )
        step = step.join(told, "email_id", "left")
        step = C.apply_model(step, F.col("_category"), F.col("_confidence"))
        step = step.drop("_category", "_confidence")
    apart = documents.withColumns({c: F.col("fields")[c] for c in _apart(readings)})
    paired = _joined(step, apart, wants_documents())
    return _routed(paired.withColumns({f"_{side}_path": _found_path(side) for side in SIDES}), readings)


def check_inbox(
    messages: DataFrame,
    attachments: DataFrame,
    answers: DataFrame | None = None,
    readers=None,
    labels=None,
    rules=None,
    exact_unicode: bool = True,
    readings: tuple[str, ...] | None = None,
) -> DataFrame:
    """Results for `messages` and raw `attachments` (path, content); for `readings` see `check_messages`."""
    documents = extract_documents(ingest(attachments, readers), labels, exact_unicode, readings=readings)
    return check_messages(messages, documents, answers, rules, readings)


def submission(results: DataFrame) -> DataFrame:
    """The narrow record the scorer reads."""
    return results.select(
        "email_id",
        F.col("classification")["category"].alias("category"),
        "status",
        "review_reason",
        "has_defect",
        "defect_fields",
    )


def recheck(
    results: DataFrame,
    messages: DataFrame,
    documents: DataFrame,
    ids: DataFrame,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Check the messages in `ids` again and put their results in place of the stored ones."""
    asked = ids.select("email_id").distinct()
    chosen = messages.join(asked, "email_id", "left_semi")
    again = check_messages(chosen, documents, answers)
    # Stored results of messages that are gone stay as they are.
    kept = results.join(chosen.select("email_id"), "email_id", "left_anti")
    return kept.unionByName(again)


def attachments_of(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Stored attachments (or document texts) that the given messages name.

    Meant for a few messages out of many: it comes before anything is opened or extracted.
    """
    paths = messages.select(F.explode(F.slice(F.coalesce("attachments", F.array().cast("array<string>")), 1, 2)).alias("path"))
    return attachments.join(paths.distinct(), "path", "left_semi")


def recheck_inbox(
    results: DataFrame,
    messages: DataFrame,
    attachments: DataFrame,
    ids: DataFrame,
    answers: DataFrame | None = None,
    readers=None,
    labels=None,
) -> DataFrame:
    """`recheck` from stored sources: only the attachments of the messages asked for are opened."""
    chosen = messages.join(ids.select("email_id").distinct(), "email_id", "left_semi")
    texts = ingest(attachments_of(chosen, attachments), readers)
    return recheck(results, messages, extract_documents(texts, labels), ids, answers)
