"""Views of results: summaries, queues, exports, highlights, amendment requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.text import basename, numbered_lines
from tallyclerk.operators.documents import _template

ALL = "ALL"


def inbox_summary(results: DataFrame) -> DataFrame:
    return results.select(
        "email_id",
        F.col("classification")["category"].alias("category"),
        "status",
        (F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
        "has_defect",
        "review_reason",
    )


def review_queue(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "NEEDS_REVIEW")


def filter_inbox(summary: DataFrame, category: str = ALL, status: str = ALL) -> DataFrame:
    """Rows of one category and status; ALL leaves a filter out."""
    for column, wanted in (("category", category), ("status", status)):
        if wanted != ALL:
            summary = summary.filter(F.col(column) == wanted)
    return summary


def comparison_rows(results: DataFrame) -> DataFrame:
    """One row per record and field: verdict with both readings, as far as the comparisons hold them."""
    rows = results.select("email_id", F.col("status").alias("record_status"), F.explode("comparisons").alias("c"))
    cols = [F.col("c")[x].alias(x) for x in ("field", "status", "reason")]
    held = rows.schema["c"].dataType
    for side in ("si", "bl"):
        parts = held[side].dataType.names if side in held.names else ()
        cols += [
            F.col("c")[side][x].alias(f"{side}_{x}")
            for x in ("value", "raw", "confidence", "line", "label_seen", "snippet")
            if x in parts
        ]
    return rows.select("email_id", "record_status", *cols)


def review_export(results: DataFrame, separator: str = " | ") -> DataFrame:
    """The review queue flattened for CSV: lists joined, one line per case."""
    q = review_queue(results)

    def joined(name):
        return F.concat_ws(separator, name)

    cols = [
        "email_id",
        F.col("classification")["category"].alias("category"),
        "status",
        "review_reason",
        F.col("classification")["confidence"].alias("classification_confidence"),
        F.col("classification")["method"].alias("classification_method"),
        "has_defect",
        joined("defect_fields").alias("defect_fields"),
        joined("unconfirmed_mismatches").alias("unconfirmed_mismatches"),
        joined("notes").alias("notes"),
    ]
    for side in ("si", "bl"):
        for name in ("path", "doc_type", "ingest_method"):
            cols.append(F.coalesce(F.col(side)[name], F.lit("")).alias(f"{side}_{name}"))
        cols.append(F.coalesce(F.col(side)["readable"].cast("string"), F.lit("")).alias(f"{side}_readable"))
    pairs = F.transform("comparisons", lambda c: F.concat_ws(":", c["field"], c["status"]))
    cols.append(F.concat_ws(separator, pairs).alias("comparison_fields"))
    return q.select(*cols)


def document_lines(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per text line."""
    return documents.select(*keep, F.explode(numbered_lines("text")).alias("l")).select(*keep, "l.line", F.col("l.text").alias("line_text"))


def highlights(results: DataFrame, sides: tuple[str, ...] = ("si", "bl")) -> DataFrame:
    """(email_id, which, line, field, status, label): the lines values were read from."""
    per_side = F.array(
        *[
            F.struct(
                F.lit(s).alias("which"),
                F.col("c")[s]["line"].alias("line"),
                F.col("c")["field"].alias("field"),
                F.col("c")["status"].alias("status"),
                F.col("c")[s]["label_seen"].alias("label"),
            )
            for s in sides
        ]
    )
    rows = results.select("email_id", F.explode("comparisons").alias("c"))
    rows = rows.select("email_id", F.explode(per_side).alias("h")).select("email_id", "h.*")
    return rows.filter(F.col("line") >= 1)


def highlighted_lines(results: DataFrame, document_text: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Numbered lines of whole documents with the verdicts drawn from each.

    Texts are joined by path, so give the `ids` (email_id) to be shown where they are few:
    then only their documents are joined.  `marked_lines` needs no text at all.
    """
    if ids is not None:
        results = results.join(ids.select("email_id").distinct(), "email_id", "left_semi")
        paths = results.select(F.explode(F.array("si.path", "bl.path")).alias("path")).distinct()
        document_text = document_text.join(paths, "path", "left_semi")

    def entry(side):
        def mark(c):
            return F.struct(c[side]["line"].alias("line"), c["field"].alias("field"), c["status"].alias("status"))

        return F.struct(
            F.col(side)["path"].alias("path"), F.lit(side).alias("which"), F.transform("comparisons", mark).alias("marks")
        )

    both = F.explode(F.array(entry("si"), entry("bl"))).alias("d")
    entries = results.select("email_id", both).select("email_id", "d.*").filter(F.col("path").isNotNull())
    joined = entries.join(document_text.select("path", "text"), "path")
    lines = joined.select("email_id", "which", "marks", F.explode(numbered_lines("text")).alias("l"))
    here = F.filter("marks", lambda m: m["line"] == F.col("l")["line"])
    return lines.select(
        "email_id",
        "which",
        F.col("l")["line"].alias("line"),
        F.col("l")["text"].alias("line_text"),
        F.concat_ws(",", F.transform(here, lambda m: F.concat_ws(":", m["field"], m["status"]))).alias("marks"),
    )


def marked_lines(results: DataFrame) -> DataFrame:
    """Only the lines values were read from, with their text as the extraction kept it.

    Everything comes from the record, so no document text is read or shuffled.
    """
    def entries(side):
        def entry(c):
            return F.struct(
                F.lit(side).alias("which"), c[side]["line"].alias("line"), c[side]["snippet"].alias("line_text"),
                F.concat_ws(":", c["field"], c["status"]).alias("mark"))

        return F.transform("comparisons", entry)

    rows = F.flatten(F.array(entries("si"), entries("bl")))
    found = results.select("email_id", F.explode(rows).alias("r")).select("email_id", "r.*")
    return found.filter(F.col("line") >= 1)


def validation_summary(run: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A scored run (see `evaluate.run_record`) as rows (section, name, value), for JSON or CSV.

    `snapshot` is the one-row status count of the records stored now.
    """
    e = F.col("evaluation")
    have = run.schema["evaluation"].dataType.fieldNames()

    def text(c):
        return c.cast("string")

    def of_run(*names):
        return [(n, text(F.col(n)) if n in run.columns else F.lit(None).cast("string")) for n in names]

    def of_evaluation(**names):
        return [(shown, text(e[n]) if n in have else F.lit(None).cast("string")) for shown, n in names.items()]

    sections = {
        "selected_run": of_run("dataset", "seed", "created_at", "llm_enabled"),
        "volume": of_run("requested_n", "processed", "ok", "mismatches", "needs_review"),
        "validation_scores": of_run("rules_score") + of_evaluation(
            final_score="final_score", classification_macro_f1="macro_f1", defect_f1="defect_f1", end_to_end_rate="end_to_end",
            defect_precision="defect_precision", defect_recall="defect_recall", end_to_end_success="success", end_to_end_total="total"),
    }

    def rows(listed):
        return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value")) for s, xs in listed.items() for n, v in xs])

    now = {"dashboard_snapshot": [(n, text(F.col(n))) for n in ("total", "ok", "mismatches", "needs_review")]}
    return run.select(F.explode(rows(sections)).alias("r")).select("r.*").union(snapshot.select(F.explode(rows(now)).alias("r")).select("r.*"))


def first_mismatch(results: DataFrame, side: str = "bl") -> DataFrame:
    """First line of a document a mismatching value was read from."""
    lines = F.transform(
        F.filter("comparisons", lambda c: (c["status"] == "mismatch") & (c[side]["line"] >= 1)), lambda c: c[side]["line"]
    )
    return results.select("email_id", F.array_min(lines).alias("line")).filter(F.col("line").isNotNull())


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int = 10) -> DataFrame:
    """First n rows of each group, with the number left out of the listing.

    The rank filter lets Spark cut each group to n rows before the shuffle, and the counts
    are combined before theirs, so a hot group stays small.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    listed = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    totals = rows.groupBy(*group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return listed.join(totals, group)


def amendment_facts(results: DataFrame) -> DataFrame:
    """Confirmed discrepancies with report labels and where both values stand."""
    rows = results.filter(F.col("status") == "MISMATCH").select(
        "email_id", F.col("si.path").alias("si_path"), F.col("bl.path").alias("bl_path"), F.explode("comparisons").alias("c")
    )
    c = F.col("c")
    label = F.coalesce(
        *[F.when(c["field"] == f, F.lit(x)) for f, x in V.REPORT_LABELS.items()], F.replace(c["field"], F.lit("_"), F.lit(" "))
    )

    def source(path, side):
        return F.concat(basename(path), F.lit(" line "), c[side]["line"].cast("string"))

    return rows.filter(c["status"] == "mismatch").select(
        "email_id",
        c["field"].alias("field"),
        label.alias("label"),
        c["si"]["raw"].alias("si"),
        c["bl"]["raw"].alias("bl"),
        source("si_path", "si").alias("si_source"),
        source("bl_path", "bl").alias("bl_source"),
    )


def amendment_text(results: DataFrame, reference: Column | None = None) -> DataFrame:
    """Subject and body of the amendment request of every MISMATCH record.

    `reference` is a booking number column of `results`; '' or none leaves it out.  The
    lines come from the record's own comparison array, so nothing is regrouped.
    """
    ref = F.lit("") if reference is None else F.coalesce(reference, F.lit(""))
    differing = F.filter("comparisons", lambda c: c["status"] == "mismatch")

    def line(c):
        label = F.coalesce(*[F.when(c["field"] == f, F.lit(x)) for f, x in V.REPORT_LABELS.items()], c["field"])
        return F.concat(*_template(V.AMENDMENT_LINE, label=label, si=F.coalesce(c["si"]["raw"], F.lit("None")), bl=F.coalesce(c["bl"]["raw"], F.lit("None"))))

    lines = F.concat_ws("\n", F.transform(differing, line))
    has_ref = ref != ""
    return results.filter(F.col("status") == "MISMATCH").select(
        "email_id",
        F.concat(F.lit(V.AMENDMENT_SUBJECT), F.when(has_ref, F.concat(F.lit(" — "), ref)).otherwise("")).alias("subject"),
        F.concat(
            F.lit(V.AMENDMENT_OPENING),
            F.when(has_ref, F.concat(F.lit(" ("), ref, F.lit(")"))).otherwise(""),
            F.lit(V.AMENDMENT_MIDDLE),
            lines,
            F.lit(V.AMENDMENT_CLOSING),
        ).alias("body"),
    )


def inspect(results: DataFrame, email_id) -> DataFrame:
    """One record, one row per field."""
    return comparison_rows(results.filter(F.col("email_id") == email_id))
