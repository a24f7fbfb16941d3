"""Human review: validating, logging and applying decisions.

The log is append-only.  Its effect on a record is a fold that needs only flags and the
last correction per field, so it is aggregated before it is shuffled.  The notes of a record
are an array of it; where a record may have very many, they can stay rows (`review_notes`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V


def validate_reviews(log: DataFrame) -> DataFrame:
    """Add `rejected`: why a review cannot be applied, NULL when it can."""
    correct = F.col("action") == "correct"
    return log.withColumn(
        "rejected",
        F.when(~F.coalesce(F.col("action").isin(*V.REVIEW_ACTIONS), F.lit(False)), "action must be confirm or correct")
        .when(correct & (F.coalesce("field", F.lit("")) == ""), "field is required for a correction")
        .when(correct & F.col("corrected_value").isNull(), "corrected_value is required for a correction"),
    )


def valid_reviews(log: DataFrame) -> DataFrame:
    return validate_reviews(log).filter(F.col("rejected").isNull()).drop("rejected")


def corrections(log: DataFrame) -> DataFrame:
    """Last correction per (email_id, field), by review id."""
    return (
        log.filter(F.col("action") == "correct")
        .groupBy("email_id", "field")
        .agg(F.max_by("corrected_value", "id").alias("corrected_value"), F.max("id").alias("review_id"))
    )


def _fold(log: DataFrame, notes: bool) -> DataFrame:
    """Per record: number of reviews, last one, corrected values by field name, and, if asked for, what
    the notes need of each review."""
    per_field = [F.count("*").alias("n"), F.max("id").alias("last_id"), F.max_by("corrected_value", "id").alias("value")]
    per_record = [F.sum("n").alias("reviews"), F.max("last_id").alias("last_review")]
    if notes:
        per_field.append(F.collect_list(F.struct("id", "action", "field", "corrected_value")).alias("said"))
        per_record.append(F.sort_array(F.flatten(F.collect_list("said"))).alias("_said"))
    # One row per record and field name is left, so this gathers names, not reviews.
    entries = F.collect_list(F.when(F.col("_field").isNotNull(), F.struct("_field", "value")))
    correct = F.when(F.col("action") == "correct", F.col("field"))
    latest = log.withColumn("_field", correct).groupBy("email_id", "_field").agg(*per_field)
    return latest.groupBy("email_id").agg(*per_record, F.map_from_entries(entries).alias("_corrections"))


def apply_reviews(results: DataFrame, log: DataFrame, recompute: bool = False, notes: bool = True) -> DataFrame:
    """Results after the (valid) review log.

    Any review settles a record: status OK, no reason.  A correction is put on the
    comparison of its field, or into `human_corrections` where the record has no such
    comparison.  Verdicts, `has_defect` and `defect_fields` stay as they were checked,
    unless `recompute` clears the two for settled records.  Each review adds its note to
    `notes`, in the order of the ids; the notes are part of the record, so the most reviewed
    record bounds a task.  Without `notes` only flags and last values of the log travel, however
    often a record was reviewed; `review_notes` then has the notes as rows.

    The results are read once.
    """
    step = results.join(_fold(log, notes), "email_id", "left")
    fixes = F.coalesce(F.col("_corrections"), F.create_map().cast("map<string,string>"))
    settled = F.col("reviews").isNotNull()
    has = F.transform("comparisons", lambda c: c["field"])
    if notes:
        told = F.transform("_said", lambda r: note_text(r["action"], r["field"], r["corrected_value"], F.array_contains(has, r["field"])))
        step = step.withColumn("notes", F.when(settled, F.concat("notes", told)).otherwise(F.col("notes"))).drop("_said")
    marked = F.transform(
        "comparisons",
        lambda c: c.withField("human_correction", fixes[c["field"]]).withField(
            "reviewed", F.map_contains_key(fixes, c["field"])
        ),
    )
    step = step.withColumn("human_corrections", F.map_filter(fixes, lambda k, _: ~F.array_contains(has, k)))
    step = step.withColumn("comparisons", marked)
    step = step.withColumn("status", F.when(settled, "OK").otherwise(F.col("status")))
    step = step.withColumn("review_reason", F.when(~settled, F.col("review_reason")))
    if recompute:
        none = F.array().cast("array<string>")
        step = step.withColumn("has_defect", F.col("has_defect") & ~settled)
        step = step.withColumn("defect_fields", F.when(settled, none).otherwise(F.col("defect_fields")))
        step = step.withColumn("needs_review", F.col("needs_review") & ~settled)
    return step.withColumn("reviews", F.coalesce("reviews", F.lit(0))).drop("_corrections")


def note_text(action: Column, field: Column, value: Column, compared: Column) -> Column:
    from tallyclerk.operators.documents import _template

    def fill(template):
        return F.concat(*_template(template, field=field, value=value))

    return (
        F.when(action == "confirm", V.NOTE_CONFIRMED)
        .when(compared, fill(V.NOTE_CORRECTED))
        .otherwise(fill(V.NOTE_SUPPLIED))
    )


def review_notes(results: DataFrame, log: DataFrame) -> DataFrame:
    """One note per review of a stored record: (email_id, id, note), to be read in id order."""
    names = results.select("email_id", F.transform("comparisons", lambda c: c["field"]).alias("_names"))
    joined = log.join(names, "email_id")
    compared = F.array_contains("_names", F.col("field"))
    return joined.select(
        "email_id", "id", note_text(F.col("action"), F.col("field"), F.col("corrected_value"), compared).alias("note")
    )


def append_reviews(log: DataFrame, path: str) -> None:
    """Add the valid reviews of `log` (id, email_id, field, corrected_value, action) to a stored log.

    A log is only ever appended to; `created_at` is now where the rows do not say.
    """
    rows = valid_reviews(log)
    stamp = F.col("created_at") if "created_at" in log.columns else F.lit(None).cast("timestamp")
    rows = rows.withColumn("created_at", F.coalesce(stamp, F.current_timestamp()))
    rows.write.mode("append").parquet(path)


def review_history(log: DataFrame, email_id) -> DataFrame:
    return log.filter(F.col("email_id") == email_id).orderBy("id")


def with_stored_source(results: DataFrame, stored: DataFrame, key: str = "email_id") -> DataFrame:
    """Results whose source message is stored, the ones that can be checked again."""
    return results.join(stored.select(key), key, "left_semi")
