"""Scoring a submission against truth.

All metrics read one joined table (`score_join`) and are sums of per-row flags, so each
is a single pass with partial aggregation.  Grouping by `run` columns scores many runs in
the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyclerk import vocab as V

EMPTY = "array<string>"


def score_join(truth: DataFrame, submission: DataFrame, key: str = "email_id", run: tuple[str, ...] = ()) -> DataFrame:
    """Truth left-joined to submission; a missing entry counts as GENERAL without defects.

    Identifiers only the submission has are ignored.  Both sides are unique by key.
    """
    sub = submission.select(
        *run,
        key,
        F.col("category").alias("p_category"),
        F.col("status").alias("p_status"),
        F.col("has_defect").alias("p_has_defect"),
        F.col("defect_fields").alias("p_fields"),
        *([F.col("decided_by")] if "decided_by" in submission.columns else []),
        F.lit(True).alias("submitted"),
    )
    none = F.array().cast(EMPTY)
    routed = F.coalesce(F.col("p_category") == V.COMPARISON_CATEGORY, F.lit(False))
    joined = truth.join(sub, [*run, key], "left")
    return joined.select(
        *run,
        key,
        F.col("category").alias("actual"),
        F.coalesce("p_category", F.lit(V.DEFAULT_CATEGORY)).alias("predicted"),
        F.col("status"),
        "review_reason",
        "p_status",
        F.coalesce("has_defect", F.lit(False)).alias("has_defect"),
        F.coalesce("defect_fields", none).alias("fields"),
        routed.alias("routed"),
        F.coalesce("p_has_defect", F.lit(False)).alias("p_has_defect"),
        F.coalesce("p_fields", none).alias("p_fields"),
        (F.col("decided_by") if "decided_by" in submission.columns else F.lit(None).cast("string")).alias("decided_by"),
        F.coalesce("submitted", F.lit(False)).alias("submitted"),
    )


def missing_ids(truth: DataFrame, submission: DataFrame, key: str = "email_id") -> DataFrame:
    return truth.select(key).join(submission.select(key), key, "left_anti")


def n_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def with_prf(df: DataFrame, tp="tp", fp="fp", fn="fn", prefix="") -> DataFrame:
    p, r = prefix + "precision", prefix + "recall"
    out = df.withColumn(p, ratio(F.col(tp), F.col(tp) + F.col(fp))).withColumn(
        r, ratio(F.col(tp), F.col(tp) + F.col(fn))
    )
    return out.withColumn(prefix + "f1", f1(F.col(p), F.col(r)))


def confusion(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    return joined.groupBy(*run, "actual", "predicted").agg(F.count("*").alias("n"))


def errors(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    return confusion(joined.filter("actual <> predicted"), run)


def _class_sums(classes: tuple[str, ...]) -> list[Column]:
    """True and false positives and false negatives of every class."""
    out = []
    for i, c in enumerate(classes):
        is_actual, is_predicted = F.col("actual").eqNullSafe(c), F.col("predicted").eqNullSafe(c)
        out += [
            n_if(is_actual & is_predicted).alias(f"_tp_{i}"),
            n_if(~is_actual & is_predicted).alias(f"_fp_{i}"),
            n_if(is_actual & ~is_predicted).alias(f"_fn_{i}"),
        ]
    return out


def _class_f1(i: int) -> Column:
    tp, fp, fn = (F.col(f"_{k}_{i}") for k in ("tp", "fp", "fn"))
    return f1(ratio(tp, tp + fp), ratio(tp, tp + fn))


def _total_sums() -> list[Column]:
    known = F.col("decided_by").isNotNull()
    return [
        n_if(F.col("actual") == F.col("predicted")).alias("_right"),
        n_if(F.col("decided_by") == "rule").alias("_by_rule"),
        n_if(known).alias("_known"),
        F.count("*").alias("n"),
    ]


def _defect_sums() -> list[Column]:
    """Sums over comparable records; each flag tests that itself, so other sums can stand beside them."""
    row = (F.col("actual") == V.COMPARISON_CATEGORY) & ~F.coalesce(F.col("status") == "NEEDS_REVIEW", F.lit(False))
    said, has = F.col("p_has_defect") & F.col("routed"), F.col("has_defect")
    gold = F.array_distinct("fields")
    found = F.when(F.col("routed"), F.array_distinct("p_fields")).otherwise(F.array().cast(EMPTY))
    shared = F.size(F.array_intersect(found, gold))

    def total(c):
        return F.coalesce(F.sum(F.when(row, c)), F.lit(0))

    return [
        n_if(row & has & said).alias("tp"),
        n_if(row & ~has & said).alias("fp"),
        n_if(row & has & ~said).alias("fn"),
        total(shared).alias("field_tp"),
        total(F.size(found) - shared).alias("field_fp"),
        total(F.size(gold) - shared).alias("field_fn"),
        n_if(row & (F.size(found) == F.size(gold)) & (shared == F.size(gold))).alias("exact"),
        n_if(row).alias("doc_total"),
    ]


def _end_to_end_sums() -> list[Column]:
    row = (F.col("actual") == V.COMPARISON_CATEGORY) & F.col("has_defect")
    exact = F.array_sort(F.array_distinct("p_fields")) == F.array_sort(F.array_distinct("fields"))
    return [n_if(row & F.col("routed") & F.col("p_has_defect") & exact).alias("success"), n_if(row).alias("total")]


def _with_classification(sums: DataFrame, classes: tuple[str, ...] = V.CATEGORIES) -> DataFrame:
    macro = sum((_class_f1(i) for i in range(len(classes))), F.lit(0.0)) / len(classes)
    share = F.col("_by_rule") / F.nullif(F.col("_known"), F.lit(0).cast("bigint"))
    return sums.withColumns({"accuracy": ratio(F.col("_right"), F.col("n")), "rule_share": share, "macro_f1": macro})


def _with_defects(sums: DataFrame) -> DataFrame:
    out = with_prf(sums, prefix="defect_")
    out = with_prf(out, "field_tp", "field_fp", "field_fn", "field_")
    return out.withColumn("exact_match_rate", ratio(F.col("exact"), F.col("doc_total")))


def per_class(joined: DataFrame, run: tuple[str, ...] = (), classes: tuple[str, ...] = V.CATEGORIES) -> DataFrame:
    """TP/FP/FN and P/R/F1 of every class; false positives count only for known classes.

    One aggregation per run whatever the number of classes; classes become rows after it.
    """
    sums = joined.groupBy(*run).agg(*_class_sums(classes))
    rows = F.array(
        *[F.struct(F.lit(c).alias("category"), *[F.col(f"_{k}_{i}").alias(k) for k in ("tp", "fp", "fn")]) for i, c in enumerate(classes)]
    )
    return with_prf(sums.select(*run, F.explode(rows).alias("r")).select(*run, "r.*"))


def classification_score(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro-F1 over all classes, and the share decided by rules."""
    sums = joined.groupBy(*run).agg(*_class_sums(V.CATEGORIES), *_total_sums())
    return _with_classification(sums).select(*run, "accuracy", "rule_share", "n", "macro_f1")


def defect_score(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Defect detection on comparable records: per record, per field, and exact sets."""
    return _with_defects(joined.groupBy(*run).agg(*_defect_sums()))


def escalation_score(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    gold = F.col("status") == "NEEDS_REVIEW"
    said = F.col("p_status") == "NEEDS_REVIEW"
    sums = joined.groupBy(*run).agg(
        n_if(gold & said).alias("tp"),
        n_if(said & ~F.coalesce(gold, F.lit(False))).alias("fp"),
        n_if(gold & ~F.coalesce(said, F.lit(False))).alias("fn"),
        n_if(gold).alias("gold_review"),
        n_if(said).alias("pred_review"),
    )
    return with_prf(sums, prefix="escalation_")


def per_reason(joined: DataFrame, run: tuple[str, ...] = (), reasons: tuple[str, ...] = V.SCORED_REASONS) -> DataFrame:
    """Escalations wanted and caught for every scored reason."""
    gold = F.col("status") == "NEEDS_REVIEW"
    sums = []
    for i, r in enumerate(reasons):
        wanted = gold & (F.col("review_reason") == r)
        sums += [n_if(wanted).alias(f"_total_{i}"), n_if(wanted & (F.col("p_status") == "NEEDS_REVIEW")).alias(f"_caught_{i}")]
    rows = F.array(
        *[F.struct(F.lit(r).alias("review_reason"), F.col(f"_total_{i}").alias("total"), F.col(f"_caught_{i}").alias("caught")) for i, r in enumerate(reasons)]
    )
    return joined.groupBy(*run).agg(*sums).select(*run, F.explode(rows).alias("r")).select(*run, "r.*")


def end_to_end_score(joined: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Records with a planted defect that were routed, flagged, and named field for field."""
    sums = joined.groupBy(*run).agg(*_end_to_end_sums())
    return sums.withColumn("rate", ratio(F.col("success"), F.col("total")))


def final_score(joined: DataFrame, run: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score and its parts; one row, or one per run.

    All parts are sums of flags of one aggregation, so `joined` is read once.
    """
    w = {**V.SCORE_WEIGHTS, **(weights or {})}
    sums = joined.groupBy(*run).agg(*_class_sums(V.CATEGORIES), *_total_sums(), *_defect_sums(), *_end_to_end_sums())
    out = _with_defects(_with_classification(sums)).withColumn("end_to_end", ratio(F.col("success"), F.col("total")))
    out = out.select(
        *run, "accuracy", "macro_f1", "n", "defect_precision", "defect_recall", "defect_f1", "field_f1", "success", "total", "end_to_end")
    total = sum(F.col(name) * F.lit(weight) for name, weight in w.items())
    return out.withColumn("final_score", total)


def run_record(results: DataFrame, score: DataFrame, dataset: str, seed: int | None = None, **more) -> DataFrame:
    """One row for a scored run: its counts, labels, and the whole evaluation as a struct.

    `score` has one row, such as `final_score` gives; `more` are further constant columns
    (requested_n, llm_enabled, rules_score).
    """
    labels = {"dataset": F.lit(dataset), "seed": F.lit(seed).cast("bigint"), **{k: F.lit(v) for k, v in more.items()}}
    counts = status_counts(results).withColumnRenamed("total", "processed")
    evaluation = score.select(F.struct(*[F.col(c) for c in score.columns]).alias("evaluation"))
    # Both sides are one row by construction: aggregates without grouping.
    both = counts.withColumn("_one", F.lit(1)).join(evaluation.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumns({**labels, "created_at": F.current_timestamp()})


def newest(rows: DataFrame, order: str, n: int = 5, most: int = 50) -> DataFrame:
    """The newest rows by an order column; n is brought into 1..most.

    Each task keeps its own n rows, so only those meet.
    """
    return rows.orderBy(F.desc(order)).limit(max(1, min(int(n), most)))


def metrics_long(scores: DataFrame, metrics: list[str], *keep: str) -> DataFrame:
    """One row per metric of a wide score table."""
    return scores.unpivot(list(keep), metrics, "metric", "value")


def metric_delta(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Change per metric between two long tables (metric, value); changes below tolerance are none."""
    pair = before.select("metric", F.col("value").alias("before")).join(
        after.select("metric", F.col("value").alias("after")), "metric"
    )
    d = F.col("after") - F.col("before")
    return pair.withColumn("delta", d).withColumn(
        "change", F.when(F.abs(d) < tolerance, "no change").when(d > 0, "up").otherwise("down")
    )


def headroom(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Points still available per weighted metric and their share of all of them.

    `metrics` has one row per metric of a short fixed list, so the total is a sum over a few rows.
    """
    w = weights or V.SCORE_WEIGHTS
    weight = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in w.items()])
    points = metrics.withColumn("points", (1 - F.col("value")) * weight).filter(F.col("points").isNotNull())
    whole = Window.partitionBy(F.lit(0))  # a handful of metrics
    total = F.sum("points").over(whole)
    return points.select("metric", "points", F.when(total > 0, F.col("points") / total * 100).otherwise(0.0).alias("share"))


def run_diff(truth: DataFrame, a: DataFrame, b: DataFrame, key: str = "email_id") -> DataFrame:
    """Records two runs classify differently, and whether the second run repaired or broke them."""
    pair = (
        a.select(key, F.col("category").alias("a"))
        .join(b.select(key, F.col("category").alias("b")), key)
        .filter("a <> b")
    )
    out = pair.join(truth.select(key, F.col("category").alias("gold")), key)
    return out.withColumn(
        "effect", F.when(F.col("b") == F.col("gold"), "fixed").otherwise("broken")
    )


def run_stats(scores: DataFrame, value: str, base: Column | float, *groups: str, margin: float = 0.03) -> DataFrame:
    """Mean, range, population deviation over runs, and the gap to a base run."""
    base = base if isinstance(base, Column) else F.lit(base)
    out = scores.groupBy(*groups).agg(
        F.count("*").alias("runs"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
    )
    out = out.withColumn("spread", F.col("max") - F.col("min")).withColumn("gap", F.col("mean") - base)
    return out.withColumn("verdict", F.when(F.col("gap") < -margin, "warning").otherwise("generalises"))


def status_counts(results: DataFrame, *groups: str) -> DataFrame:
    s = F.col("status")
    return results.groupBy(*groups).agg(
        F.count("*").alias("total"),
        n_if(s == "OK").alias("ok"),
        n_if(s == "MISMATCH").alias("mismatches"),
        n_if(s == "NEEDS_REVIEW").alias("needs_review"),
    )


def count_by(results: DataFrame, column: Column, name: str, unset: str | None = None) -> DataFrame:
    value = column if unset is None else F.coalesce(F.nullif(column, F.lit("")), F.lit(unset))
    return results.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def facets(results: DataFrame, *columns: str) -> DataFrame:
    """Counts for every combination of facet values, with ALL for 'any value'."""
    cube = results.select(*columns).cube(*columns).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    shown = [F.when(F.col(f"_g_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c) for c in columns]
    return cube.select(*shown, "n")


def quality_checks(measured: DataFrame, expectations: list[tuple[str, str, float]]) -> DataFrame:
    """Named threshold checks over a one-row table: (name, op, wanted) -> got, want, passed."""
    tests = {
        "=": lambda c, w: F.abs(c - w) < 0.002,
        ">": lambda c, w: c > w,
        ">=": lambda c, w: c >= w,
        "<": lambda c, w: c < w,
        "<=": lambda c, w: c <= w,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(name).cast("double").alias("got"),
                F.lit(op).alias("op"),
                F.lit(float(want)).alias("want"),
                F.coalesce(tests[op](F.col(name).cast("double"), F.lit(float(want))), F.lit(False)).alias("passed"),
            )
            for name, op, want in expectations
        ]
    )
    return measured.select(F.explode(rows).alias("r")).select("r.*")
