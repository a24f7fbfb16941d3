"""Quality rules with risk-controlled thresholds.

Base rules are fixed. Beyond them, each rule compares one rate of a document with a cutoff that is
chosen per stratum (language) from labelled documents. What is limited is the share of a stratum's good
documents that all rules together reject, the base rules included: the exact (Clopper-Pearson) upper bound of
the base rules' rate is taken from `alpha`, and what is left is divided among the other rules. A cutoff's false
rejections are counted, and the exact upper bound of their rate must not exceed the rule's part. Each
(stratum, rule) tests its cutoffs from lax to strict and stops at the first that fails, which needs no
correction along the sequence; across strata and rules the error `delta` is divided (Bonferroni). So with
probability 1 - delta not more than `alpha` of the good documents of any stratum are lost - unless the base rules
alone may lose as much, and then no other rule is used there. Among certified cutoffs the one is taken that rejects
the most bad documents, less `COST` for each good one, so that clean documents stay; a rule for which
that is never positive is not used, and a stratum with too few labels for a certificate gets none.

Features come from one pass over the whole texts in Arrow batches; labels meet features by doc_id,
and only counts per (stratum, rule, bin) are gathered, at most BINS rows each.

Odd input: a null text has no words and fails the base rules; a null lang is a stratum of its own;
repeated rows are judged each; of several labels of a document the smallest counts; labels without
a document and null labels teach nothing. An empty table gives an empty result. Columns other than doc_id, text,
lang, quality are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, checkpointed

ALPHA, DELTA, BINS, COST = 0.05, 0.05, 200, 5
SYMBOLS, SPACES, UPPER = "#*$%&|<>", " \t\n\x0b\x0c\r", bytes(range(65, 91))
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_marks".split()
#: Rates from 0 to 1, higher is worse; the cutoffs are chosen from the labels.
RULES = {
    "symbols": "n_symbols / (n_words + n_symbols)",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "upper": "n_upper / word_chars",
    "marks": "n_marks / (n_words + n_marks)",
}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 % (1 << 64) | 1 for i in range(64)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed += codes[i : i + n] * _MULTIPLIERS[i]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of a UTF-8 text; bytes.split, upper and strip touch ASCII only, as wanted."""
    raw = text or b""
    words = raw.split()
    characters = raw.decode("utf-8", "replace")
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES.encode())]
    return (
        len(words), len(characters) - sum(map(characters.count, SPACES)), sum(map(characters.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(raw) - len(raw.translate(None, UPPER)),
        sum(map(characters.count, "!?|")),
    )


def document_features(documents: DataFrame) -> DataFrame:
    """doc_id, stratum and the COUNTS of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", "stratum", *COUNTS])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"), F.col("text").cast("binary").alias("text"))
    return by_bytes(texts).mapInArrow(run, "doc_id bigint, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS))


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words"


def certified(lost: int, n: int, alpha: float, error: float) -> bool:
    """Whether the exact upper bound of a rate, `lost` of n seen, is at most alpha.

    The Clopper-Pearson bound is the rate under which seeing `lost` or fewer has probability
    `error`, so it is at most alpha just if that probability under alpha is at most `error`.
    """
    k = np.arange(lost + 1)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + math.log(alpha) - math.log1p(-alpha)
    logs = n * math.log1p(-alpha) + np.concatenate([[0.0], np.cumsum(steps)])
    return lost < n and float(np.exp(logs).sum()) <= error


def upper_bound(lost: int, n: int, error: float) -> float:
    """The exact upper bound of a rate of which `lost` of n were seen; 1 where it has none."""
    low, high = 0.0, 1.0
    if lost >= n:
        return 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if certified(lost, n, mid, error) else (mid, high)
    return high


def certified_cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, n_good: int, alpha: float, error: float) -> float | None:
    """Cutoff bin c of a rule (reject where the bin is above c), or None.

    bins with their counts of good and bad documents; cutoffs run from lax (high) to strict.
    """
    order = np.argsort(bins)[::-1]
    passed, lost, caught = [], 0, 0
    for i in order:  # rejecting from bins[i] upwards
        lost, caught = lost + int(good[i]), caught + int(bad[i])
        if lost > alpha * n_good or not certified(lost, n_good, alpha, error):
            break
        passed.append((float(bins[i]), caught - COST * lost))
    best = max(passed, key=lambda p: p[1], default=(0.0, 0))  # of equal ones the laxest
    return best[0] if best[1] > 0 else None


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule: the bin from which on it rejects, or null)."""
    truth = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _bin(v).alias("bin")) for k, v in RULES.items()]))
    told = measured.join(truth, "doc_id").withColumn("failed", F.expr(BASE_FAILED))
    good = F.col("quality") >= 1
    base = told.groupBy("stratum").agg(F.count_if(good).alias("n_good"), F.count_if(good & F.col("failed")).alias("n_failed"))
    rows = told.filter(~F.col("failed")).select("stratum", "quality", rates.alias("r"))
    counts = rows.groupBy("stratum", "r.rule", "r.bin").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count_if(F.col("quality") < 1).alias("bad"))
    counts = checkpointed(counts.join(broadcast_if_small(base, 10_000), "stratum"))
    tests = max(1, counts.select("stratum").distinct().count() * (len(RULES) + 1))

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_good"].iloc[0])
        part = (alpha - upper_bound(int(rows["n_failed"].iloc[0]), n, delta / tests)) / len(RULES)
        at = certified_cutoff(rows["bin"].to_numpy(), rows["good"].to_numpy(), rows["bad"].to_numpy(), n, part, delta / tests) if part > 0 else None
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [at]})

    chosen = counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cut_{k}") for k in RULES])


def _bin(rate: str):
    return F.floor(F.least(F.lit(1.0), F.coalesce(F.expr(f"try_divide({rate.split(' / ')[0]}, {rate.split(' / ', 1)[1]})"), F.lit(0.0))) * BINS)


def judge(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rules that rejected."""
    measured = checkpointed(document_features(documents))
    limits = broadcast_if_small(cutoffs(measured, labels, alpha, delta), 10_000)
    broken = F.array_compact(F.array(*[F.when(_bin(v) >= F.col(f"cut_{k}"), F.lit(k)) for k, v in RULES.items()]))
    failed = F.expr(BASE_FAILED)
    return measured.join(limits, "stratum", "left").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"), broken.alias("rejected_by"))
