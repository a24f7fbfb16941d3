"""Message classification: ordered phrase rules, structural signal, model fallback."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.text import _col, canonical, sender_domain
from tallyclerk.operators.numbering import checkpointed, numbered

CLASS_STRUCT = "struct<category:string,confidence:double,method:string,evidence:string>"


def classification(category, confidence, method="rule", evidence="") -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        c(category).alias("category"),
        c(confidence).cast("double").alias("confidence"),
        c(method).alias("method"),
        c(evidence).alias("evidence"),
    )


def match_rules(body: Column, rules=None) -> Column:
    """Classification of the first phrase, in declared order, that the canonical body holds.

    Unrolled into one CASE, so it stops at the first hit and stays in generated code.
    """
    out = None
    for category, phrases, confidence in rules or V.PHRASE_RULES:
        for phrase in phrases:
            test, hit = body.contains(phrase), classification(category, confidence, "rule", phrase)
            out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def attachment_count(attachments: Column | str) -> Column:
    return F.coalesce(F.size(_col(attachments)), F.lit(0))


def classify(
    messages: DataFrame,
    body: str = "body",
    attachments: str = "attachments",
    rules=None,
    into: str = "classification",
) -> DataFrame:
    """Add a classification struct; also keeps the canonical body as `canonical_body`."""
    out = messages.withColumn("canonical_body", canonical(body))
    by_rule = match_rules(F.col("canonical_body"), rules)
    by_structure = F.when(
        attachment_count(attachments) > 0,
        classification(V.COMPARISON_CATEGORY, V.WEAK, "rule", V.ATTACHMENT_EVIDENCE),
    )
    default = classification(V.DEFAULT_CATEGORY, V.GUESS, "rule", V.DEFAULT_EVIDENCE)
    return out.withColumn(into, F.coalesce(by_rule, by_structure, default))


def rules_table(spark, rules=None) -> DataFrame:
    """The rules as rows (priority, category, phrase, confidence)."""
    rows, n = [], 0
    for category, phrases, confidence in rules or V.PHRASE_RULES:
        for phrase in phrases:
            rows.append((n, category, phrase, confidence))
            n += 1
    return spark.createDataFrame(
        rows, "priority int, category string, phrase string, confidence double"
    )


#: Rule lists of up to this many rows are tested one by one; longer ones become automata.
BROADCAST_RULES = 2_000
#: Characters of phrases that one automaton is built of, so what a worker holds is bounded.
AUTOMATON_CHARS = 4 << 20


def match_rules_table(
    messages: DataFrame, rules: DataFrame, body: str = "canonical_body"
) -> DataFrame:
    """First matching rule when rules are data; adds `rule`, NULL where none matches.

    A rule list stays a table.  A short one travels as one row to every task.  A longer one
    is numbered in the order of its rules and cut into blocks of bounded size.  Each block is
    a pass of its own: its workers build one Aho-Corasick automaton, which reads a body once
    whatever the number of phrases, and let go of it, so a worker holds one block however
    many there are.  Both ways give the same rows.
    """
    usable = rules.filter(F.coalesce(F.length("phrase"), F.lit(0)) > 0)
    entry = F.struct("priority", "category", "phrase", F.col("confidence").cast("double").alias("confidence"))
    if usable.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(usable.agg(F.sort_array(F.collect_list(entry)).alias("_rules")))
        first = F.get(F.filter("_rules", lambda r: F.contains(F.col(body), r["phrase"])), F.lit(0))
        step = messages.crossJoin(listed).withColumn("_first", first).drop("_rules")
    else:
        step = _match_blocks(messages, usable.select(entry.alias("r")).select("r.*"), body)
    first = F.col("_first")
    rule = classification(first["category"], first["confidence"], "rule", first["phrase"])
    return step.withColumn("rule", F.when(first.isNotNull(), rule)).drop("_first")


RULE_STRUCT = "struct<priority:int,category:string,phrase:string,confidence:double>"


def _match_blocks(messages: DataFrame, rules: DataFrame, body: str) -> DataFrame:
    """`messages` with the first rule they hold as `_first`: one pass over their bodies a block.

    A pass writes what it found.  Bodies that are settled leave when they are half of those still read,
    so all rewriting together is no more than the bodies once.
    """
    # Every task of a pass builds the automaton, so there are no more of them than cores.
    cores = messages.sparkSession.sparkContext.defaultParallelism
    base = checkpointed(messages.withColumn("_id", F.monotonically_increasing_id()))
    left = base.select("_id", F.col(body).alias("_body")).coalesce(cores)
    size, hits, recent = left.count(), [], []
    for n, block in enumerate(_rule_blocks(rules)):
        shared = messages.sparkSession.sparkContext.broadcast(block)
        found = left.withColumn("_first", _first_of(shared)("_body")).filter(F.col("_first.phrase").isNotNull())
        recent.append(checkpointed(found.select("_id", F.lit(n).alias("_block"), "_first")))
        shared.destroy()
        settled = reduce(DataFrame.unionAll, recent).select("_id").distinct()
        gone = settled.count()
        if 2 * gone >= size:
            left, size = checkpointed(left.join(settled.hint("merge"), "_id", "left_anti")).coalesce(cores), size - gone
            hits, recent = hits + recent, []
        if size == 0:
            break
    if not hits + recent:
        return base.drop("_id").withColumn("_first", F.lit(None).cast(RULE_STRUCT))
    first = reduce(DataFrame.unionAll, hits + recent).groupBy("_id").agg(F.min_by("_first", "_block").alias("_first"))
    return base.join(first.hint("merge"), "_id", "left").drop("_id")


def _rule_blocks(rules: DataFrame) -> Iterator[list[tuple]]:
    """The rules in order, in blocks of some AUTOMATON_CHARS; one block at a time is on the driver."""
    ordered = numbered(rules, "priority", "category", "phrase", "confidence")
    size = ordered.agg(F.count("*").alias("n"), F.max(F.length("phrase")).alias("w")).first()
    rows = max(1, AUTOMATON_CHARS // size.w)
    for at in range(0, size.n, rows):
        block = ordered.filter(F.col("n").between(at, at + rows - 1)).orderBy("n").collect()
        yield [(r.priority, r.category, r.phrase, r.confidence) for r in block]


def _first_of(shared: Broadcast):
    """Function of a text column: the first of the rules in `shared` whose phrase it holds."""

    @F.pandas_udf(RULE_STRUCT)
    def first(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        rules, automaton = shared.value, ahocorasick.Automaton()
        for n, rule in enumerate(rules):
            if rule[2] not in automaton:  # of equal phrases the first rule wins
                automaton.add_word(rule[2], n)
        automaton.make_automaton()
        for texts in bodies:
            rows = []
            for text in texts:
                best = min((n for _, n in automaton.iter(text)), default=None) if text else None
                rows.append(rules[best] if best is not None else (None,) * 4)
            frame = pd.DataFrame(rows, columns=["priority", "category", "phrase", "confidence"], dtype=object)
            yield frame.astype({"priority": "Int32", "confidence": "Float64"})

    return first


def unsure(classified: DataFrame, threshold: float = V.TRUST_THRESHOLD, column="classification") -> DataFrame:
    """Rows the rules could not settle: the ones worth asking a model about."""
    return classified.filter(F.col(column)["confidence"] < threshold)


def apply_model(
    classified: DataFrame,
    category: Column,
    confidence: Column,
    column: str = "classification",
    cap: float = V.MODEL_CAP,
) -> DataFrame:
    """Where no rule or structure decided, take a model answer, its confidence capped.

    A missing answer keeps the default.
    """
    current = F.col(column)
    open_case = (current["evidence"] == V.DEFAULT_EVIDENCE) & (current["method"] == "rule")
    answer = classification(category, F.least(confidence, F.lit(cap)), "llm", V.MODEL_EVIDENCE)
    return classified.withColumn(
        column, F.when(open_case & category.isNotNull() & confidence.isNotNull(), answer).otherwise(current)
    )


def offline_answer(sender: Column | str, mode: str, own_domain: str) -> Column:
    """Answer without a model: 'mock' goes by the sender's domain, 'off' is always unsure."""
    if mode == "off":
        return classification(V.DEFAULT_CATEGORY, V.UNUSABLE_PREDICTION, "llm", mode)
    own = F.coalesce(sender_domain(sender).endswith(own_domain), F.lit(False))
    return classification(
        F.when(own, V.DEFAULT_CATEGORY).otherwise("SPAM"), V.UNSTATED_CONFIDENCE, "llm", mode
    )


def validated_answer(category: Column | str, confidence: Column | str) -> Column:
    """A model answer made safe: unknown category is unusable, confidence is put in [0, 1]."""
    category, confidence = _col(category), _col(confidence)
    number = F.coalesce(confidence.try_cast("double"), F.lit(V.UNSTATED_CONFIDENCE))
    clamped = F.when(F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(number, F.lit(1.0))))
    known = F.coalesce(category.isin(*V.CATEGORIES), F.lit(False))
    return F.struct(
        F.when(known, category).otherwise(V.DEFAULT_CATEGORY).alias("category"),
        F.when(known, clamped).otherwise(V.UNUSABLE_PREDICTION).alias("confidence"),
        known.alias("usable"),
    )


def attachments_missing(canonical_body: Column | str, attachments: Column | str) -> Column:
    """A comparison is asked for but fewer than two documents are attached."""
    return (attachment_count(attachments) < 2) & _col(canonical_body).contains(
        V.MISSING_ATTACHMENT_PHRASE
    )
