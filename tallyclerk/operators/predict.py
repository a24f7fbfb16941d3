"""Model answers: prompt keys, the answer cache, batching, and a hook that runs a model.

The model is any function pandas.DataFrame -> pandas.DataFrame.  It sees each distinct
prompt that is neither settled by rules nor cached, once, in Arrow batches on executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.text import _col, collapse, content_key
from tallyclerk.operators.classify import unsure, validated_answer
from tallyclerk.operators.numbering import numbered

# How much of a message a prompt shows.
SINGLE_LIMITS = {"subject": 200, "body": 1200}
BATCH_LIMITS = {"subject": 160, "body": 700}
UNKNOWN_SENDER = "(unknown)"

PROMPT = "FROM: {sender}\nSUBJECT: {subject}\nBODY:\n{body}\n"
BATCH_ENTRY = "--- id: {id}\nFROM: {sender}\nSUBJECT: {subject}\nBODY: {body}"


def render_prompt(
    sender: Column | str,
    subject: Column | str,
    body: Column | str,
    template: str = PROMPT,
    limits: dict[str, int] = SINGLE_LIMITS,
) -> Column:
    """Fill the template with sender, shortened subject and shortened collapsed body."""
    from tallyclerk.operators.documents import _template

    empty = F.lit("")
    shown_sender = F.coalesce(F.nullif(_col(sender), empty), F.lit(UNKNOWN_SENDER))
    shown_subject = F.substring(F.coalesce(_col(subject), empty), 1, limits["subject"])
    shown_body = F.substring(collapse(F.coalesce(_col(body), empty)), 1, limits["body"])
    return F.concat(*_template(template, sender=shown_sender, subject=shown_subject, body=shown_body))


def batch_prompts(pending: DataFrame, key: str = "email_id", size: int = V.BATCH_SIZE, template: str = "{emails}") -> DataFrame:
    """One prompt for every `size` messages in the order of their key: (batch, ids, prompt).

    Each message is shown shortened under its id; only the last batch is short, and what is
    gathered is a batch.
    """
    shown = render_prompt("from", "subject", "body", BATCH_ENTRY.replace("{id}", "\x00"), BATCH_LIMITS)
    entry = F.replace(shown, F.lit("\x00"), F.col(key).cast("string"))
    rows = pack_batches(pending.select(F.col(key), entry.alias("_entry")), key, size)
    batch = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "_entry"))).alias("_rows"))
    before, _, after = template.partition("{emails}")
    text = F.array_join(F.transform("_rows", lambda r: r["_entry"]), "\n\n")
    return batch.select("batch", F.transform("_rows", lambda r: r["id"]).alias("ids"), F.concat(F.lit(before), text, F.lit(after)).alias("prompt"))


def with_prompt(messages: DataFrame, template: str = PROMPT, legacy_prefix: str | None = None) -> DataFrame:
    """Add `prompt`, its cache key, and the key older entries were stored under.

    Keys depend on the prompt only, so answers outlive a change of model; entries of the
    older scheme also hash the model's name.
    """
    out = messages.withColumn("prompt", render_prompt("from", "subject", "body", template))
    out = out.withColumn("prompt_key", content_key("prompt"))
    if legacy_prefix is not None:
        old = F.concat(F.lit(legacy_prefix + "\x00"), F.col("prompt"))
        out = out.withColumn("legacy_key", content_key(old))
    return out


def cached_answers(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Left-join cached answers by current key, then by legacy key.

    `cache` is unique by prompt_key; the older key costs a second join.
    """
    entries = cache.select("prompt_key", F.struct("category", "confidence").alias("_answer"))
    out = prompts.join(entries, "prompt_key", "left")
    if "legacy_key" in prompts.columns:
        old = entries.select(F.col("prompt_key").alias("legacy_key"), F.col("_answer").alias("_old"))
        out = out.join(old, "legacy_key", "left")
        out = out.withColumn("_answer", F.coalesce("_answer", "_old")).drop("_old")
    return out.select("*", "_answer.category", "_answer.confidence").drop("_answer")


def cache_misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts without a cached answer under either key."""
    keys = cache.select("prompt_key")
    out = prompts.join(keys, "prompt_key", "left_anti")
    if "legacy_key" in prompts.columns:
        out = out.join(keys.withColumnRenamed("prompt_key", "legacy_key"), "legacy_key", "left_anti")
    return out


def pack_batches(rows: DataFrame, key: str, size: int = V.BATCH_SIZE, buckets: int | None = None) -> DataFrame:
    """Number rows into request batches of `size`, in the order of their key; only the last one is short.

    Numbers are exact and no task sorts more than its range of keys (see `numbered`).  With
    `buckets`, which needs no table written in between, rows spread over them by a hash of
    their unique key and are numbered within: (bucket, batch), one short batch a bucket.
    """
    from pyspark.sql import Window

    if buckets is None:
        return numbered(rows, key, into="_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("bigint")
    out = rows.withColumn("bucket", F.pmod(digest, F.lit(buckets)))
    order = Window.partitionBy("bucket").orderBy(key)
    return out.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))


def predict(
    pending: DataFrame,
    model: Callable[[pd.DataFrame], pd.DataFrame],
    size: int = V.BATCH_SIZE,
    parallelism: int | None = None,
    failures: Accumulator | None = None,
) -> DataFrame:
    """Ask the model about each distinct prompt; returns (prompt_key, category, confidence, why).

    Copies of one prompt are dropped before the shuffle that spreads the work, so a text
    sent a million times is asked once.  `parallelism` bounds concurrent callers.  A call
    that fails answers nothing, so its messages keep the default; `failures`, an accumulator,
    counts the prompts of such calls.
    """
    asked = pending.select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    if parallelism:
        asked = asked.repartition(parallelism, "prompt_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), size):
                chunk = pdf.iloc[start : start + size]
                try:
                    got = model(chunk)
                except Exception:  # the default stands
                    if failures is not None:
                        failures.add(len(chunk))
                    continue
                yield got.reindex(columns=["prompt_key", "category", "confidence", "why"]).astype(
                    {"prompt_key": str}
                )

    raw = asked.mapInPandas(run, "prompt_key string, category string, confidence double, why string")
    checked = validated_answer("category", "confidence")
    return raw.select("prompt_key", checked.alias("_a"), F.substring("why", 1, 60).alias("why")).filter(
        "_a.usable"
    ).select("prompt_key", "_a.category", "_a.confidence", "why")


def answer_unsure(
    classified: DataFrame,
    cache: DataFrame,
    model: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Answers for messages rules left open: (answers by email_id, new cache entries).

    `classified` needs email_id, from, subject, body, classification.
    """
    open_cases = with_prompt(unsure(classified))
    known = cache.select("prompt_key", "category", "confidence", "why")
    fresh = predict(cache_misses(open_cases, cache), model, **options) if model else known.limit(0)
    answers = cached_answers(open_cases, known.unionByName(fresh))
    return answers.filter(F.col("category").isNotNull()).select("email_id", "category", "confidence"), fresh


def lenient_json(text: Column | str) -> Column:
    """The JSON object in a model's reply, or NULL.

    Code fences are dropped; the whole rest is taken if it parses, else its first {...}.
    """
    bare = F.trim(F.regexp_replace(F.trim(_col(text)), r"(?m)^\s*```(?:json)?|```\s*$", ""))
    first = F.regexp_extract(bare, r"(?s)\{.*?\}", 0)

    def parses(c):
        return F.try_parse_json(c).isNotNull() & (c != "")

    return F.when(parses(bare), bare).when(parses(first), first)


def explode_reply(replies: DataFrame, reply: str, *keep: str, asked: str | None = None) -> DataFrame:
    """Rows (id, category, confidence, why) of a reply holding one object per id.

    Entries with an unknown category are dropped, and so are ids that are not in the array
    column `asked`; confidence is checked and clamped.
    """
    entry = "struct<category:string,confidence:string,why:string>"
    parsed = F.from_json(lenient_json(reply), f"map<string,{entry}>")
    if asked:
        parsed = F.map_filter(parsed, lambda k, _: F.array_contains(F.col(asked).cast("array<string>"), k))
    rows = replies.select(*keep, F.explode(parsed).alias("id", "_e"))
    answer = validated_answer(F.col("_e")["category"], F.col("_e")["confidence"])
    return (
        rows.withColumn("_a", answer)
        .filter("_a.usable")
        .select(*keep, "id", "_a.category", "_a.confidence", F.substring("_e.why", 1, 60).alias("why"))
    )
