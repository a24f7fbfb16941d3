"""The check on a stream of messages, and streaming upserts and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk.operators.evaluate import status_counts
from tallyclerk.plans.inbox import check_messages, classified, route, wants_documents
from tallyclerk.sources.inbox import MESSAGE_SCHEMA, relative
from tallyclerk.sources.store import ResultStore, latest, writer_of


def read_message_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages as they arrive under <root>/inbox; `arrived` is when their file was written."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).option("multiLine", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(f"{root}/inbox").select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def read_attachment_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """(path, content, arrived) of attachments as they arrive; path is relative to root."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.option("recursiveFileLookup", "true").load(f"{root}/attachments")
    return raw.select(relative(F.col("path"), root).alias("path"), "content", F.col("modificationTime").alias("arrived"))


def check_stream(
    messages: DataFrame,
    documents: DataFrame,
    store: ResultStore,
    checkpoint: str,
    available_now: bool = True,
    order: list[str] | None = None,
):
    """Check arriving messages against stored documents and upsert results.

    Every step of the check works on a micro-batch as it does on a table.  The checkpoint
    and the batch id name the partition written, so a batch repeated after a failure
    replaces itself and no other.  Of several versions of a message in one batch the newest
    by the columns `order` is checked.
    """
    writer_name = writer_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch, ["email_id"], order or [])
        store.upsert(check_messages(newest, documents), batch_id, writer_name)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def pair_arrivals(messages: DataFrame, documents: DataFrame, wait: str, delay: str) -> DataFrame:
    """Classified messages with their documents, both of them streams with a time `arrived`.

    A message that wants documents is held until both have come, from `wait` before it to `wait` after
    it; when that has passed it goes on with what there is.  Messages that want none are not held.  State
    older than `wait` and `delay` (how far rows may come out of order) is freed.  A document that arrives
    again pairs with its messages again.
    """
    late = messages.withWatermark("arrived", delay)
    out, seen = late.filter(wants_documents()), []
    for i, name in enumerate(("si", "bl")):
        path, at = f"_{name}_path", f"_{name}_at"
        side = documents.withWatermark("arrived", delay).select(
            F.col("path").alias(path), F.struct(*[c for c in documents.columns if c != "arrived"]).alias(name), F.col("arrived").alias(at))
        near = (F.col(at) >= F.col("arrived") - F.expr(f"interval {wait}")) & (F.col(at) <= F.col("arrived") + F.expr(f"interval {wait}"))
        out = out.join(side, (F.get(F.col("attachments"), F.lit(i)) == F.col(path)) & near, "left_outer").drop(path)
        out = out.withColumn(at, F.unix_micros(at))  # a number: a stream has one time, that of the message
        seen.append(at)
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in ("si", "bl", *seen)}
    return out.unionByName(late.filter(~wants_documents()).withColumns(none))


def check_arrivals(
    messages: DataFrame,
    documents: DataFrame,
    store: ResultStore,
    checkpoint: str,
    wait: str = "1 hour",
    delay: str = "10 minutes",
    available_now: bool = True,
    rules=None,
):
    """Check messages and extracted documents that both arrive over time, in any order, and upsert results.

    The results are those of `check_messages` over all messages and documents that arrived within `wait`
    of one another.  A named document that did not is one that is not stored, so its message goes to review.
    Of several pairings of a message in one batch, that of its newest version and newest documents is kept.
    """
    writer_name = writer_of(checkpoint)
    paired = pair_arrivals(classified(messages, rules, "arrived"), documents, wait, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        order = ["arrived", "_si_at", "_bl_at"]
        store.upsert(route(latest(batch, ["email_id"], order)), batch_id, writer_name)

    writer = paired.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_stream(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark; state older than it is freed."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counts_stream(results: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Status counts per time window; late rows are taken up to `delay`."""
    return status_counts(results.withWatermark(ts, delay).withColumn("window", F.window(ts, window)), "window")
