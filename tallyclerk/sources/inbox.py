"""Reading inboxes, attachments and truth files; writing results."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk.sources.keyed import read_keyed

MESSAGE_SCHEMA = (
    "email_id string, `from` string, subject string, body string, attachments array<string>"
)
RECORD_SCHEMA = (
    "category string, status string, review_reason string, has_defect boolean,"
    " defect_fields array<string>, decided_by string"
)


def read_messages(spark: SparkSession, root: str, pattern: str = "email_*.json") -> DataFrame:
    """One message per JSON file under <root>/inbox."""
    return spark.read.schema(MESSAGE_SCHEMA).json(f"{root}/inbox/{pattern}", multiLine=True)


def read_attachments(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file under <root>/attachments; path is relative to root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/attachments")
    return raw.select(relative(F.col("path"), root).alias("path"), "content")


def relative(path, root: str):
    """What follows the first place where the whole root stands; file names are taken as they are."""
    below = "/" + posixpath.normpath(root.partition("://")[2] or root.removeprefix("file:")).strip("/") + "/"
    return F.substring(path, F.locate(below, path) + len(below), F.length(path))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, extension, sha256) of every file below root."""
    from tallyclerk.functions.text import extension

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", "length", extension("path").alias("extension"), F.sha2("content", 256).alias("sha256"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by id (truth or submission file) as rows, read by byte ranges."""
    return read_keyed(spark, path, RECORD_SCHEMA, "email_id")


def write_submission(results: DataFrame, path: str) -> None:
    """One JSON row per record."""
    from tallyclerk.plans.inbox import submission

    submission(results).write.mode("overwrite").json(path)


def write_reports(results: DataFrame, path: str, fmt: str = "json") -> None:
    """Full nested records."""
    results.write.mode("overwrite").format(fmt).save(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, quotes doubled inside quoted values."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').csv(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append run metrics; every part file carries the header, so readers use header=True."""
    write_csv(metrics, path, mode="append")
