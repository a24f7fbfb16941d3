"""Keyed result tables on plain Parquet: append changes, read the latest.

An upsert appends a partition named by its writer and batch; readers keep the newest row
per key.  Nothing stored is rewritten while it may be read, and a repeated batch overwrites
its own partition only, so lost executors and restarted streams leave one copy of each
batch, and two writers never meet.

The order of batches is kept beside the data, in a log of empty files: a writer takes the
next version by creating a file of that name and then notes which version its batch has.
So an upsert reads no data, however much is stored. Where the file system creates files
exclusively, as HDFS does, no two writers get one version; elsewhere two that start at the
same moment may, and then the writer's name decides which is newer, for every reader alike.
"""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.  Combined before the shuffle, so a hot key costs a row per task.

    Rows that tie in `order` are told apart by a hash of the row, so the choice never
    depends on where a row was read.
    """
    rest = [c for c in rows.columns if c not in keys]
    tie = F.xxhash64(F.to_json(F.struct(*rest)))
    newest = F.max_by(F.struct(*rest), F.struct(*order, tie.alias("_tie"))).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)


MARKS = ["version", "writer", "batch"]


def current(changes: DataFrame, key: str) -> DataFrame:
    """The row of each key that the newest batch wrote, without the marks of its partition."""
    return latest(changes, [key], MARKS).drop(*MARKS)


def writer_of(checkpoint: str) -> str:
    """Writer name of a stream: one per checkpoint, so a new checkpoint never replaces old batches."""
    return "s" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def snapshot_sources(messages: DataFrame, attachments: DataFrame, path: str) -> None:
    """Keep messages and the bytes of their documents, so a record can be checked again."""
    messages.write.mode("overwrite").parquet(f"{path}/messages")
    attachments.write.mode("overwrite").parquet(f"{path}/attachments")


def stored_sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, attachments) of a snapshot, as `plans.inbox.recheck_inbox` takes them."""
    return spark.read.parquet(f"{path}/messages"), spark.read.parquet(f"{path}/attachments")


class ResultStore:
    """Latest-wins table under `path`, one partition per writer and batch.

    Partitions carry a version that grows with every new batch of any writer; the newest
    row of a key is the one of the highest version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "email_id"):
        self.spark, self.path, self.key = spark, path, key

    def _log(self, *names: str):
        """(file system, path) of a part of the log; Spark does not read folders of such a name."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, "_log", *names)))
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _names(self, *names: str) -> list[str]:
        fs, at = self._log(*names)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _create(self, *names: str) -> bool:
        """Make an empty file; False if it is there already, also if another writer was faster."""
        fs, at = self._log(*names)
        try:
            return fs.createNewFile(at)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise

    def _begin_log(self) -> None:
        """Log of what was stored before there was one."""
        if self._names("versions"):
            return
        try:
            marks = self.changes().select(*MARKS).distinct().collect()  # a row per batch
        except AnalysisException as nothing:
            # Anything else, such as tables that do not fit together, is not an empty store.
            if nothing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            marks = []
        for m in marks:
            self._create("batches", f"{m.writer}", f"{m.batch}", str(m.version))
            self._create("versions", str(m.version))

    def _version(self, writer: str, batch: int) -> int:
        """The batch's own version if it was written before, else the next one."""
        self._begin_log()
        mine = self._names("batches", writer, str(batch))
        if mine:
            return int(max(mine, key=int))
        version = max(map(int, self._names("versions")), default=0) + 1
        while not self._create("versions", str(version)):
            version += 1
        self._create("batches", writer, str(batch), str(version))
        return version

    def upsert(self, rows: DataFrame, batch: int, writer: str = "main", order: list[str] | None = None) -> None:
        """Write a batch.  Rows of later batches win; a batch written again replaces itself.

        Within a batch the newest row of a key by the columns `order` is kept.
        """
        version = self._version(writer, int(batch))
        one = latest(rows, [self.key], order or [])
        one.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(
            f"{self.path}/writer={writer}/batch={int(batch)}"
        )

    def changes(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def read(self) -> DataFrame:
        return current(self.changes(), self.key)

    def compact(self, path: str) -> ResultStore:
        """Write the latest rows to a new table and return it; the old one stays.

        They are a batch of a writer of their own, so no later batch takes their place.
        """
        fresh = ResultStore(self.spark, path, self.key)
        fresh.upsert(self.read(), 0, "compacted")
        return fresh

    def replace(self, rows: DataFrame) -> None:
        """Snapshot: drop everything stored, then write.  `rows` must not read this table."""
        marked = rows.withColumns({"version": F.lit(1).cast("bigint"), "writer": F.lit("snapshot"), "batch": F.lit(0)})
        marked.write.mode("overwrite").partitionBy("writer", "batch").parquet(self.path)
        self._begin_log()
