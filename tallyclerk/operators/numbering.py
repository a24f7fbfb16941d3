"""Tables written to the shared folder, and exact global row numbers without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row's place within its partition in monotonically_increasing_id.
_PLACE_BITS = 33


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, None if none is set on a cluster.

    It is the one in spark.checkpoint.dir. Only on a local master, where driver and executors
    share their disk, is one made if none is set; on a cluster that would be lost with the machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                return None
            folder = tempfile.mkdtemp(prefix="tallyclerk-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's shared folder and read from there, so lost executors cost nothing."""
    if _shared_folder(df.sparkSession) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet files in the cluster's shared folder, for tables that are read more than once.

    Unlike a checkpoint the files are compressed and each reader takes its columns only. On a cluster
    without such a folder `df` comes back as it is, and is computed by every reader.
    """
    folder = _shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: str | Column, into: str = "n", partitions: int | None = None) -> DataFrame:
    """`rows` with their places, from 0, in the order of `order` (ascending, nulls first).

    Two passes and no window: rows are dealt to ranges of the order and sorted there, which is written
    down; the rows of each range are counted, and a row's number is what the ranges before it hold plus its
    place in its own. Only a count per partition reaches the driver. Rows that are equal in the order are
    spread over ranges at random, so many equal rows burden no task; which of them comes first is open.
    The result is sorted within its partitions, which follow one another in the order.
    """
    salt, part, place = "_salt", "_part", "_place"
    salted = rows.withColumn(salt, F.rand(11))
    dealt = salted.repartitionByRange(*([partitions] if partitions else []), *order, salt)
    written = checkpointed(dealt.sortWithinPartitions(*order, salt).drop(salt))
    located = written.withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})
    before, offsets = 0, []
    for p, count in sorted((r[part], r["count"]) for r in located.groupBy(part).count().collect()):
        offsets.append((p, before))
        before += count
    if not offsets:
        return rows.limit(0).withColumn(into, F.lit(0).cast("bigint"))
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{part} int, _before bigint"))
    return located.join(starts, part).withColumn(into, F.col("_before") + F.col(place)).drop(part, place, "_before")
