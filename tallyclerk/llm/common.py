"""Helpers the operators share: checked broadcasts, batches by bytes, linked groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk.operators.numbering import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that travels to Python, where the session does not say.
ARROW_BYTES = 2 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(df: DataFrame) -> DataFrame:
    """`df`, whose rows are to go to Python in batches bounded by bytes, not only by their number.

    By default a batch has 10,000 rows whatever they hold, so a batch of long texts could fill an executor.
    The session's own limit stands where it has one.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_ARROW_LIMIT, str((1 << 31) - 1)).rstrip("bB")) >= (1 << 31) - 1:
        conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch cut where the bytes of its text column pass another `size`."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = (np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1).tolist()
    for at, to in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
        yield batch.slice(at, to - at)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows; otherwise left for a shuffled join.

    Either way the join gives the same rows; counting stops just past the bound.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def linked_groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node its links reach.

    Alternates two steps until nothing changes: every node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. Each step keeps what is connected, and no step gathers a
    node's neighbours in one place: it is a partial minimum and a join that splits hot nodes. The
    number of rounds grows with the logarithm of the longest chain. Rounds are cut by checkpoints.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = checkpointed(ordered)
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large step: neighbours above a node are linked to the smallest of the node and its neighbours.
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        # Small step: a node's lower neighbours are linked to the lowest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(low, "b")
        small = joined.select("low", F.col("a").alias("x")).filter("low <> x").union(low.select("low", F.col("b").alias("x")))
        now = checkpointed(small.select(F.col("low").alias("a"), F.col("x").alias("b")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("links did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
