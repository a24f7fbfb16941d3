"""What differs between two versions of a table, found by digests before any rows are compared.

Rows are dealt to leaves by the hash of their key. The digest of a leaf is a count and two sums of row
hashes, so it adds up from any parts of the leaf, in any order, and a node above is the sum of its leaves:
a tree of digests. Two trees are compared from the root down, and only rows of differing leaves are
compared. A table stored with its tree is kept in folders of neighbouring leaves, so other folders are
not read. Column names of tables must not begin with `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk.operators.numbering import checkpointed

#: A level of the tree has 2**STEP times the nodes of the one above it.
STEP = 4
#: A stored table has 2**BRANCH folders.
BRANCH = 8
_DIGEST = ["n", "high", "low"]


def leaf_of(keys: list[str], bits: int) -> Column:
    """Leaf of a row, from 0 to 2**bits - 1; NULL in a key is a value like any other."""
    return F.shiftrightunsigned(row_hash(keys), 64 - bits).cast("int")


def row_hash(columns: list[str]) -> Column:
    """Hash of a row's values in the order of `columns`; a NULL differs from every value."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def leaf_digests(rows: DataFrame, keys: list[str], columns: list[str], bits: int) -> DataFrame:
    """(leaf, n, high, low): at most 2**bits rows, added up before they are shuffled.

    The halves of a hash are added up apart, so no sum leaves a bigint below 2**31 rows a leaf.
    """
    h = F.col("_h")
    hashed = rows.select(leaf_of(keys, bits).alias("leaf"), row_hash(columns).alias("_h"))
    return hashed.groupBy("leaf").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))


def digest_tree(leaves: DataFrame, bits: int) -> DataFrame:
    """(level, node, n, high, low) of all nodes; level 0 is the root, the last level has the leaves."""
    levels = -(-bits // STEP)
    places = [F.struct(F.lit(lv).alias("level"), F.shiftright("leaf", max(bits - lv * STEP, 0)).alias("node")) for lv in range(levels + 1)]
    at = leaves.select(F.explode(F.array(*places)).alias("_p"), *_DIGEST).select("_p.*", *_DIGEST)
    return at.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in _DIGEST])


def differing_leaves(before: DataFrame, after: DataFrame, bits: int) -> DataFrame:
    """(leaf) of two trees whose digests differ, from the root down: below equal nodes nothing is looked at."""
    levels, found = -(-bits // STEP), None
    for lv in range(levels + 1):
        sides = [t.filter(F.col("level") == lv).select("node", F.struct(*_DIGEST).alias(name)) for t, name in ((before, "a"), (after, "b"))]
        if found is not None:
            step = max(bits - (lv - 1) * STEP, 0) - max(bits - lv * STEP, 0)
            sides = [s.join(F.broadcast(found), F.shiftright(s["node"], step) == found["parent"], "left_semi") for s in sides]
        both = sides[0].join(sides[1], "node", "full_outer")
        found = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("node").alias("parent"))
    return found.select(F.col("parent").alias("leaf"))


def compare_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows differ: (keys, change, n_before, n_after, differing).

    Equal rows cancel out first, repeated ones one against one, so a key with very many rows sends one
    per task and value. `change` is added, removed or changed (rows on both sides are left); n_before and
    n_after count the rows of either side that have no equal one on the other; `differing` names the
    columns that differ where there is one row on each side. NULL keys are keys.
    """
    values = [c for c in columns if c not in keys]
    signed = before.select(*columns, F.lit(1).alias("_s")).unionByName(after.select(*columns, F.lit(-1).alias("_s")))
    # A struct groups NULLs together and keeps the clashing names of the input apart from the result's.
    made = signed.select(F.struct(*keys).alias("_k"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(values)], F.lit(0).alias("_")).alias("_r"), "_s")
    net = made.groupBy("_k", "_r").agg(F.sum("_s").alias("net")).filter("net <> 0")
    gone, come = F.col("net") > 0, F.col("net") < 0
    per_key = net.groupBy("_k").agg(
        F.coalesce(F.sum(F.when(gone, F.col("net"))), F.lit(0)).alias("n_before"),
        F.coalesce(-F.sum(F.when(come, F.col("net"))), F.lit(0)).alias("n_after"),
        F.first(F.when(gone, F.col("_r")), ignorenulls=True).alias("_a"),
        F.first(F.when(come, F.col("_r")), ignorenulls=True).alias("_b"),
    )
    names = [F.when(~F.col("_a")[f"c{i}"].eqNullSafe(F.col("_b")[f"c{i}"]), F.lit(c)) for i, c in enumerate(values)]
    single = (F.col("n_before") == 1) & (F.col("n_after") == 1)
    none = F.array().cast("array<string>")
    return per_key.select(
        *[F.col("_k")[k].alias(k) for k in keys],
        F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").otherwise("changed").alias("change"),
        "n_before",
        "n_after",
        F.when(single, F.array_compact(F.array(*names))).otherwise(none).alias("differing") if names else none.alias("differing"),
    )


def diff(before: DataFrame, after: DataFrame, keys: list[str], bits: int = 12) -> DataFrame:
    """Differences of two tables with the same columns, as `compare_rows` gives them.

    Both are read for their digests and once more for the leaves that differ, so little of them is shuffled
    when little has changed. The differing leaves, at most 2**bits numbers, are broadcast: `bits` up to 20
    keep them under 10 MB.
    """
    columns = _common(before, after, keys, bits)
    trees = [checkpointed(digest_tree(leaf_digests(t, keys, columns, bits), bits)) for t in (before, after)]
    leaves = F.broadcast(differing_leaves(*trees, bits))
    sides = [t.withColumn("_leaf", leaf_of(keys, bits)).join(leaves, F.col("_leaf") == leaves["leaf"], "left_semi") for t in (before, after)]
    return compare_rows(*sides, keys, columns)


def _common(before: DataFrame, after: DataFrame, keys: list[str], bits: int) -> list[str]:
    columns = sorted(before.columns)
    if sorted(before.dtypes) != sorted(after.dtypes) or not set(keys) <= set(columns):
        raise ValueError("both tables need the same columns and types, the keys among them")
    if any(c.startswith("_") for c in columns) or not BRANCH <= bits <= 20:
        raise ValueError(f"bits must be from {BRANCH} to 20, and no column name may begin with _")
    return columns


def _branch(leaf: Column, bits: int) -> Column:
    return F.shiftright(leaf, bits - BRANCH)


def write_snapshot(rows: DataFrame, keys: list[str], path: str, bits: int = 12) -> None:
    """Store a table in folders of neighbouring leaves, and its tree of digests beside it.

    Rows are dealt to ranges of leaf and row hash, so a key that holds very many different rows is split.
    """
    columns = _common(rows, rows, keys, bits)
    leaved = rows.withColumn("_leaf", leaf_of(keys, bits)).withColumn("_branch", _branch(F.col("_leaf"), bits))
    dealt = leaved.repartitionByRange("_leaf", row_hash(columns)).sortWithinPartitions("_leaf")
    dealt.write.mode("overwrite").partitionBy("_branch").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    digest_tree(leaf_digests(stored, keys, columns, bits), bits).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def diff_snapshots(spark: SparkSession, before: str, after: str, keys: list[str], bits: int = 12) -> DataFrame:
    """`diff` of two stored snapshots, made with the same keys and bits: trees, then only leaves that differ.

    The folders of differing leaves, at most 2**BRANCH numbers, are collected to skip all others.
    """
    sides = [spark.read.parquet(f"{p}/rows") for p in (before, after)]
    plain = [s.drop("_leaf", "_branch") for s in sides]
    columns = _common(*plain, keys, bits)
    found = checkpointed(differing_leaves(*[spark.read.parquet(f"{p}/tree") for p in (before, after)], bits))
    folders = [r.b for r in found.select(_branch(F.col("leaf"), bits).alias("b")).distinct().collect()]
    leaves = F.broadcast(found)
    kept = [s.filter(F.col("_branch").isin(folders)).join(leaves, F.col("_leaf") == leaves["leaf"], "left_semi") for s in sides]
    return compare_rows(*kept, keys, columns)
