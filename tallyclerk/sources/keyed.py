"""One large JSON object keyed by id, read by many tasks.

Spark cuts the file into byte ranges by itself when its lines end with `}`; what it cannot know is
whether such a brace stands inside a string, and where in the nesting a range begins. Both follow from
sums over what stands before: the parity of quotes that are not escaped, then braces outside strings.
Every range sums up itself, the sums of the ranges before it are added (a row per range on the driver),
and the pieces between braces are put together to entries by a running number. Nothing reads the whole
file, and an entry crosses ranges as freely as pieces do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyclerk.operators.numbering import checkpointed

_PLACE_BITS = 33
#: A backslash and what it escapes. A piece ends at a brace, which is never escaped, so none is cut.
_ESCAPE = r"(?s)\\."


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _with_sum(pieces: DataFrame, value: Column, into: str) -> DataFrame:
    """`value` added up over all pieces before this one, in the order of the file."""
    rows = pieces.withColumn("_v", value.cast("bigint"))
    before, offsets = 0, []
    for part, total in sorted((r.part, r.total) for r in rows.groupBy("part").agg(F.sum("_v").alias("total")).collect()):
        offsets.append((part, before))
        before += total
    starts = F.broadcast(pieces.sparkSession.createDataFrame(offsets, "part int, _start bigint"))
    earlier = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("_v").over(earlier), F.lit(0)) + F.col("_start")
    return rows.join(starts, "part").withColumn(into, running).drop("_v", "_start")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Entries of the JSON object in the file `path` as rows: `key` and the fields of `schema`.

    Values are objects (others give NULL fields); a key that occurs twice counts with its last entry, as
    it does for JSON readers that build a map. An empty file or object gives no rows. The file is cut at
    `spark.sql.files.maxPartitionBytes`; a compressed one is one range. The order of ranges is that of
    their offsets, so `path` names one file. Memory is bounded by a range's share of pieces and by the
    longest entry.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # Spark orders ranges by size, not by offset: the offset says which is first.
    place = F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    pieces = checkpointed(text.select("value", F.col("block"), place.alias("place")))
    blocks = [r.block for r in pieces.select("block").distinct().collect()]  # a row per range
    if not blocks:
        return spark.createDataFrame([], f"{key} string, {schema}")
    ranks = F.broadcast(spark.createDataFrame(list(zip(sorted(blocks), range(len(blocks)))), "block bigint, part int"))
    pieces = pieces.join(ranks, "block").drop("block")

    plain = F.regexp_replace("value", _ESCAPE, "")
    pieces = _with_sum(pieces, _count(plain, '"'), "quotes")
    # With the quote that is open at its start put before it, every second part of a piece is a string.
    opened = F.when(F.col("quotes") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain)
    inside = _count(opened, '"') % 2 == 1  # the closing brace of this piece is text
    bare = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    closes = F.when(inside, 0).otherwise(1)
    pieces = pieces.withColumns({"opens": _count(bare, "{"), "closes": closes})
    pieces = _with_sum(pieces, F.col("opens") - F.col("closes"), "depth")
    # An entry ends where the brace leads back into the outer object; with 0 the object itself ends.
    after = F.col("depth") + F.col("opens") - F.col("closes")
    ends = (F.col("closes") == 1) & (after <= 1)
    pieces = _with_sum(pieces.withColumns({"after": after, "ends": ends}), F.col("ends").cast("int"), "entry")
    whole = pieces.groupBy("entry").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "value"))), lambda p: p["value"]), "}").alias("text"),
        F.min("after").alias("after"),
    ).filter("after = 1")
    # What stands before the key: the brace of the object, or the comma after the last entry.
    cut = F.regexp_replace("text", r"^\x{feff}?[\s,{]*", "")
    value_type = f"struct<{schema}>"
    parsed = F.from_json(F.concat(F.lit("{"), cut, F.lit("}}")), f"map<string,{value_type}>")
    rows = whole.select("entry", F.explode(parsed).alias(key, "_r"))
    last = rows.groupBy(key).agg(F.max_by("_r", "entry").alias("_r"))
    return last.select(key, "_r.*")
