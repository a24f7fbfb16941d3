"""Extraction with a vocabulary of labels that stays a table.

Labels that reviewers confirmed can be as many as there are reviews, so they are never read into
a plan. Lines meet them by hash: the openings of a line, one for each length that a label has,
are joined with the labels, and so a document gets the few labels it can use. Whether a captured
text is part of a longer label is asked of the table in the same way. From there on documents
are read and contested as with the built-in labels, and the outcome is the same.

Every join here is a merge join: sizes estimated through explodes and aggregates are far too
small, and a vocabulary taken for a small table would be gathered on the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.text import fold_ascii, strip
from tallyclerk.operators import extract as X
from tallyclerk.operators.numbering import checkpointed, numbered

ENTRY = "struct<f:int,l:bigint,label:string,upper:string>"


def label_entries(learned: DataFrame) -> DataFrame:
    """(f, l, label, upper): built-in labels, then those of `learned` (field, label_seen) in alphabetical order.

    A smaller l wins; of spellings that differ in case only the first one of a field is kept.
    """
    builtin = [(f, i, x, x.upper()) for f, field in enumerate(V.FIELDS) for i, x in enumerate(V.distinct_labels()[field])]
    spark = learned.sparkSession
    first = spark.createDataFrame(builtin, "f int, l bigint, label string, upper string")
    number = F.array_position(F.array(*map(F.lit, V.FIELDS)), F.col("field")) - 1
    said = learned.filter(F.col("field").isin(*V.FIELDS) & (F.col("label_seen") != ""))
    said = said.groupBy(number.cast("int").alias("f"), F.upper("label_seen").alias("upper")).agg(F.min("label_seen").alias("label"))
    new = said.join(F.broadcast(first.select("f", "upper")), ["f", "upper"], "left_anti")
    later = numbered(new, "f", "label", into="l").withColumn("l", F.col("l") + len(builtin))
    return first.unionByName(later.select("f", "l", "label", "upper"))


def _openings(text: Column, widths: list[int]) -> Column:
    """The beginnings of a text that have the length of some label."""
    all_ = F.transform(F.array(*map(F.lit, widths)), lambda w: F.when(F.length(text) >= w, F.substring(text, F.lit(1), w)))
    return F.array_compact(all_)


def extract_fields_learned(
    docs: DataFrame, learned: DataFrame, key: str, text: str = "text", readable: Column | None = None, exact_unicode: bool = True, into: str = "fields"
) -> DataFrame:
    """As `extract_fields` with the labels of `learned` (field, label_seen) added; `key` is unique in docs."""
    entries = checkpointed(label_entries(learned))
    # As many numbers as labels have lengths.
    widths = sorted(r.w for r in entries.select(F.length("upper").alias("w")).distinct().collect())
    body = F.coalesce(F.col(text), F.lit(""))
    usable = strip(body) != ""
    if readable is not None:
        usable = readable & usable
    space = F.lit(V.ASCII_SPACE)
    step = docs.withColumn("_source", F.when(usable, body))
    step = step.withColumn("_raw", F.split("_source", "\n")).withColumn("_folded", F.split(fold_ascii("_source", exact_unicode), "\n")).drop("_source")
    total = lambda u: F.length(F.regexp_extract(u, rf"^TOTAL{X.S}+", 0))

    # Which labels a document can use.
    lines = step.select(F.col(key).alias("_key"), F.explode("_folded").alias("t")).select("_key", F.upper(F.btrim("t", space)).alias("u"))
    lines = lines.filter(F.length("u") >= widths[0]).withColumn("after", F.substring(F.col("u"), total(F.col("u")) + 1, F.length("u")))
    openings = F.array_distinct(F.concat(_openings(F.col("u"), widths), _openings(F.col("after"), widths)))
    met = lines.select("_key", F.explode(openings).alias("upper")).distinct().join(entries.hint("merge"), "upper")
    known = met.groupBy("_key").agg(F.collect_list(F.struct("f", "l", "label", "upper")).alias("_known"))
    step = step.join(known.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
    none = F.array().cast(f"array<{ENTRY}>")
    step = step.withColumn("_known", F.coalesce("_known", none))

    hits = F.transform("_folded", lambda t, i: F.struct(i.alias("i"), F.btrim(t, space).alias("text"), F.upper(F.btrim(t, space)).alias("upper")))
    hits = F.transform(hits, lambda h: h.withField("total", total(h["upper"])))
    met_by = F.filter(hits, lambda h: F.exists("_known", lambda x: F.startswith(h["upper"], x["upper"]) | F.startswith(F.substring(h["upper"], h["total"] + 1, F.length(h["upper"])), x["upper"])))
    step = step.withColumn("_hits", F.when(F.size("_known") > 0, met_by))

    # Whether what follows a label is part of a longer one: K = label, blank, captured text begins
    # a longer label, or a longer label begins K. One such label of either kind is enough.
    bare = F.transform("_known", lambda x: x.withField("tails", F.lit(None).cast("array<string>")))
    step = step.withColumn("_bare", bare)
    read = X._read(F.col("_hits"), lambda h: F.col("_bare"))
    got = F.flatten(F.transform(read, lambda r: F.transform(
        F.array(*[r[f"got_{form}"] for form in (X.COLON, X.WIDE, X.TIGHT)]), lambda g: F.struct(r["n"]["label"].alias("label"), F.upper(g).alias("g")))))
    captured = step.filter(F.size("_hits") > 0).select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.filter(got, lambda s: s["g"] != ""))).alias("s")).select("_key", "s.label", "s.g")
    captured = captured.withColumn("k", F.concat(F.upper("label"), F.lit(" "), F.col("g")))
    uppers = entries.select("upper").distinct()
    stems = uppers.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("upper")), lambda n: F.substring("upper", F.lit(1), n))).alias("k"), F.col("upper").alias("longer"))
    stems = stems.groupBy("k").agg(F.min("longer").alias("longer"))
    extends = captured.join(stems.hint("merge"), "k").select("_key", "label", "longer")
    begun = captured.select("_key", "label", F.explode(_openings(F.col("k"), widths)).alias("longer")).filter(F.length("longer") > F.length("label") + 1).join(uppers.withColumnRenamed("upper", "longer").hint("merge"), "longer")
    tails = extends.unionByName(begun.select("_key", "label", "longer")).select("_key", "label", F.substring(F.col("longer"), F.length("label") + 2, F.length("longer")).alias("tail"))
    tails = tails.groupBy("_key", "label").agg(F.collect_set("tail").alias("tails")).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("label", "tails"))).alias("_tails"))
    step = step.join(tails.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
    no_tail = F.array(F.lit(X.NO_TAIL))
    whole = F.transform("_known", lambda x: x.withField("tails", F.coalesce(F.try_element_at("_tails", x["label"]), no_tail)))
    step = step.withColumn("_entries", whole)

    found = X._forms(F.col("_raw"), F.col("_folded"), X._read(F.coalesce("_hits", F.filter(hits, lambda h: F.lit(False))), lambda h: F.col("_entries")))
    step = step.withColumn("_found", F.when(F.col("_raw").isNotNull(), found))
    step = step.withColumn("_valid", X._contest(F.col("_found")))
    return step.withColumn(into, X._settled()).drop("_raw", "_folded", "_hits", "_bare", "_known", "_tails", "_entries", "_found", "_valid")
