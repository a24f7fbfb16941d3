"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words. A benchmark item yields windows of `window`
consecutive words; an item of fewer words, but not none, is one window. Of the hashes of all
k-grams within a window, only the smallest is kept as a fingerprint, so two texts that share a
whole window share a fingerprint (k = (n + 1) // 2 words in windows of n). A word is hashed once; the
hashes of k-grams and the least of a window are built by steps that double their reach. Document fingerprints
are joined with the item fingerprints, and each hit is extended to all windows around it, which are
compared word for word; only texts with a hit are read again for that. Everything is DataFrame functions;
no Python runs on the executors.

Only the benchmark's fingerprints and windows are broadcast, and only after their number has been
checked; beyond the bound both joins shuffle and give the same rows. Documents stay where they are
scanned: fingerprints without a partner never leave their task.

Odd input: a null or word-less text has no words and is clean; a null or word-less item has no
windows; repeated rows each get their verdict; rows are told apart by doc_id and text, so documents
that share a doc_id are judged each on its own text. Columns other than doc_id, text, item_id are not
looked at. Without items every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Up to this many fingerprints or windows of the benchmark (under 100 MB) are broadcast.
BROADCAST_ROWS = 300_000
#: Low bits of a fingerprint that hold its position; no text has as many words. The hash has the others.
PLACE_BITS = 30
_PLACE = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # Letters beyond A-Z stay as they are; where there are none the faster function does the same.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(lower, NOT_WORD), "")


def _over(table: DataFrame, keys: tuple[str, ...], width: int, combine) -> DataFrame:
    """Column x with each element combined with the width - 1 after it; the last width - 1 mean nothing.

    The reach doubles with each step, and the last one overlaps.
    """
    have = 1
    while have < width:
        step = min(have, width - have)
        table = table.select(*keys, F.transform("x", lambda v, i: combine(v, F.get(F.col("x"), i + step))).alias("x"))  # noqa: B023
        have += step
    return table


def fingerprints(texts: DataFrame, n: int, *keys: str) -> DataFrame:
    """(keys, kept): of the k-grams in each window of n words of `words` the one with the smallest hash,
    once, as hash (upper bits) and position from 1 (lower bits)."""
    k = (n + 1) // 2
    hashed = texts.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("x"))
    grams = _over(hashed, keys, k, F.xxhash64)
    placed = F.transform("x", lambda v, i: v.bitwiseAND(F.lit(~_PLACE)).bitwiseOR((i + 1).cast("bigint")))
    none = F.array().cast("array<bigint>")
    whole = lambda x, width: F.when(F.size(x) >= width, F.slice(x, 1, F.size(x) - (width - 1))).otherwise(none)
    least = _over(grams.select(*keys, whole(F.col("x"), k).alias("x")).select(*keys, placed.alias("x")), keys, n - k + 1, F.least)
    # A condition that a caller has, or Spark infers, must not be pushed down: it would repeat every step in each.
    barrier = F.monotonically_increasing_id() >= 0
    return least.select(*keys, F.when(barrier, F.array_distinct(whole(F.col("x"), n - k + 1))).alias("kept"))


def _hash_part(x: str) -> Column:
    return F.shiftright(x, PLACE_BITS)


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(item_id, words, n) of items with words, and (item_id, n, window): their distinct windows."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("n", F.least(F.size("words"), F.lit(window)))
    pieces = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))
    return words, words.select("item_id", "n", F.explode(pieces).alias("window")).distinct()


def hits(documents: DataFrame, item_words: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, n_words, p): a row with p = 0 for every row of `documents`, and one for every
    position p of a k-gram whose hash is a fingerprint of an item with windows of n words."""
    wanted = fingerprints(item_words.filter(F.col("n") == n), n).select(F.explode("kept").alias("x")).select(_hash_part("x").alias("f"), F.lit(True).alias("there")).distinct()
    keys = ("doc_id", "text_key", "n_words")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    texts = texts.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"), "words")
    kept = fingerprints(texts, n, *keys).select(*keys, F.explode(F.array_append("kept", F.lit(0).cast("bigint"))).alias("x"))
    kept = kept.select(*keys, _hash_part("x").alias("f"), F.col("x").bitwiseAND(F.lit(_PLACE)).alias("p"))
    met = kept.join(broadcast_if_small(wanted, BROADCAST_ROWS), "f", "left")
    return met.filter((F.col("p") == 0) | F.col("there")).select(*keys, "p")


def extended(documents: DataFrame, places: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, at, window, n): windows of documents around the places of hits that equal an
    item's, compared as a whole. Only texts with a hit are cut into words again."""
    k = (n + 1) // 2
    few = places.select("doc_id", "text_key", "p").distinct()
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    of = few.groupBy("doc_id", "text_key").agg(F.collect_set("p").alias("places")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "places")
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = texts.join(F.broadcast(of) if small else of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    texts = texts.select("doc_id", "text_key", "places", words_of(F.col("text")).alias("words")).filter(F.size("words") >= n)
    around = lambda p: F.sequence(F.greatest(F.lit(1), p.cast("int") - (n - k)), F.least(p.cast("int"), F.size("words") - (n - 1)))
    starts = F.explode(F.array_distinct(F.flatten(F.transform("places", around))))
    cut = texts.select("doc_id", "text_key", "words", starts.alias("at")).select("doc_id", "text_key", "at", F.array_join(F.slice("words", F.col("at"), n), " ").alias("window"))
    return cut.join(broadcast_if_small(windows.filter(F.col("n") == n).select("window", "n").distinct(), BROADCAST_ROWS), "window")


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """`judged` without the hash of the text."""
    return judged(documents, items, window, share).drop("text_key")


def judged(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """`documents` (doc_id, text) with text_key (a hash of the text), words, hit words, items that occur, and the verdict.

    Contaminated: some word is hit, and share * hit words >= words.
    """
    item_words, windows = item_windows(items, window)
    # At most `window` lengths: items of at least `window` words share one.
    lengths = sorted(r.n for r in item_words.select("n").distinct().collect())
    if not lengths:
        return documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")).select(
            "doc_id", "text_key", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    # One pass over the texts for each length; what leaves it are the documents' keys and the hits.
    met = [checkpointed(hits(documents, item_words, n)) for n in lengths]
    counted = met[0].filter("p = 0").drop("p")
    found = None
    for n, rows in zip(lengths, met, strict=True):
        equal = extended(documents, rows.filter("p > 0"), windows, n)
        found = equal if found is None else found.unionByName(equal)
    found = checkpointed(found.distinct())
    place = ["doc_id", "text_key"]
    # Union of the windows by a sweep: what each adds beyond the furthest end before it.
    sweep = Window.partitionBy(*place).orderBy("at", "n", "window")
    end = F.col("at") + F.col("n")
    before = F.coalesce(F.max(end).over(sweep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = F.greatest(F.lit(0), end - F.greatest(F.col("at"), before))
    swept = found.withColumn("added", added)
    hit = swept.groupBy(*place).agg(F.sum("added").cast("bigint").alias("n_hit"))
    which = found.select(*place, "window").distinct().join(broadcast_if_small(windows.select("window", "item_id"), BROADCAST_ROWS), "window")
    named = which.groupBy(*place).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = hit.join(named, (hit["doc_id"].eqNullSafe(named["doc_id"])) & (hit["text_key"] == named["text_key"])).select(
        hit["doc_id"].alias("d"), hit["text_key"].alias("t"), "n_hit", "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return counted.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
