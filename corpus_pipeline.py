"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of `documents`, with text and n_chars as the stage left them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk.llm import decontaminate, langid, packing, queries, simhash, suffix_dedup
from tallyclerk.llm.common import checkpointed, table

COLUMNS = "doc_id text lang source n_chars".split()
#: A prediction below this calibrated probability is no better than a guess between two languages.
LEAST_SCORE = 0.35
_NO_ID = -(1 << 63)


#: What makes rows one document: the doc_id, which may be null, and the hash of the text.
_KEY = ["_id", "_text"]


def _keyed(rows: DataFrame, text_key: Column) -> DataFrame:
    return rows.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)), "_text": text_key})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others have no letter or no likely language."""
    said = langid.identify(docs.select(*COLUMNS), langid.fit_documents(docs))
    return said.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, one without doc_id
    only if there is no other; rows equal in doc_id and text once."""
    found = simhash.components(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("d")).select("d.doc_id", "d.text_key")
    first = _keyed(first, F.col("text_key")).select(*_KEY)
    return _keyed(docs.select(*COLUMNS), F.xxhash64("text")).join(first, _KEY, "left_semi").dropDuplicates(_KEY).select(*COLUMNS)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur earlier; documents of which nothing is left go."""
    done = suffix_dedup.dedup(docs.select("doc_id", "text", "lang", "source"))
    left = done.filter((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return left.select("doc_id", changed.alias("text"), "lang", "source", F.length(changed).cast("bigint").alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    bad = _keyed(judged.filter("contaminated"), F.col("text_key")).select(*_KEY).distinct()
    return _keyed(docs.select(*COLUMNS), F.xxhash64("text")).join(bad, _KEY, "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed training sequences."""
    return packing.pack(docs, f"{queries.TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_spans),
    ("benchmark decontamination", benchmark_free),
    ("packing", sequences),
]
#: SQL has no XXH64 shingle votes, trained models, byte-wise cuts or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written down before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
