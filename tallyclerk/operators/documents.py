"""Attachment bytes to text, text to extracted documents, and edits to extractions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.normalize import is_blank, normalize
from tallyclerk.functions.text import decode_bytes, extension, is_empty, is_readable
from tallyclerk.operators.extract import FIELD_STRUCT, computed_once, doc_type, extract_fields, parts_struct

Reader = Callable[[bytes], tuple[str, bool, list[str]]]
BINARY_METHODS = {".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx"}


def ingest(
    attachments: DataFrame,
    readers: dict[str, Reader] | None = None,
    path: str = "path",
    content: str = "content",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(path, content) to (path, text, method, readable, warnings) and the columns `keep`.

    Text attachments are decoded in the JVM.  `readers` maps an extension to a function
    bytes -> (text, readable, warnings) for binary formats; it runs in Arrow batches and
    sees only files of its extension.  Without a reader such a file is unreadable, with a
    warning, and is escalated later rather than failing the job.
    """
    ext, body = extension(path), F.col(content)
    method = F.lit("text")
    for suffix, name in BINARY_METHODS.items():
        method = F.when(ext == suffix, name).otherwise(method)
    base = attachments.withColumn("_ext", ext).withColumn("method", method)
    warning = (
        F.when(body.isNull(), V.WARN_NOT_FOUND)
        .when(F.length(body) == 0, V.WARN_EMPTY)
        .when(
            (F.col("method") != "text") & ~F.col("_ext").isin(*(readers or {".": None})),
            F.concat(*_template(V.WARN_NO_READER, method=F.col("method"))),
        )
    )
    text = F.when(warning.isNotNull(), "").when(F.col("method") == "text", decode_bytes(body))
    missing = body.isNull() | (F.length(body) == 0)
    out = base.select(
        F.col(path).alias("path"),
        *keep,
        text.alias("text"),
        F.when(missing, "text").otherwise(F.col("method")).alias("method"),
        F.array_compact(F.array(warning)).alias("warnings"),
        *([F.when(warning.isNull() & (F.col("method") != "text"), body).alias("_content"), "_ext"] if readers else []),
    )
    if readers:
        out = out.withColumn("_read", _read_udf(readers)(F.col("_ext"), F.col("_content")))
        read = F.col("_read")
        out = out.select(
            "path",
            *keep,
            F.coalesce(read["text"], F.col("text")).alias("text"),
            "method",
            F.concat(F.col("warnings"), F.coalesce(read["warnings"], F.array().cast("array<string>"))).alias("warnings"),
            read["readable"].alias("_readable"),
        )
        return out.withColumn(
            "readable", F.coalesce(F.col("_readable"), is_readable("text"))
        ).drop("_readable")
    return out.withColumn("readable", is_readable("text"))


def _template(template: str, **values: Column) -> list[Column]:
    """Pieces of 'text {name} text' for F.concat."""
    import string

    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(F.lit(literal))
        if name:
            out.append(values[name])
    return out


def _read_udf(readers: dict[str, Reader]):
    @F.pandas_udf("text string, readable boolean, warnings array<string>")
    def read(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for e, raw in zip(ext, content):
            if raw is None or e not in readers:
                rows.append((None, None, None))
                continue
            try:
                rows.append(readers[e](bytes(raw)))
            except Exception as err:  # an unreadable file is escalated, not fatal
                rows.append(("", False, [f"{e[1:]} read failed: {err}"]))
        return pd.DataFrame(rows, columns=["text", "readable", "warnings"])

    return read


def extract_documents(
    document_text: DataFrame,
    labels: dict[str, list[str]] | None = None,
    exact_unicode: bool = True,
    recovered: bool = False,
    normalizers: dict | None = None,
    keep: tuple[str, ...] = (),
    readings: tuple[str, ...] | None = None,
) -> DataFrame:
    """(path, text, method, readable, warnings) to one extracted document per row, with the columns `keep`.

    Every field says which `file` it was looked for in.  With `readings`, a field has its value, its
    confidence and only these of its other parts (names as in FIELD_STRUCT, or `file`).

    With `recovered`, the input also carries `guesses`: array of (field, raw, confidence)
    from a model, used only for fields the rules left empty.  The text itself is not kept,
    so everything after this step moves a few hundred bytes per document.
    """
    parts = None if readings is None or recovered else ("value", "confidence", *readings)
    readable = F.col("readable") & ~is_empty(F.coalesce("text", F.lit("")))
    docs = document_text.withColumn("readable", readable)
    docs = extract_fields(docs, "text", F.col("readable"), labels, exact_unicode, normalizers=normalizers, parts=parts)
    kind = F.when(F.col("readable"), doc_type("text")).otherwise("UNKNOWN")
    docs = docs.withColumn("doc_type", kind).drop("text")
    if recovered:
        docs = docs.withColumn("fields", fill_missing(F.col("fields"), F.col("guesses"))).drop("guesses")
    docs = docs.withColumn("fields", cap_recognised(F.col("fields"), F.col("method"), parts))
    # Field by field, so that it is compiled; a lambda over the array would not be.
    each = [F.get("fields", F.lit(i)) for i in range(len(V.FIELDS))]
    if parts is None or "file" in parts:
        filed = F.array(*[f.withField("file", F.col("path")) for f in each])
        filed = F.when(F.size("fields") > 0, filed).otherwise(F.array().cast(f"array<{parts_struct(parts)[:-1]},file:string>>"))
        # A filter on the fields, such as an explode brings along, would take a copy of all this with it.
        docs = docs.withColumn("fields", computed_once(filed))
    absent = F.concat_ws(", ", *[F.when(f["value"].isNull(), F.lit(name)) for f, name in zip(each, V.FIELDS)])
    warning = F.when(F.col("readable") & (absent != ""), F.concat(F.lit(V.WARN_MISSING_FIELDS), absent))
    warned = F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(warning)))
    return docs.select(
        "path",
        "doc_type",
        F.col("method").alias("ingest_method"),
        "readable",
        "fields",
        warned.alias("warnings"),
        *keep,
    )


def cap_recognised(fields: Column, method: Column, parts: tuple[str, ...] | None = None) -> Column:
    """Values read by character recognition may be shown but never trusted; `parts` is what the fields have."""

    def cap(f):
        read = f["value"].isNotNull()
        f = f.withField("confidence", F.when(read, F.least(f["confidence"], F.lit(V.OCR_CAP))).otherwise(f["confidence"]))
        if parts is None or "method" in parts:
            f = f.withField("method", F.when(read, F.lit("ocr")).otherwise(f["method"]))
        return f

    return F.when(method == "ocr", F.transform(fields, cap)).otherwise(fields)


def missing_fields(fields: Column) -> Column:
    """Names of fields without a usable value, in field order."""
    return F.transform(F.filter(fields, lambda f: f["value"].isNull()), lambda f: f["field"])


def fill_missing(fields: Column, guesses: Column) -> Column:
    """Model values for fields the rules left empty, normalised and capped.

    `guesses` is array<struct<field, raw, confidence>>; unknown fields, placeholders and
    values that cannot be normalised are ignored.
    """
    usable = F.filter(
        F.transform(
            guesses,
            lambda g: F.struct(
                g["field"].alias("field"),
                F.when(is_blank(g["raw"]), F.lit(None)).otherwise(normalize(g["field"], g["raw"])).alias("value"),
                g["raw"].alias("raw"),
                F.least(g["confidence"].cast("double"), F.lit(V.MODEL_CAP)).alias("confidence"),
                F.lit("llm").alias("method"),
                F.lit(-1).alias("line"),
                F.lit(V.MODEL_LABEL).alias("label_seen"),
                F.lit(V.MODEL_SNIPPET).alias("snippet"),
            ),
        ),
        lambda g: g["value"].isNotNull(),
    )

    def pick(f):
        guess = F.get(F.filter(usable, lambda g: g["field"] == f["field"]), F.lit(0))
        take = f["value"].isNull() & guess.isNotNull()
        return F.when(take, guess.cast(FIELD_STRUCT)).otherwise(f)

    return F.when(guesses.isNull(), fields).otherwise(F.transform(fields, pick))


def ask_missing(documents: DataFrame, model: Callable[[str, list[str]], dict], text: str = "text", fields: str = "fields") -> DataFrame:
    """Add `guesses`: what a model reads for the fields the rules left empty.

    `model` is called on the executors, in Arrow batches, with a document's text and the
    names of its missing fields, and returns {field: (value, confidence)}.  Documents with
    nothing missing are not shown to it; a call that fails guesses nothing.
    """

    @F.pandas_udf("array<struct<field:string,raw:string,confidence:double>>")
    def ask(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, names in zip(texts, wanted):
            if t is None or names is None or not len(names):
                out.append(None)
                continue
            try:
                said = model(t, list(names))
            except Exception:  # the rules' answer stands
                out.append(None)
                continue
            out.append([{"field": f, "raw": None if v is None else str(v), "confidence": float(c)} for f, (v, c) in said.items() if f in names])
        return pd.Series(out, dtype=object)

    absent = missing_fields(F.col(fields))
    open_case = F.size(absent) > 0
    return documents.withColumn("guesses", ask(F.when(open_case, F.col(text)), F.when(open_case, absent)))


def field_rows(extracted: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per (document, field)."""
    rows = extracted.select(*(keep or ("path",)), F.explode("fields").alias("_f"))
    return rows.select(*(keep or ("path",)), "_f.*")


def learned_labels(reviews: DataFrame) -> dict[str, list[str]]:
    """Label lists extended by labels reviewers confirmed: (field, label_seen) rows.

    Only the distinct pairs leave the cluster: the vocabulary, however many reviews there are.
    """
    pairs = (
        reviews.filter(F.col("field").isin(*V.FIELDS) & (F.col("label_seen") != ""))
        .select("field", "label_seen")
        .distinct()
        .collect()
    )
    extra: dict[str, list[str]] = {}
    for p in sorted(pairs):
        extra.setdefault(p["field"], []).append(p["label_seen"])
    return V.distinct_labels(extra)


def label_table(spark, learned: DataFrame | None = None) -> DataFrame:
    """(field, label, origin) of built-in labels joined by learned ones not yet known."""
    rows = [(f, label) for f in V.FIELDS for label in V.LABELS[f]]
    builtin = spark.createDataFrame(rows, "field string, label string")
    if learned is None:
        return builtin.withColumn("origin", F.lit("builtin"))
    both = builtin.withColumn("rank", F.lit(0)).unionByName(
        learned.select("field", F.col("label_seen").alias("label"))
        .filter(F.col("label") != "")
        .withColumn("rank", F.lit(1))
    )
    return both.groupBy("field", "label").agg(
        F.when(F.min("rank") == 0, "builtin").otherwise("learned").alias("origin")
    )
