"""Messages, documents and truth rendered from order tables.

The given tables hold no shipping documents, so each order becomes one message: its
shipping instruction states what the tables say, its bill of lading repeats that in other
words, and differences are planted by the order key.  What the check must find therefore
follows from the columns alone, which lets SQL predict it without reading any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyclerk import vocab as V

DISTINCT_LABELS = V.distinct_labels()
HEADER_LINES = 3
OWN_DOMAIN = "ops.example.com"

# What the message of order k is about; the first rule that holds counts.
KIND_SQL = """CASE
 WHEN n_items = 0 OR k % 50 = 11 THEN 'no_docs'
 WHEN k % 50 = 12 THEN 'one_doc'
 WHEN k % 50 = 13 THEN 'unreadable'
 WHEN k % 50 = 14 THEN 'wrong_type'
 WHEN k % 50 = 15 THEN 'absent_file'
 WHEN k % 50 = 16 THEN 'invoice_trap'
 WHEN k % 50 = 17 THEN 'scanned'
 WHEN k % 50 IN (20, 21) THEN 'si_request'
 WHEN k % 50 IN (22, 23) THEN 'invoice'
 WHEN k % 50 IN (24, 25) THEN 'general'
 WHEN k % 50 IN (26, 27) THEN 'spam'
 WHEN k % 50 = 28 THEN 'quiet_general'
 WHEN k % 50 = 29 THEN 'quiet_spam'
 WHEN k % 30 = 13 THEN 'blank_weight'
 WHEN k % 50 = 18 THEN 'silent'
 ELSE 'pair' END"""
DEFECT_SQL = """CASE k % 10
 WHEN 3 THEN 'consignee'
 WHEN 4 THEN 'port_of_loading'
 WHEN 7 THEN 'container_count'
 WHEN 8 THEN 'gross_weight_kg' END"""
BOTH_DOCS = "('unreadable','wrong_type','invoice_trap','scanned','blank_weight','silent','pair','absent_file')"

BODIES = {
    "no_docs": "Good day,\n\nPlease compare the SI and draft BL. The files seem to have been dropped.",
    "one_doc": "Dear all,\nkindly assist to send the   draft BL for checking.",
    "invoice_trap": "Kindly check the enclosed Commercial\tInvoice before noon.",
    "silent": "Good day, see the files enclosed.",
    "si_request": "Hello,\nplease find\tshipping instruction enclosed.",
    "invoice": "Hi, we have a query on   invoice 77, thank you.",
    "general": "Berthing report for today: two vessels alongside.",
    "spam": "Congratulations! Tell us where to send your reward.",
    "quiet_general": "The office stays closed on Monday.",
    "quiet_spam": "Grow your revenue with our partners today.",
}
COMPARE_BODY = "Dear team,\n\nPlease compare   the SI and\tdraft BL attached and report differences."


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with what its documents will state."""
    orders, lineitem, customer, supplier, nation, region = tables(
        spark, sf_dir, "orders", "lineitem", "customer", "supplier", "nation", "region"
    )
    lines = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("n_items"),
        (F.sum("l_quantity") * 100).cast("bigint").alias("kg"),
        F.min("l_suppkey").alias("s_suppkey"),
    )
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    from_place = place.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("pol_nation"), F.col("r_name").alias("pol_region")
    )
    to_place = place.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("pod_nation"), F.col("r_name").alias("pod_region")
    )
    shippers = supplier.join(from_place, "s_nationkey").select("s_suppkey", "s_name", "pol_nation", "pol_region")
    buyers = customer.join(to_place, "c_nationkey").select("c_custkey", "c_name", "pod_nation", "pod_region")
    out = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    out = out.join(lines, "k", "left").join(shippers, "s_suppkey", "left").join(buyers, "c_custkey", "left")
    out = out.withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return out.withColumn("kind", F.expr(KIND_SQL)).withColumn("defect", F.expr(DEFECT_SQL)).drop("c_custkey", "s_suppkey")


def _path(side: str) -> Column:
    return F.concat(F.lit("attachments/msg_"), F.col("k").cast("string"), F.lit(f"_{side}.txt"))


def email_id() -> Column:
    return F.concat(F.lit("msg_"), F.col("k").cast("string"))


def messages(ships: DataFrame) -> DataFrame:
    k, kind = F.col("k"), F.col("kind")
    body = F.lit(COMPARE_BODY)
    for name, text in BODIES.items():
        body = F.when(kind == name, text).otherwise(body)
    ref = F.lpad(k.cast("string"), 7, "0")
    subject = (
        F.when(k % 3 == 0, F.concat(F.lit("Draft BL check CMA(SIJ"), ref, F.lit(")")))
        .when(k % 3 == 1, F.concat(F.lit("Booking OOLU"), ref, F.lit(" update")))
        .otherwise("Paper reminder")
    )
    domain = F.when(k % 2 == 0, OWN_DOMAIN).otherwise("mail.example.net")
    attachments = (
        F.when(F.expr(f"kind IN {BOTH_DOCS}"), F.array(_path("SI"), _path("BL")))
        .when(kind == "one_doc", F.array(_path("SI")))
        .otherwise(F.array().cast("array<string>"))
    )
    return ships.select(
        email_id().alias("email_id"),
        F.concat(F.lit("desk"), (k % 7).cast("string"), F.lit("@"), domain).alias("from"),
        subject.alias("subject"),
        body.alias("body"),
        attachments.alias("attachments"),
    )


def raw_values(side: str) -> dict[str, Column]:
    """What the document of one side states for each field."""
    k, col = F.col("k"), F.col
    port = F.concat_ws(", ", "pol_nation", "pol_region")
    goal = F.concat_ws(", ", "pod_nation", "pod_region")
    if side == "SI":
        word = F.element_at(F.array(*[F.lit(w) for w in V.NUMBER_WORDS]), F.col("n_items").cast("int"))
        spelled = (k % 6 == 0) & col("n_items").between(1, 12)
        tonnes = F.concat(F.expr("kg div 1000").cast("string"), F.lit("."), F.expr("(kg % 1000) div 100").cast("string"), F.lit(" MT"))
        weight = F.when(k % 9 == 0, tonnes).otherwise(F.concat(F.format_number("kg", 0), F.lit(" KG")))
        blank = F.element_at(F.array(*[F.lit(b) for b in ("TBA", "____MT", "???", "N/A")]), (k % 4 + 1).cast("int"))
        return {
            "shipper": F.concat("s_name", F.lit(" PTE. LTD.")),
            "consignee": F.concat("c_name", F.lit(" CO., LTD")),
            "notify_party": col("c_name"),
            "port_of_loading": F.concat(port, F.lit(" (AAAAA)")),
            "port_of_discharge": goal,
            "container_count": F.when(spelled, word).otherwise(F.concat(col("n_items").cast("string"), F.lit(" x 40'HC"))),
            "gross_weight_kg": F.when(col("kind") == "blank_weight", blank).otherwise(weight),
        }
    defect = F.coalesce("defect", F.lit(""))
    count = col("n_items") + F.when(defect == "container_count", 1).otherwise(0)
    kg = col("kg") + F.when(defect == "gross_weight_kg", 500).otherwise(0)
    return {
        "shipper": F.concat("s_name", F.lit(" Pte Ltd")),
        "consignee": F.concat(F.when(defect == "consignee", "OTHER ").otherwise(""), "c_name", F.lit(" Co Ltd")),
        "notify_party": col("c_name"),
        "port_of_loading": F.concat(F.when(defect == "port_of_loading", "PORT ").otherwise(""), port, F.lit(" (AAAAA)")),
        "port_of_discharge": F.lower(goal),
        "container_count": F.concat(count.cast("string"), F.lit(" x 40'HC")),
        "gross_weight_kg": F.concat(kg.cast("string"), F.lit(".00 kgs")),
    }


def label_index(side: str, field: str) -> Column:
    n = len(DISTINCT_LABELS[field])
    return F.col("k") % n if side == "SI" else (7 * F.col("k") + 1) % n


def _label(side: str, field: str) -> Column:
    labels = DISTINCT_LABELS[field]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (label_index(side, field) + 1).cast("int"))


def document_body(side: str) -> Column:
    """Layout by k % 4: 'Label: value', wide columns, tight, or value on the next line."""
    layout = F.col("k") % 4
    values = raw_values(side)
    title = F.lit("SHIPPING INSTRUCTION" if side == "SI" else "BILL OF LADING (DRAFT)")
    parts = [title, F.lit("=" * 40), F.lit("")]
    separator = F.when(layout == 0, ": ").when(layout == 1, "").when(layout == 2, " ").otherwise("\n     ")
    wide_colon = F.when(F.col("k") % 40 == 4, "：").otherwise(separator)  # full-width colon
    bilingual = F.col("k") % 8 == 0  # label with characters other than ASCII
    for field in V.FIELDS:
        label = _label(side, field)
        if field == "gross_weight_kg":
            label = F.when(bilingual, "Gross Weight毛重(KGS)").otherwise(label)
        label = F.when(layout == 1, F.rpad(label, 40, " ")).otherwise(label)
        parts.append(F.concat(label, wide_colon if field == "shipper" else separator, values[field]))
        if field in V.PARTY_FIELDS:
            parts.append(F.lit("     12 HARBOUR ROAD"))
    return F.concat_ws("\n", *parts)


def document_text(ships: DataFrame) -> DataFrame:
    """(path, text, method, readable, warnings) of every stored attachment."""
    from tallyclerk.functions.text import is_readable

    kind = F.col("kind")
    # Keys of a few bytes become pages of text: spread them before, not after.
    spark = ships.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ships = ships.repartition(width, "k")
    si = F.struct(_path("SI").alias("path"), document_body("SI").alias("text"))
    bl_text = (
        F.when(kind == "unreadable", "~ ~~ #")
        .when(kind == "wrong_type", F.concat(F.lit("PACKING LIST\n"), document_body("BL")))
        .otherwise(document_body("BL"))
    )
    bl = F.struct(_path("BL").alias("path"), bl_text.alias("text"))
    stored = (
        F.when(kind.isin("one_doc", "absent_file"), F.array(si))
        .when(F.expr(f"kind IN {BOTH_DOCS}"), F.array(si, bl))
    )
    rows = ships.select("kind", F.explode(stored).alias("d")).select("kind", "d.path", "d.text")
    return rows.select(
        "path",
        "text",
        F.when(kind == "scanned", "ocr").otherwise("text").alias("method"),
        is_readable("text").alias("readable"),
        F.array().cast("array<string>").alias("warnings"),
    )


def truth(ships: DataFrame) -> DataFrame:
    """What a careful reader would report."""
    kind = F.col("kind")
    category = (
        F.when(kind == "si_request", "SI_REQUEST")
        .when(kind == "invoice", "INVOICE_QUERY")
        .when(kind.isin("general", "quiet_general"), "GENERAL")
        .when(kind.isin("spam", "quiet_spam"), "SPAM")
        .otherwise(V.COMPARISON_CATEGORY)
    )
    reason = (
        F.when(kind == "no_docs", "missing_attachment")
        .when(kind.isin("unreadable", "absent_file", "scanned"), "unreadable")
        .when(kind.isin("wrong_type", "invoice_trap"), "wrong_doc_type")
        .when(kind == "blank_weight", "missing_value")
    )
    defective = kind.isin("pair", "silent") & F.col("defect").isNotNull()
    none = F.array().cast("array<string>")
    return ships.select(
        email_id().alias("email_id"),
        category.alias("category"),
        F.when(reason.isNotNull(), "NEEDS_REVIEW").when(defective, "MISMATCH").otherwise("OK").alias("status"),
        reason.alias("review_reason"),
        defective.alias("has_defect"),
        F.when(defective, F.array("defect")).otherwise(none).alias("defect_fields"),
    )
