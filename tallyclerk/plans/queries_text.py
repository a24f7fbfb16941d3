"""Queries over the given text and event tables: text, normalisation, prediction, store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions import normalize as N
from tallyclerk.functions import text as T
from tallyclerk.operators import classify as C
from tallyclerk.operators import documents as D
from tallyclerk.operators import evaluate as E
from tallyclerk.operators import predict as P
from tallyclerk.operators import reconcile as RC
from tallyclerk.operators import report as R
from tallyclerk.operators import reviews as W
from tallyclerk.operators import snapshots as SN
from tallyclerk.operators.extract import extract_fields
from tallyclerk.operators.learned import extract_fields_learned
from tallyclerk.plans.registry import query
from tallyclerk.sources.store import current, latest


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- text -------------------------------------------------------------------------
CANON = r"upper(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'ss'))"


@query("canon_text", f"SELECT conv_id, turn, {CANON} AS canonical FROM conversations")
def canon_text(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.canonical("text").alias("canonical"))


@query("ascii_fold", r"SELECT doc_id, trim(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), chr(10) || ' ') AS folded FROM documents")
def ascii_fold(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.strip_non_ascii("text").alias("folded"))


@query(
    "doc_lines",
    "SELECT doc_id, CAST(i AS INTEGER) AS line, rtrim(string_split(text, chr(10))[i]) AS line_text"
    " FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)",
)
def doc_lines(spark, sf):
    return R.document_lines(read(spark, sf, "documents"), "doc_id")


@query("readability", "SELECT doc_id, length(trim(text, chr(10) || ' ')) > 40 AS readable FROM documents")
def readability(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.is_readable("text").alias("readable"))


URL_PATH = r"regexp_replace(url, '[?#].*$', '')"


@query(
    "format_dispatch",
    rf"""SELECT page_id, e AS extension, CASE e WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.xlsx' THEN 'xlsx'
    ELSE 'text' END AS method FROM (SELECT page_id, lower(regexp_extract({URL_PATH}, '[^/](\.[^./]+)/*$', 1)) AS e FROM pages)""",
)
def format_dispatch(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    rows = read(spark, sf, "pages").select("page_id", T.extension(path).alias("extension"))
    method = F.lit("text")
    for ext, name in D.BINARY_METHODS.items():
        method = F.when(F.col("extension") == ext, name).otherwise(method)
    return rows.withColumn("method", method)


@query(
    "format_counts",
    rf"SELECT lower(regexp_extract({URL_PATH}, '[^/](\.[^./]+)/*$', 1)) AS extension, count(*) AS n FROM pages GROUP BY 1",
)
def format_counts(spark, sf):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return E.count_by(read(spark, sf, "pages"), T.extension(path), "extension")


@query(
    "fingerprint",
    "SELECT lang, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS fingerprint FROM documents GROUP BY lang",
)
def fingerprint(spark, sf):
    part = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("bigint")
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.bit_xor(part).alias("fingerprint"))


@query("non_ascii_docs", r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]')")
def non_ascii_docs(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.filter(F.octet_length("text") != F.length("text")).select("doc_id", "lang")


POOR = r"""CASE WHEN length(t) < 40 THEN true
 WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: regexp_matches(w, '[\pL\pN]'))) < 10 THEN true
 ELSE length(regexp_replace(t, '[^\pL\pN]', '', 'g')) / length(t) < 0.60 END"""


@query("text_quality", f"SELECT doc_id, {POOR} AS poor FROM (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents)")
def text_quality(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.is_poor("text").alias("poor"))


@query(
    "join_pages",
    "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), chr(10) || chr(10)) AS joined FROM documents",
)
def join_pages(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", T.join_pages(F.split("text", "\n")).alias("joined"))


PROMPT_SQL = r"""'FROM: ' || role || chr(10) || 'SUBJECT: ' || left('Conversation ' || conv_id, 200) || chr(10) || 'BODY:' || chr(10)
 || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1200) || chr(10)"""


def talk(spark, sf):
    """Conversation turns as messages."""
    return read(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("email_id"),
        F.col("role").alias("from"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("subject"),
        F.col("text").alias("body"),
    )


@query("prompt_render", f"SELECT conv_id, turn, {PROMPT_SQL} AS prompt, left(sha256({PROMPT_SQL}), 20) AS prompt_key FROM conversations")
def prompt_render(spark, sf):
    return P.with_prompt(talk(spark, sf)).select("conv_id", "turn", "prompt", "prompt_key")


RULE_CASE = "CASE " + " ".join(
    f"WHEN contains(b, '{p}') THEN '{c}:{p}'" for c, ps, _ in V.PHRASE_RULES for p in ps
) + " END"


@query("rules_as_table", f"SELECT page_id, {RULE_CASE} AS rule FROM (SELECT page_id, upper(replace(trim(regexp_replace(html, '\\s+', ' ', 'g')), 'ß', 'ss')) AS b FROM pages)")
def rules_as_table(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", T.canonical("html").alias("canonical_body"))
    hit = C.match_rules_table(pages, C.rules_table(spark))
    return hit.select("page_id", F.concat_ws(":", "rule.category", "rule.evidence").alias("rule")).withColumn(
        "rule", F.nullif("rule", F.lit(""))
    )


@query(
    "rules_long_list",
    f"""WITH b AS (SELECT conv_id, turn, {CANON.replace("text", "coalesce(text, '')")} AS body FROM conversations),
    r AS (SELECT CAST((conv_id * 7919 + turn * 31 + o) % 1000003 AS INT) AS priority, substr(body, o, 20) AS phrase FROM b, (SELECT unnest([1, 21, 41, 61, 81]) AS o) WHERE length(body) >= o
      UNION ALL SELECT 2000000, 'Q'),
    m AS (SELECT conv_id, turn, arg_min(phrase, (priority, phrase)) AS phrase FROM b JOIN r ON contains(body, phrase) GROUP BY conv_id, turn)
    SELECT conv_id, turn, coalesce(phrase, '') AS phrase FROM b LEFT JOIN m USING (conv_id, turn)""",
)
def rules_long_list(spark, sf):
    """Five phrases of every text as rules, and one of a single letter, met in every text."""
    texts = read(spark, sf, "conversations").select("conv_id", "turn", T.canonical(F.coalesce("text", F.lit(""))).alias("canonical_body"))
    places = texts.withColumn("o", F.explode(F.array(*map(F.lit, (1, 21, 41, 61, 81))))).filter(F.length("canonical_body") >= F.col("o"))
    rule = lambda priority, phrase: (priority.cast("int").alias("priority"), F.lit("SPAM").alias("category"), phrase.alias("phrase"), F.lit(0.9).alias("confidence"))
    rules = places.select(*rule((F.col("conv_id") * 7919 + F.col("turn") * 31 + F.col("o")) % 1000003, F.substring("canonical_body", F.col("o"), F.lit(20))))
    rules = rules.unionByName(spark.range(1).select(*rule(F.lit(2000000), F.lit("Q"))))
    return C.match_rules_table(texts, rules).select("conv_id", "turn", F.coalesce("rule.evidence", F.lit("")).alias("phrase"))


@query(
    "sender_domain",
    "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'GENERAL' ELSE 'SPAM' END AS event_type FROM events) GROUP BY ALL",
)
def sender_domain(spark, sf):
    domain = F.when(F.col("user_id") % 2 == 0, "Desk.OPS.example.com").otherwise("mail.example.net")
    sender = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), domain)
    told = read(spark, sf, "events").withColumn("a", C.offline_answer(sender, "mock", "ops.example.com"))
    return told.groupBy("user_id", F.col("a.category").alias("event_type")).agg(F.count("*").alias("n"))


VALID = "event_type IN ('signup', 'purchase', 'click')"


@query(
    "validate_pred",
    f"""SELECT event_id, CASE event_type WHEN 'signup' THEN 'SPAM' WHEN 'purchase' THEN 'INVOICE_QUERY' WHEN 'click' THEN 'GENERAL' ELSE 'GENERAL' END AS category,
    CASE WHEN {VALID} THEN greatest(0.0, least(1.0, round(value, 2) / 50 - 0.1)) ELSE 0.3 END AS confidence FROM events""",
)
def validate_pred(spark, sf):
    ev = read(spark, sf, "events")
    name = F.coalesce(
        *[F.when(F.col("event_type") == e, F.lit(c)) for e, c in (("signup", "SPAM"), ("purchase", "INVOICE_QUERY"), ("click", "GENERAL"))],
        F.col("event_type"),
    )
    a = C.validated_answer(name, F.round("value", 2) / 50 - 0.1)
    return ev.select("event_id", a.alias("a")).select("event_id", "a.category", "a.confidence")


# ---- cache and batches -------------------------------------------------------------
def cache_table(spark, sf):
    """Answers for what users said; some of it under the older key."""
    said = P.with_prompt(talk(spark, sf), legacy_prefix="m1").filter("`from` = 'user'")
    key = F.when(F.col("turn") == 0, F.col("prompt_key")).otherwise(F.col("legacy_key"))
    rows = said.select(
        key.alias("prompt_key"), F.lit("GENERAL").alias("category"), (F.lit(1.0) / (F.col("turn") + 2)).alias("confidence")
    )
    return rows.groupBy("prompt_key").agg(F.max("category").alias("category"), F.max("confidence").alias("confidence"))


CACHE_SQL = f"""
p AS (SELECT conv_id, turn, role, left(sha256(prompt), 20) AS k, left(sha256('m1' || chr(0) || prompt), 20) AS old
      FROM (SELECT *, {PROMPT_SQL} AS prompt FROM conversations)),
c AS (SELECT CASE WHEN turn = 0 THEN k ELSE old END AS ck, max(1.0 / (turn + 2)) AS conf FROM p WHERE role = 'user' GROUP BY 1)"""


@query(
    "cache_lookup",
    f"WITH {CACHE_SQL} SELECT conv_id, turn, CASE WHEN coalesce(a.conf, b.conf) IS NOT NULL THEN 'GENERAL' END AS category,"
    " round(coalesce(a.conf, b.conf), 6) AS confidence FROM p LEFT JOIN c a ON a.ck = k LEFT JOIN c b ON b.ck = old",
)
def cache_lookup(spark, sf):
    got = P.cached_answers(P.with_prompt(talk(spark, sf), legacy_prefix="m1"), cache_table(spark, sf))
    return got.select("conv_id", "turn", "category", F.round("confidence", 6).alias("confidence"))


@query("cache_miss", f"WITH {CACHE_SQL} SELECT conv_id, turn FROM p WHERE k NOT IN (SELECT ck FROM c) AND old NOT IN (SELECT ck FROM c)")
def cache_miss(spark, sf):
    return P.cache_misses(P.with_prompt(talk(spark, sf), legacy_prefix="m1"), cache_table(spark, sf)).select("conv_id", "turn")


@query("batch_pack", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 15 AS BIGINT) AS batch FROM documents")
def batch_pack(spark, sf):
    return P.pack_batches(read(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "batch_pack_buckets",
    """SELECT doc_id, bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 15 AS BIGINT) AS batch
    FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % 64 AS bucket FROM documents)""",
)
def batch_pack_buckets(spark, sf):
    return P.pack_batches(read(spark, sf, "documents").select("doc_id"), "doc_id", buckets=64)


@query(
    "model_answers",
    """SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'INVOICE_QUERY' ELSE 'SPAM' END AS category,
    CASE WHEN length(text) % 2 = 0 THEN 0.8 ELSE 0.5 END AS confidence FROM conversations""",
)
def model_answers(spark, sf):
    """Rules leave every turn open; a deterministic stand-in for a model answers each prompt."""
    said = C.classify(talk(spark, sf).withColumn("attachments", F.array().cast("array<string>")))
    facts = F.concat_ws(
        "|", F.col("email_id"), F.contains(F.col("body"), F.lit("?")).cast("string"), (F.length("body") % 2).cast("string")
    )
    asked = said.withColumn("prompt", facts).withColumn("prompt_key", T.content_key("prompt"))

    def model(pdf):
        parts = pdf["prompt"].str.split("|")
        return pdf.assign(
            category=parts.str[1].map({"true": "INVOICE_QUERY", "false": "SPAM"}),
            confidence=parts.str[2].map({"0": 0.97, "1": 0.5}),
            why="stand-in",
        )

    answers = P.predict(C.unsure(asked), model)
    told = asked.join(answers.select("prompt_key", F.col("category").alias("c"), F.col("confidence").alias("p")), "prompt_key", "left")
    done = C.apply_model(told, F.col("c"), F.col("p"))
    return done.select("conv_id", "turn", F.col("classification.category").alias("category"), F.col("classification.confidence").alias("confidence"))


@query(
    "lenient_json",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
)
def lenient_json(spark, sf):
    p = F.col("props")
    reply = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Sure, here it is: "), p, F.lit(" - hope it helps")))
        .when(F.col("event_type") == "error", F.lit("no answer {broken"))
        .otherwise(p)
    )
    rows = read(spark, sf, "events").select("event_id", P.lenient_json(reply).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@query(
    "explode_response",
    """SELECT event_id, 'a' || event_id AS id, 'SPAM' AS category, least(1.0, round(value, 2) / 40) AS confidence FROM events
    UNION ALL SELECT event_id, 'b' || event_id, 'GENERAL', 0.7 FROM events""",
)
def explode_response(spark, sf):
    n = F.col("event_id").cast("string")
    reply = F.concat(
        F.lit('{"a'), n, F.lit('": {"category": "SPAM", "confidence": '), (F.round("value", 2) / 40).cast("string"),
        F.lit('}, "b'), n, F.lit('": {"category": "GENERAL", "confidence": "high"}, "c": {"category": "OTHER"}, "d": {"category": "SPAM"}}'),
    )
    asked = F.array(F.concat(F.lit("a"), n), F.concat(F.lit("b"), n), F.lit("c"))
    rows = read(spark, sf, "events").select("event_id", reply.alias("reply"), asked.alias("asked"))
    return P.explode_reply(rows, "reply", "event_id", asked="asked").drop("why")


# ---- normalisation over column-rendered values ---------------------------------------
@query(
    "is_blank",
    "SELECT event_id, event_type <> 'purchase' AND (event_id % 3 < 2) AS blank FROM events",
)
def is_blank(spark, sf):
    pool = {
        "signup": ("TBA", " ____MT ", "REAL CO"),
        "view": ("???", "n/a", "0"),
        "click": (" -", "_tbc_", "3"),
        "error": ("   ", "To be advised", "SINGAPORE"),
        "purchase": ("__X__", "T.B.A", "NA 1"),
    }
    raw = F.coalesce(
        *[F.when(F.col("event_type") == e, F.get(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % 3).cast("int"))) for e, xs in pool.items()]
    )
    return read(spark, sf, "events").select("event_id", N.is_blank(raw).alias("blank"))


@query("norm_party", "SELECT c_custkey, 'CUSTOMER ' || substr(c_name, 10) || ' ' || c_mktsegment AS party FROM customer")
def norm_party(spark, sf):
    k = F.col("c_custkey")
    suffix = F.get(F.array(*[F.lit(x) for x in (" CO., LTD", " Pte. Ltd.", " Sdn Bhd", " GmbH | 5 ROAD", " Inc\n12 HARBOUR RD")]), (k % 5).cast("int"))
    raw = F.concat("c_name", F.lit(" "), F.lower("c_mktsegment"), suffix)
    return read(spark, sf, "customer").select("c_custkey", N.norm_party(raw).alias("party"))


@query(
    "norm_port",
    "SELECT s_suppkey, upper(replace(n_name, '_', ' ')) || ' ' || r_name AS port FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def norm_port(spark, sf):
    s, n, r = (read(spark, sf, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.when(F.col("s_suppkey") % 2 == 0, " (ABCDE)").otherwise("")
    return rows.select("s_suppkey", N.norm_port(F.concat(F.lower("n_name"), F.lit(",  "), "r_name", code)).alias("port"))


@query("norm_count", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS n FROM lineitem")
def norm_count(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    word = F.get(F.array(*[F.lit(w) for w in V.NUMBER_WORDS]), (q - 1).cast("int"))
    raw = (
        F.when(F.col("l_linenumber") == 6, "several")
        .when((F.col("l_linenumber") == 1) & (q <= 12), F.concat(word, F.lit(" (99) units")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("00"), q.cast("string"), F.lit(" X 20GP")))
        .otherwise(F.concat(q.cast("string"), F.lit(" x 40'HC")))
    )
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.norm_count(raw).alias("n"))


@query(
    "norm_weight",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(CASE l_linenumber % 3 WHEN 0 THEN CAST(c AS DOUBLE) / 100
    WHEN 1 THEN (CAST(c AS DOUBLE) / 100) * 0.45359237 ELSE (l_quantity + 0.5) END, 0) AS BIGINT) AS kg
    FROM (SELECT *, CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS c FROM lineitem)""",
)
def norm_weight(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100, 0).cast("bigint")
    shown = F.concat(F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    m = F.col("l_linenumber") % 3
    raw = F.when(m == 0, F.concat(shown, F.lit(" kgs"))).when(m == 1, F.concat(shown, F.lit(" LBS"))).otherwise(
        F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".5 KG"))
    )
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.norm_weight(raw).alias("kg"))


@query(
    "normalize_dispatch",
    """SELECT o_orderkey, f AS field, CASE f WHEN 'shipper' THEN 'ACME ' || o_orderkey WHEN 'port_of_loading' THEN 'ACME ' || o_orderkey || ' CO LTD'
    WHEN 'container_count' THEN CAST(o_orderkey AS VARCHAR) WHEN 'gross_weight_kg' THEN CAST(o_orderkey AS VARCHAR)
    ELSE 'Acme ' || o_orderkey || ' Co., Ltd' END AS value FROM orders, (SELECT unnest(['shipper', 'port_of_loading', 'container_count', 'gross_weight_kg', 'vessel']) AS f)""",
)
def normalize_dispatch(spark, sf):
    names = F.array(*[F.lit(x) for x in ("shipper", "port_of_loading", "container_count", "gross_weight_kg", "vessel")])
    rows = read(spark, sf, "orders").select("o_orderkey", F.explode(names).alias("field"))
    raw = F.concat(F.lit("Acme "), F.col("o_orderkey").cast("string"), F.lit(" Co., Ltd"))
    return rows.select("o_orderkey", "field", N.normalize("field", raw).alias("value"))


# ---- labels against the quality gate: scoring on given truth ------------------------------
LABEL_SQL = f"""q AS (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'GENERAL' ELSE 'SPAM' END AS actual,
  CASE WHEN {POOR} THEN 'SPAM' ELSE 'GENERAL' END AS predicted
  FROM labels l JOIN (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents) d USING (doc_id))"""


@query("confusion_labels", f"WITH {LABEL_SQL} SELECT actual, predicted, count(*) AS n FROM q GROUP BY ALL")
def confusion_labels(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", T.is_poor("text").alias("poor"))
    rows = read(spark, sf, "labels").join(docs, "doc_id").select(
        F.when(F.col("quality") == 1, "GENERAL").otherwise("SPAM").alias("actual"),
        F.when(F.col("poor"), "SPAM").otherwise("GENERAL").alias("predicted"),
    )
    return E.confusion(rows)


@query(
    "facets",
    "SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)",
)
def facets(spark, sf):
    return E.facets(read(spark, sf, "documents"), "lang", "source")


# ---- review log and store on events -----------------------------------------------------
def review_events(spark, sf):
    """Events as a review log: what a user did becomes what a reviewer did."""
    t = F.col("event_type")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("msg_"), F.col("user_id").cast("string")).alias("email_id"),
        F.when(t == "purchase", "confirm").when(t.isin("click", "view", "error"), "correct").otherwise("dismiss").alias("action"),
        F.when(t == "click", F.get(F.array(*[F.lit(f) for f in V.FIELDS]), (F.col("event_id") % 7).cast("int")))
        .when(t == "view", "vessel").alias("field"),
        F.when((t == "click") | ((t == "view") & (F.col("event_id") % 2 == 0)), F.col("value").cast("bigint").cast("string")).alias("corrected_value"),
        F.col("ts").alias("created_at"),
    )


FIELD_LIST = "[" + ", ".join(f"'{f}'" for f in V.FIELDS) + "]"
LOG_SQL = f"""log AS (SELECT event_id AS id, 'msg_' || user_id AS email_id, user_id,
  CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'signup' THEN 'dismiss' ELSE 'correct' END AS action,
  CASE event_type WHEN 'click' THEN {FIELD_LIST}[event_id % 7 + 1] WHEN 'view' THEN 'vessel' END AS field,
  CASE WHEN event_type = 'click' OR (event_type = 'view' AND event_id % 2 = 0) THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS corrected_value
  FROM events),
ok AS (SELECT * FROM log WHERE action = 'confirm' OR (action = 'correct' AND field IS NOT NULL AND corrected_value IS NOT NULL))"""


@query(
    "review_validate",
    f"""WITH {LOG_SQL} SELECT id, CASE WHEN action = 'dismiss' THEN 'action must be confirm or correct'
    WHEN action = 'correct' AND field IS NULL THEN 'field is required for a correction'
    WHEN action = 'correct' AND corrected_value IS NULL THEN 'corrected_value is required for a correction' END AS rejected FROM log""",
)
def review_validate(spark, sf):
    return W.validate_reviews(review_events(spark, sf)).select("id", "rejected")


@query(
    "review_log",
    f"WITH {LOG_SQL} SELECT email_id, coalesce(field, '') AS field, count(*) AS n, arg_max(corrected_value, id) AS last_value, max(id) AS last_id FROM ok WHERE action = 'correct' GROUP BY ALL",
)
def review_log(spark, sf):
    log = W.valid_reviews(review_events(spark, sf))
    n = log.filter("action = 'correct'").groupBy("email_id", "field").agg(F.count("*").alias("n"))
    both = W.corrections(log).join(n, ["email_id", "field"])
    return both.select("email_id", "field", "n", F.col("corrected_value").alias("last_value"), F.col("review_id").alias("last_id"))


@query(
    "upsert_latest",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def upsert_latest(spark, sf):
    return latest(read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "learned_extract",
    """WITH e AS (SELECT event_id, 'Tag ' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS label FROM events)
    SELECT event_id, 'shipper' AS field, CASE WHEN event_id % 2 = 0 OR event_id % 10 = 5 THEN 'ACME ' || event_id END AS value, CASE WHEN event_id % 2 = 0 OR event_id % 10 = 5 THEN label ELSE '' END AS label_seen FROM e
    UNION ALL SELECT event_id, 'consignee', CASE WHEN event_id % 2 = 1 OR event_id % 10 = 0 THEN 'ACME ' || event_id END, CASE WHEN event_id % 2 = 1 OR event_id % 10 = 0 THEN label ELSE '' END FROM e""",
)
def learned_extract(spark, sf):
    """A label learned from every event, each tenth for two fields, and a document that uses it."""
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("Tag "), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("label_seen"))
    n = F.col("event_id")
    fields = F.array_compact(F.array(
        F.when((n % 2 == 0) | (n % 10 == 5), F.lit("shipper")), F.when((n % 2 == 1) | (n % 10 == 0), F.lit("consignee"))))
    learned = e.select(F.explode(fields).alias("field"), "label_seen")
    docs = e.select("event_id", F.concat(F.lit("BILL OF LADING\n"), "label_seen", F.lit(": Acme "), n.cast("string")).alias("text"))
    rows = extract_fields_learned(docs, learned, "event_id").select("event_id", F.explode(F.slice("fields", 1, 2)).alias("f"))
    return rows.select("event_id", "f.field", "f.value", "f.label_seen")


@query(
    "store_replay",
    "SELECT user_id, arg_max(event_id, (event_id // 50, user_id % 3, event_id)) AS event_id, arg_max(event_type, (event_id // 50, user_id % 3, event_id)) AS event_type FROM events GROUP BY user_id",
)
def store_replay(spark, sf):
    """Events as batches of several writers, some of them written twice, read as a store is."""
    e = read(spark, sf, "events").select(
        "user_id", "event_id", "event_type", F.floor(F.col("event_id") / 50).alias("version"),
        (F.col("user_id") % 3).cast("string").alias("writer"), F.col("event_id").alias("batch"))
    return current(e.union(e.filter("event_id % 4 = 0")), "user_id")


@query(
    "reconcile_keys",
    """WITH l AS (SELECT CASE WHEN event_id % 19 <> 0 THEN user_id END AS k, event_type AS v FROM events),
    a AS (SELECT k, count(*) AS n, min(v) AS v FROM l WHERE k IS NOT NULL GROUP BY k),
    b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'view' ELSE 'click' END AS v FROM customer)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN n > 1 OR a.k IS NULL OR b.k IS NULL THEN 'NEEDS_REVIEW' WHEN a.v = b.v THEN 'OK' ELSE 'MISMATCH' END AS status,
    CASE WHEN n > 1 THEN 'repeated_key' WHEN a.k IS NULL OR b.k IS NULL THEN 'missing_value' END AS review_reason FROM a FULL JOIN b ON a.k = b.k
    UNION ALL SELECT k, 'NEEDS_REVIEW', 'null_key' FROM l WHERE k IS NULL""",
)
def reconcile_keys(spark, sf):
    """One side repeats keys and has NULL ones; neither is paired, and neither is lost."""
    left = read(spark, sf, "events").select(F.when(F.col("event_id") % 19 != 0, F.col("user_id")).alias("k"), F.col("event_type").alias("v"))
    right = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "view").otherwise("click").alias("v"))
    return RC.reconcile(left, right, ["k"], ["v"]).select("k", "status", "review_reason")


@query(
    "reconcile_lines",
    """WITH a AS (SELECT l_orderkey AS k, l_partkey % 20 AS p, l_suppkey % 5 AS s, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS i FROM lineitem),
    b AS (SELECT k, CASE WHEN i = 2 THEN (p + 1) % 20 ELSE p END AS p, CASE WHEN (k + i) % 3 = 0 THEN (s + 1) % 5 ELSE s END AS s, CASE WHEN (k + i) % 5 = 0 THEN q + 1 ELSE q END AS q FROM a WHERE (k + i) % 11 <> 0
      UNION ALL SELECT k, p, s, q FROM a WHERE (k + i) % 13 = 0),
    r AS (SELECT k, p, s, q, 1 AS na, 0 AS nb FROM a UNION ALL SELECT k, p, s, q, 0, 1 FROM b),
    d3 AS (SELECT k, least(sum(na), sum(nb)) AS m FROM r GROUP BY k, p, s, q), d2 AS (SELECT k, least(sum(na), sum(nb)) AS m FROM r GROUP BY k, p, s),
    d1 AS (SELECT k, least(sum(na), sum(nb)) AS m FROM r GROUP BY k, p), d0 AS (SELECT k, sum(na) AS na, sum(nb) AS nb, least(sum(na), sum(nb)) AS m FROM r GROUP BY k),
    t AS (SELECT d0.k, na, nb, d0.m AS m0, m1, m2, m3 FROM d0 JOIN (SELECT k, sum(m) AS m1 FROM d1 GROUP BY k) USING (k) JOIN (SELECT k, sum(m) AS m2 FROM d2 GROUP BY k) USING (k) JOIN (SELECT k, sum(m) AS m3 FROM d3 GROUP BY k) USING (k)),
    u AS (SELECT k, unnest([{'agreed': 3, 'n': m3}, {'agreed': 2, 'n': m2 - m3}, {'agreed': 1, 'n': m1 - m2}, {'agreed': 0, 'n': m0 - m1}, {'agreed': -1, 'n': na + nb - 2 * m0}], recursive := true) FROM t)
    SELECT k, CAST(agreed AS INTEGER) AS agreed, CAST(n AS BIGINT) AS n, CASE agreed WHEN 3 THEN 'OK' WHEN -1 THEN 'NEEDS_REVIEW' ELSE 'MISMATCH' END AS status FROM u WHERE n > 0""",
)
def reconcile_lines(spark, sf):
    """Lines of orders against a changed copy, some dropped and some doubled: how far the paired lines of each order agree."""
    k, i = F.col("k"), F.col("i")
    a = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 20).alias("p"), (F.col("l_suppkey") % 5).alias("s"),
        F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("i"))
    b = a.filter((k + i) % 11 != 0).select(
        "k", F.when(i == 2, (F.col("p") + 1) % 20).otherwise(F.col("p")).alias("p"),
        F.when((k + i) % 3 == 0, (F.col("s") + 1) % 5).otherwise(F.col("s")).alias("s"),
        F.when((k + i) % 5 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"))
    b = b.union(a.filter((k + i) % 13 == 0).select("k", "p", "s", "q"))
    paired = RC.reconcile(a, b, ["k"], ["p", "s", "q"], pair_repeats=True)
    same = [F.col(f"{f}_status") == "match" for f in "psq"]
    agreed = F.when(F.col("status") == "NEEDS_REVIEW", -1).when(~same[0], 0).when(~same[1], 1).when(~same[2], 2).otherwise(3)
    return paired.groupBy("k", agreed.alias("agreed"), "status").agg(F.sum("n").alias("n"))


@query(
    "batch_prompts",
    r"""WITH m AS (SELECT conv_id * 1000 + turn AS id, role, coalesce(text, '') AS text FROM conversations), b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 15 AS batch FROM m)
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, sha256('ASK' || chr(10) || string_agg('--- id: ' || id || chr(10) || 'FROM: ' || role || chr(10) || 'SUBJECT: ' || chr(10) || 'BODY: '
      || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 700), chr(10) || chr(10) ORDER BY id)) AS prompt FROM b GROUP BY batch""",
)
def batch_prompts(spark, sf):
    talk_rows = read(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("email_id"), F.col("role").alias("from"), F.lit(None).cast("string").alias("subject"), F.col("text").alias("body"))
    p = P.batch_prompts(talk_rows, template="ASK\n{emails}")
    return p.select("batch", F.size("ids").cast("bigint").alias("n"), F.sha2("prompt", 256).alias("prompt"))


@query("latest_runs", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def latest_runs(spark, sf):
    return E.newest(read(spark, sf, "events").select("event_id", "event_type"), "event_id", 500)


@query(
    "fixed_sample",
    """SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank, greatest(total - 10, 0) AS more FROM (SELECT event_type, event_id,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 10""",
)
def fixed_sample(spark, sf):
    return R.top_per_group(read(spark, sf, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])


@query(
    "run_stats",
    """SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std,
    round(max(value) - min(value), 6) AS spread, round(avg(value) - 10.0, 6) AS gap, CASE WHEN avg(value) - 10.0 < -0.03 THEN 'warning' ELSE 'generalises' END AS verdict
    FROM events GROUP BY event_type""",
)
def run_stats(spark, sf):
    s = E.run_stats(read(spark, sf, "events"), "value", 10.0, "event_type")
    for c in ("mean", "std", "spread", "gap"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query(
    "alias_union",
    f"""WITH b AS (SELECT unnest([{", ".join(f"{{'field': '{f}', 'label': '{x}'}}" for f in V.FIELDS for x in V.LABELS[f])}], recursive := true)),
    l AS (SELECT DISTINCT {FIELD_LIST}[event_id % 7 + 1] AS field, 'Label ' || user_id AS label FROM events WHERE event_type = 'click')
    SELECT field, label, 'builtin' AS origin FROM b UNION ALL SELECT field, label, 'learned' FROM l WHERE (field, label) NOT IN (SELECT field, label FROM b)""",
)
def alias_union(spark, sf):
    log = review_events(spark, sf).filter("action = 'correct' AND field <> 'vessel'")
    seen = log.select("field", F.concat(F.lit("Label "), F.substring("email_id", 5, 30)).alias("label_seen"))
    return D.label_table(spark, seen)


# ---- two versions of a table --------------------------------------------------------------
@query(
    "snapshot_diff",
    """WITH b AS (SELECT o_orderkey, o_orderkey % 97 = 0 AS removed, o_orderkey % 31 = 0 AS price, o_orderkey % 43 = 0 AS status, o_orderkey % 89 = 0 AS added FROM orders)
    SELECT o_orderkey, CASE WHEN removed THEN 'removed' ELSE 'changed' END AS change, CAST(1 AS BIGINT) AS n_before, CAST(NOT removed AS BIGINT) AS n_after,
    CASE WHEN removed THEN '' ELSE concat_ws(',', CASE WHEN status THEN 'o_orderstatus' END, CASE WHEN price THEN 'o_totalprice' END) END AS differing
    FROM b WHERE removed OR price OR status
    UNION ALL SELECT -o_orderkey, 'added', 0, 1, '' FROM b WHERE added AND NOT removed""",
)
def snapshot_diff(spark, sf):
    before, key = read(spark, sf, "orders"), F.col("o_orderkey")
    after = before.filter(key % 97 != 0)
    added = after.filter(key % 89 == 0).withColumn("o_orderkey", -key)
    after = after.withColumn("o_totalprice", F.when(key % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast(before.schema["o_totalprice"].dataType))
    after = after.withColumn("o_orderstatus", F.when(key % 43 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")))
    found = SN.diff(before, after.unionByName(added), ["o_orderkey"])
    return found.withColumn("differing", F.concat_ws(",", "differing"))
