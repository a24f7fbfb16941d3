"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyclerk import vocab as V
from tallyclerk.plans import corpus as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL that derives, from columns only, what the rendered corpus must yield ---------

SHIP_SQL = f"""
li AS (SELECT l_orderkey AS k, count(*) AS n_items, CAST(sum(l_quantity) * 100 AS BIGINT) AS kg,
              min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey),
base AS (SELECT o.o_orderkey AS k, coalesce(li.n_items, 0) AS n_items, kg, s_name, c_name,
                sn.n_name AS pol_n, sr.r_name AS pol_r, cn.n_name AS pod_n, cr.r_name AS pod_r
         FROM orders o LEFT JOIN li ON li.k = o.o_orderkey
         LEFT JOIN supplier ON s_suppkey = sk LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
         LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
         LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
         LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey),
kinds AS (SELECT *, {K.KIND_SQL} AS kind, {K.DEFECT_SQL} AS defect FROM base),
ship AS MATERIALIZED (SELECT *, 'msg_' || k AS email_id,
  CASE WHEN kind IN ('pair', 'silent') THEN defect END AS planted,
  CASE kind WHEN 'si_request' THEN 'SI_REQUEST' WHEN 'invoice' THEN 'INVOICE_QUERY'
    WHEN 'invoice_trap' THEN 'INVOICE_QUERY' WHEN 'general' THEN 'GENERAL' WHEN 'quiet_general' THEN 'GENERAL'
    WHEN 'quiet_spam' THEN 'GENERAL' WHEN 'spam' THEN 'SPAM' ELSE 'BL_COMPARISON' END AS category,
  CASE kind WHEN 'no_docs' THEN 'missing_attachment' WHEN 'unreadable' THEN 'unreadable'
    WHEN 'absent_file' THEN 'unreadable' WHEN 'scanned' THEN 'unreadable' WHEN 'wrong_type' THEN 'wrong_doc_type'
    WHEN 'blank_weight' THEN 'missing_value' END AS review_reason
  FROM kinds),
verdict AS (SELECT *, CASE WHEN review_reason IS NOT NULL THEN 'NEEDS_REVIEW'
    WHEN planted IS NOT NULL THEN 'MISMATCH' ELSE 'OK' END AS status FROM ship),
truth AS (SELECT k, email_id,
  CASE kind WHEN 'si_request' THEN 'SI_REQUEST' WHEN 'invoice' THEN 'INVOICE_QUERY' WHEN 'general' THEN 'GENERAL'
    WHEN 'quiet_general' THEN 'GENERAL' WHEN 'spam' THEN 'SPAM' WHEN 'quiet_spam' THEN 'SPAM'
    ELSE 'BL_COMPARISON' END AS category,
  CASE WHEN kind = 'invoice_trap' THEN 'NEEDS_REVIEW' ELSE status END AS status,
  CASE WHEN kind = 'invoice_trap' THEN 'wrong_doc_type' ELSE review_reason END AS review_reason,
  planted FROM verdict),
scored AS (SELECT t.email_id, t.category AS actual, v.category AS predicted, t.status AS t_status, v.status AS p_status,
  t.review_reason, t.planted AS gold, v.planted AS found FROM truth t JOIN verdict v USING (email_id))"""

_WORDS = "[" + ", ".join(f"'{w}'" for w in V.NUMBER_WORDS) + "]"


def _side_parts(side: str) -> list[dict[str, str]]:
    """By field, the SQL of its columns in a document of this side."""
    name = lambda c: f"upper(replace(replace({c}, '#', ' '), '_', ' '))"
    port, goal = "pol_n || ', ' || pol_r", "pod_n || ', ' || pod_r"
    if side == "SI":
        raw = {
            "shipper": "s_name || ' PTE. LTD.'",
            "consignee": "c_name || ' CO., LTD'",
            "notify_party": "c_name",
            "port_of_loading": f"{port} || ' (AAAAA)'",
            "port_of_discharge": goal,
            "container_count": f"CASE WHEN k % 6 = 0 AND n_items BETWEEN 1 AND 12 THEN {_WORDS}[n_items] ELSE n_items || ' x 40''HC' END",
            "gross_weight_kg": "CASE WHEN kind = 'blank_weight' THEN ['TBA', '____MT', '???', 'N/A'][k % 4 + 1]"
            " WHEN k % 9 = 0 THEN (kg // 1000) || '.' || ((kg % 1000) // 100) || ' MT' ELSE format('{:,}', kg) || ' KG' END",
        }
        value = {
            "shipper": name("s_name"),
            "consignee": name("c_name"),
            "notify_party": name("c_name"),
            "port_of_loading": f"{name('pol_n')} || ' ' || pol_r",
            "port_of_discharge": f"{name('pod_n')} || ' ' || pod_r",
            "container_count": "CAST(n_items AS VARCHAR)",
            "gross_weight_kg": "CASE WHEN kind <> 'blank_weight' THEN CAST(kg AS VARCHAR) END",
        }
    else:
        is_defect = lambda f: f"coalesce(defect, '') = '{f}'"
        raw = {
            "shipper": "s_name || ' Pte Ltd'",
            "consignee": f"CASE WHEN {is_defect('consignee')} THEN 'OTHER ' ELSE '' END || c_name || ' Co Ltd'",
            "notify_party": "c_name",
            "port_of_loading": f"CASE WHEN {is_defect('port_of_loading')} THEN 'PORT ' ELSE '' END || {port} || ' (AAAAA)'",
            "port_of_discharge": f"lower({goal})",
            "container_count": f"(n_items + CASE WHEN {is_defect('container_count')} THEN 1 ELSE 0 END) || ' x 40''HC'",
            "gross_weight_kg": f"(kg + CASE WHEN {is_defect('gross_weight_kg')} THEN 500 ELSE 0 END) || '.00 kgs'",
        }
        value = {
            "shipper": name("s_name"),
            "consignee": f"CASE WHEN {is_defect('consignee')} THEN 'OTHER ' ELSE '' END || {name('c_name')}",
            "notify_party": name("c_name"),
            "port_of_loading": f"CASE WHEN {is_defect('port_of_loading')} THEN 'PORT ' ELSE '' END || {name('pol_n')} || ' ' || pol_r",
            "port_of_discharge": f"{name('pod_n')} || ' ' || pod_r",
            "container_count": f"CAST(n_items + CASE WHEN {is_defect('container_count')} THEN 1 ELSE 0 END AS VARCHAR)",
            "gross_weight_kg": f"CAST(kg + CASE WHEN {is_defect('gross_weight_kg')} THEN 500 ELSE 0 END AS VARCHAR)",
        }
    plain_line = dict(zip(V.FIELDS, (4, 6, 8, 10, 11, 12, 13)))
    wrapped_line = dict(zip(V.FIELDS, (5, 8, 11, 14, 16, 18, 20)))
    parts = []
    for i, f in enumerate(V.FIELDS):
        labels = K.DISTINCT_LABELS[f]
        index = f"k % {len(labels)}" if side == "SI" else f"(7 * k + 1) % {len(labels)}"
        label = "[" + ", ".join(f"'{x}'" for x in labels) + f"][{index} + 1]"
        if f == "gross_weight_kg":
            label = f"CASE WHEN k % 8 = 0 THEN 'GROSS WEIGHT' ELSE {label} END"
        extra = "+ CASE WHEN kind = 'wrong_type' THEN 1 ELSE 0 END" if side == "BL" else ""
        blank = "(kind = 'blank_weight')" if (side, f) == ("SI", "gross_weight_kg") else "false"
        gone = f"({blank} AND k % 4 = 3)"
        parts.append({
            "value": value[f],
            "raw": f"CASE WHEN NOT {gone} THEN {raw[f]} END",
            "confidence": f"CASE WHEN {blank} THEN 0.0 WHEN kind = 'scanned' THEN 0.5 ELSE [0.95, 0.85, 0.7, 0.8][k % 4 + 1] END",
            "method": "CASE WHEN kind = 'scanned' THEN 'ocr' ELSE 'rule' END",
            "line": f"CASE WHEN {gone} THEN -1 WHEN k % 4 = 3 THEN {wrapped_line[f]} {extra} ELSE {plain_line[f]} {extra} END",
            "label_seen": f"CASE WHEN {gone} THEN '' ELSE {label} END",
        })
    return parts


_KINDS = {
    "SI": "('one_doc','unreadable','wrong_type','absent_file','invoice_trap','scanned','blank_weight','silent','pair')",
    "BL": "('wrong_type','invoice_trap','scanned','blank_weight','silent','pair')",
}


def _side_sql(side: str) -> str:
    """A row per document and field."""
    return " UNION ALL ".join(
        f"SELECT k, email_id, kind, '{side}' AS side, {i} AS field_no, '{f}' AS field, " + ", ".join(f"{sql} AS {c}" for c, sql in part.items()) + f" FROM ship WHERE kind IN {_KINDS[side]}"
        for i, (f, part) in enumerate(zip(V.FIELDS, _side_parts(side))))


def _both_sql() -> str:
    """A row per message and field, with what either document says; both come from one row of ship."""
    short = {"value": "value", "raw": "raw", "line": "line", "label_seen": "label"}
    structs = []
    for i, (f, si, bl) in enumerate(zip(V.FIELDS, _side_parts("SI"), _side_parts("BL"))):
        columns = {"field_no": str(i), "field": f"'{f}'"}
        columns |= {f"{side}_{name}": part[c] for side, part in (("si", si), ("bl", bl)) for c, name in short.items()}
        structs.append("{" + ", ".join(f"'{name}': {sql}" for name, sql in columns.items()) + "}")
    return f"SELECT k, email_id, kind, unnest([{', '.join(structs)}]) AS f FROM ship WHERE kind IN ('pair', 'silent', 'blank_weight', 'scanned')"


FIELDS_SQL = f"{SHIP_SQL},\nfields AS MATERIALIZED ({_side_sql('SI')} UNION ALL {_side_sql('BL')})"
COMPARED_SQL = f"""{SHIP_SQL},
cmp AS (SELECT k, email_id, kind, f.field_no, f.field, f.si_value, f.bl_value, f.si_raw, f.bl_raw, f.si_line, f.bl_line, f.si_label, f.bl_label,
  CASE WHEN f.si_value IS NULL THEN 'uncertain' WHEN kind = 'scanned' THEN 'uncertain' WHEN f.si_value = f.bl_value THEN 'match'
    ELSE 'mismatch' END AS status,
  CASE WHEN f.si_value IS NULL THEN 'value not found in the SI' WHEN kind = 'scanned' THEN 'extracted with low confidence'
    END AS reason
  FROM ({_both_sql()}))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
