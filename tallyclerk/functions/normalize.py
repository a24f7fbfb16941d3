"""Column functions that make differently written values comparable.

Each returns NULL for a value it cannot use.  Counts and weights come in two forms: a
BIGINT for arithmetic and a text form without size limit, which is what gets compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.text import _col, strip

_SUFFIX = r"\b(?:" + "|".join(V.CORPORATE_SUFFIXES) + r")\b"


def is_blank(raw: Column | str) -> Column:
    """Absent, a placeholder, or a fill-in run such as '____MT'."""
    raw = _col(raw)
    core = strip(F.btrim(strip(raw), F.lit("_")))
    return (
        raw.isNull()
        | raw.rlike("_{3,}")
        | F.upper(core).isin(*V.BLANKS)
    )


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^A-Z0-9]+", " "))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def party_text(v: Column | str) -> Column:
    """`norm_party` with '' for unusable."""
    first = F.substring_index(F.substring_index(_col(v), "|", 1), "\n", 1)
    plain = F.translate(F.upper(first), ".,", "  ")
    return _tidy(F.regexp_replace(plain, _SUFFIX, " "))


def norm_party(v: Column | str) -> Column:
    """Company name of the first line or cell, without punctuation and corporate suffixes."""
    return _or_null(party_text(v))


def port_text(v: Column | str) -> Column:
    """`norm_port` with '' for unusable."""
    return _tidy(F.upper(F.regexp_replace(_col(v), r"\([A-Z]{5}\)", "")))


def norm_port(v: Column | str) -> Column:
    """Port name.  The five-letter code is dropped, never compared: codes survive edits."""
    return _or_null(port_text(v))


def _without_commas(v: Column | str) -> Column:
    return F.upper(F.translate(_col(v).cast("string"), ",", ""))


def count_text(v: Column | str) -> Column:
    """`norm_count` as text of any length, '' for unusable."""
    s = _without_commas(v)
    word = F.when(s.rlike(rf"\b{V.NUMBER_WORDS[0]}\b"), "1")
    for n, w in enumerate(V.NUMBER_WORDS[1:], 2):
        word = word.when(s.rlike(rf"\b{w}\b"), str(n))
    digits = F.regexp_extract(s, r"0*(\d+)", 1)  # leading zeros dropped, one digit kept
    spelled = s.rlike(r"\b(?:" + "|".join(V.NUMBER_WORDS) + r")\b")
    return F.when(spelled, word).otherwise(digits)


def norm_count(v: Column | str) -> Column:
    """'3', "3 x 40'HC" and 'THREE' are all 3."""
    return count_text(v).try_cast("bigint")


def _kilograms(v: Column | str) -> Column:
    s = _without_commas(v)
    n = F.regexp_extract(s, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    n = F.when(s.contains("LB"), n * V.LB_TO_KG).otherwise(n)
    n = F.when(s.rlike(r"\bMT\b|TONNE|\bTON\b"), n * 1000).otherwise(n)
    return F.rint(n)  # half to even


def weight_text(v: Column | str) -> Column:
    """`norm_weight` as text of any length, '' for unusable."""
    kg = _kilograms(v)
    return F.coalesce(kg.try_cast("decimal(38,0)").cast("string"), kg.cast("string"), F.lit(""))


def norm_weight(v: Column | str) -> Column:
    """Whole kilograms from kilograms, pounds or tonnes."""
    return _kilograms(v).try_cast("bigint")


NORMALIZERS = {
    **{f: party_text for f in V.PARTY_FIELDS},
    **{f: port_text for f in V.PORT_FIELDS},
    **{f: count_text for f in V.COUNT_FIELDS},
    **{f: weight_text for f in V.WEIGHT_FIELDS},
}


def comparable(field: Column, raw: Column, normalizers=None) -> Column:
    """Comparable text of a value that is not blank, '' when it has none."""
    by_function: dict = {}
    for name, fn in (normalizers or NORMALIZERS).items():
        by_function.setdefault(fn, []).append(name)
    out = None
    for fn, names in by_function.items():
        test, made = field.isin(*names), fn(raw)
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(raw)


def normalize(field: Column | str, raw: Column | str, normalizers=None) -> Column:
    """Normalised text of `raw` for the field named by a column; unknown fields pass through."""
    field, raw = _col(field), _col(raw)
    return F.when(~is_blank(raw), _or_null(comparable(field, raw, normalizers)))
