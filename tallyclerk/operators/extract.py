"""Label/value extraction from document text.

One row per document goes in and one row per document comes out: lines that start with a
known label are kept, every (label, form) they match becomes a candidate, and the candidate
with the smallest (label, form, line) wins. An Arrow function names the leading candidate of
each field; columns normalise it, judge it, and contest all candidates where it is in doubt.
Nothing is exploded or shuffled, so a scan of any size extracts in its own tasks.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.functions.normalize import NORMALIZERS, count_text, is_blank, normalize, party_text, port_text, weight_text
from tallyclerk.functions.text import fold_ascii, is_empty, strip

S = r"[\t-\r\x{1c}-\x{20}]"
NOT_S = r"[^\t-\r\x{1c}-\x{20}]"

FIELD_STRUCT = (
    "struct<field:string,value:string,raw:string,confidence:double,method:string,"
    "line:int,label_seen:string,snippet:string>"
)

# Stands for "no longer label": no captured text begins or extends it.
NO_TAIL = "\x00"

# Forms in order of trust within one label.
ALONE, COLON, WIDE, TIGHT = range(4)
FORM_CONFIDENCE = {
    ALONE: V.CONF_WRAP,
    COLON: V.CONF_COLON,
    WIDE: V.CONF_WIDE,
    TIGHT: V.CONF_TIGHT,
}


def _literal(text: str) -> str:
    return "".join(ch if ch.isalnum() else rf"\x{{{ord(ch):x}}}" for ch in text)


# What may follow a label: up to four stray characters, an optional parenthesis, then the
# separator of the form and the value.  Possessive quantifiers keep wide columns linear.
_STRAY = r"(?s)^[^\t-\r\x{1c}-\x{20}:\x{ff1a}]{0,4}"
_PAREN = rf"(?:{S}*+\([^)]*\))?"
FORM_PATTERN = {
    COLON: _STRAY + _PAREN + rf"{S}*+:{S}*+({NOT_S}.*)$",
    WIDE: _STRAY + _PAREN + rf"{S}{{2,}}+({NOT_S}.*)$",
    TIGHT: _STRAY + _PAREN + rf"{S}++({NOT_S}.*)$",
}
ALONE_PATTERN = rf"(?s)^{_PAREN}{S}*+:?{S}*+$"


def _sql(value) -> str:
    """A constant as SQL text: strings, integers, lists, and dicts (as structs)."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in value.items()) + ")"
    return str(value)


def _constant(value, ddl: str) -> Column:
    """A constant table of any size as one string that is parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _without_total(label: str) -> str:
    return re.sub(r"^TOTAL\s+", "", label)


def label_tails(labels: dict[str, list[str]]) -> dict[str, list[str]]:
    """By label, what longer known labels have after it and a blank.

    'Notify' followed by 'Party/Intermediate Consignee' is a label, not a company: a
    captured text that begins one of these tails, or extends one, is a label fragment.
    """
    spelled = {x for xs in labels.values() for x in xs}
    known = sorted({x.upper() for x in spelled})
    tails = {}
    for label in spelled:
        stem = label.upper() + " "
        at, found = bisect.bisect_left(known, stem), []
        while at < len(known) and known[at].startswith(stem):
            found.append(known[at][len(stem):])
            at += 1
        tails[label] = found or [NO_TAIL]
    return tails


def is_label_fragment(captured: Column, tails: Column) -> Column:
    rest = F.upper(captured)
    return F.exists(tails, lambda t: t.startswith(rest) | F.startswith(rest, t))


def _label_lookup(labels: dict[str, list[str]]) -> tuple[str, Column]:
    """A pattern that finds the stem a line starts with, and stem -> labels it may mean.

    Stems are the shortest label beginnings, without TOTAL, so a line is tested by one
    pattern and then only against the labels its stem leaves possible.
    """
    stripped = {_without_total(x.upper()) for xs in labels.values() for x in xs}
    by_stem: dict[str, list[dict]] = {}

    def stem_of(text):
        return next((text[:n] for n in range(1, len(text) + 1) if text[:n] in by_stem), None)

    for text in sorted(stripped, key=lambda x: (len(x), x)):
        if stem_of(text) is None:
            by_stem[text] = []
    stems, tails = list(by_stem), label_tails(labels)
    for f, field in enumerate(V.FIELDS):
        for l, label in enumerate(labels[field]):
            entry = {"f": f, "l": l, "label": label, "upper": label.upper(), "tails": tails[label]}
            by_stem[stem_of(_without_total(label.upper()))].append(entry)
    # One TOTAL may stand before a label, and a label may begin with another.
    pattern = rf"(?i)^{S}*(?:TOTAL{S}+){{0,2}}(" + "|".join(_literal(s) for s in stems) + ")"
    return pattern, _constant(by_stem, "map<string,array<struct<f:int,l:int,label:string,upper:string,tails:array<string>>>>")


def computed_once(c: Column) -> Column:
    """Keep filters on a costly column above its projection.

    A predicate pushed through a projection takes a copy of the column's expression with
    it, and the work is done twice.  Nothing is pushed through an expression that is not
    deterministic; the condition is always true.  Unlike a row id, the number of the
    partition may stand in a stream too.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def doc_type(text: Column | str) -> Column:
    """SI, BL, OTHER or UNKNOWN from markers in the opening, foreign documents first."""
    text = F.col(text) if isinstance(text, str) else text
    opening = F.upper(F.substring(text, 1, V.DOC_TYPE_HEAD))

    def holds(markers):
        return reduce(lambda a, b: a | b, [opening.contains(m) for m in markers])

    return (
        F.when(holds(V.OTHER_MARKERS), "OTHER")
        .when(holds(V.SI_MARKERS), "SI")
        .when(holds(V.BL_MARKERS), "BL")
        .otherwise("UNKNOWN")
    )


#: The parts of a field's entry with their types, in order.
PARTS = dict(part.split(":") for part in FIELD_STRUCT[len("struct<"):-1].split(","))
NO_FORM = 4


def parts_struct(parts: tuple[str, ...] | None = None) -> str:
    """FIELD_STRUCT with the given parts only, in its order."""
    return "struct<" + ",".join(f"{name}:{t}" for name, t in PARTS.items() if parts is None or name in parts) + ">"


def _ascii_normalizers() -> dict:
    """By field, the built-in normaliser as a function of an ASCII string without line breaks.

    They equal those of `functions.normalize`, '' for unusable; None leaves a value to them.
    """
    # Bound here, so that the functions travel whole and executors need not have this library.
    suffixes, number, lb = set(V.CORPORATE_SUFFIXES), {w: str(n) for n, w in enumerate(V.NUMBER_WORDS, 1)}, V.LB_TO_KG
    kept = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    upper = {i: chr(i).upper() if chr(i).upper() in kept else " " for i in range(128)}
    upper_word = upper | {ord("_"): "_"}
    port_code, word, digits = re.compile(r"\([A-Z]{5}\)"), re.compile(r"[A-Z0-9_]+"), re.compile(r"0*([0-9]+)")
    amount, tonnes = re.compile(r"[0-9]+(?:\.[0-9]+)?"), re.compile(r"\b(?:MT|TON)\b|TONNE")

    def party(v):
        words = [w for w in v.partition("|")[0].translate(upper_word).split() if w not in suffixes]
        text = " ".join(words)
        return " ".join(text.replace("_", " ").split()) if "_" in text else text

    def port(v):
        if "(" in v:
            v = port_code.sub("", v)
        return " ".join(v.translate(upper).split())

    def count(v):
        s = v.replace(",", "").upper()
        said = [int(number[w]) for w in word.findall(s) if w in number]
        if said:
            return str(min(said))
        m = digits.search(s)
        return m[1] if m else ""

    def weight(v):
        s = v.replace(",", "").upper()
        m = amount.search(s)
        if m is None:
            return ""
        n = float(m[0])
        if "LB" in s:
            n *= lb
        if tonnes.search(s):
            n *= 1000
        return str(round(n)) if n < 1e15 else None  # beyond, digits depend on how a double is written

    by_text = {party_text: party, port_text: port, count_text: count, weight_text: weight}
    return {field: by_text[fn] for field, fn in NORMALIZERS.items()}


def _leaders(labels: dict[str, list[str]], exact_unicode: bool, parts: tuple[str, ...] | None = None):
    """Function of a text: the entries of its fields by their leading candidates, or that it is in doubt.

    Only the longest label of a line is looked at, as a shorter one captures a part of it. Where it
    fits no form although a shorter label of the field might, the candidate has NO_FORM and is not sure.
    A text with a candidate that is not sure, or whose value cannot be used, is `doubtful`: it has no
    entries, and `folded` where that differs from the text.
    """
    tails = {x: t for x, t in label_tails(labels).items() if t != [NO_TAIL]}
    owners: dict[str, list[tuple[int, int]]] = {}
    for f, field in enumerate(V.FIELDS):
        for l, label in enumerate(labels[field]):
            owners.setdefault(label.upper(), []).append((f, l))
    # by the beginning that all labels are long enough to have, longest first
    width = min(map(len, owners))
    opening: dict[str, list[str]] = {}
    for upper in sorted(owners, key=lambda x: (-len(x), x)):
        opening.setdefault(upper[:width], []).append(upper)
    known = [labels[f] for f in V.FIELDS]
    plain = lambda pattern: re.compile(re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", re.sub(r"\\x\{([0-9a-f]{2})\}", r"\\x\1", pattern)))
    forms = [(ALONE, plain(ALONE_PATTERN))] + [(k, plain(FORM_PATTERN[k])) for k in (COLON, WIDE, TIGHT)]
    # Bound here, so that the function travels whole and executors need not have this library.
    space, blanks, shown, fields = V.ASCII_SPACE, set(V.BLANKS), V.SNIPPET_CHARS, list(V.FIELDS)
    normalizers = [_ascii_normalizers()[f] for f in fields]
    trust, no_form, method, total, longest = dict(FORM_CONFIDENCE), NO_FORM, "rule", "TOTAL"[:width], max(map(len, V.BLANKS))
    alone, colon, wide, tight = ALONE, COLON, WIDE, TIGHT
    types = {n: {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[t] for n, t in PARTS.items() if parts is None or n in parts}
    missing = {"value": None, "raw": None, "confidence": 0.0, "line": -1, "label_seen": "", "snippet": ""}
    order = [n for n in ("value", "raw", "confidence", "line", "label_seen", "snippet") if n in types]
    nothing, shows = tuple(missing[n] for n in order), "snippet" in types
    every = order == list(missing)
    spot = [list(missing).index(n) for n in order]

    def label_of(line, upper):
        """(label, what stands after it) of a trimmed line that starts with one, TOTAL before it unless part of it."""
        for x in opening.get(upper[:width], ()):
            if upper.startswith(x):
                return x, line[len(x):]
        if upper.startswith("TOTAL") and upper[5:6] in space:
            after = upper[5:].lstrip(space)
            for x in opening.get(after[:width], ()):
                if after.startswith(x):
                    return x, line[len(line) - len(after) + len(x):]
        return None

    def form_of(rest):
        # the plain cases of the patterns, which say the same
        first = rest[:1]
        if first == ":":
            got = rest[1:].lstrip(space)
            return (colon, got) if got else (alone, None)
        if first in space:
            got = rest.lstrip(space)
            if not got:
                return alone, None
            if got[0] != "(" and got[0] != ":":
                return (wide if len(rest) - len(got) > 1 else tight), got
        for form, pattern in forms:
            m = pattern.match(rest)
            if m:
                return form, None if form == alone else m[1]
        return no_form, None

    def best_of(lines):
        """By field the least (label, form, line) with what it captured."""
        best = [None] * len(known)
        for i, line in enumerate(lines):
            line = line.strip(space)
            head = line[:width].upper()
            if head not in opening and not head.startswith(total):
                continue
            met = label_of(line, line.upper())
            if met:
                form, got = form_of(met[1])
                for f, l in owners[met[0]]:
                    if best[f] is None or (l, form, i) < best[f][:3]:
                        best[f] = (l, form, i, got)
        return best

    def entry(f, found, raw, lines):
        """The field's entry by its leading candidate, None where only a contest can tell."""
        l, form, at, got = found
        label = known[f][l]
        if form == alone:
            at += 1
            if at < len(lines) and not lines[at].strip(space):
                at += 1
            # a value on the next line, or the one after a blank line, must be indented
            if at < len(raw) and raw[at][:1].isspace():
                got = lines[at].strip(space)
        if got is None or got[:1] in ("|", ":"):
            return None
        # a blank stops the search; a value that cannot be used does not
        value = None
        core = got.strip("_").strip(space)
        if "___" in got or len(core) <= longest and core.upper() in blanks:
            if form == alone:
                return None
        else:
            value = normalizers[f](got)
            if not value:
                return None
        if label in tails:
            upper = got.upper()
            if any(t.startswith(upper) or upper.startswith(t) for t in tails[label]):
                return None
        snippet = (raw[at].strip()[:shown] if at < len(raw) else "") if shows else None
        whole = value, got, 0.0 if value is None else trust[form], at + 1, label, snippet
        return whole if every else tuple([whole[i] for i in spot])

    def entries(raw, lines):
        out = []
        for f, found in enumerate(best_of(lines)):
            got = nothing if found is None else entry(f, found, raw, lines)
            if got is None:
                return None
            out.append(got)
        return out

    @F.arrow_udf(f"struct<folded:string,doubtful:boolean,fields:array<{parts_struct(parts)}>>")
    def read(texts: pa.Array) -> pa.Array:
        folds, doubtful, starts, rows = [], [], [0], []
        for text in texts.to_pylist():
            fold = None
            if text is None:
                doubtful.append(False)
            else:
                folded = text
                if not text.isascii():
                    folded = unicodedata.normalize("NFKC", text) if exact_unicode else text
                    folded = folded.encode("ascii", "ignore").decode("ascii")
                lines = folded.split("\n")
                found = entries(lines if folded is text else text.split("\n"), lines)
                doubtful.append(found is None)
                if found is not None:
                    rows += found
                elif folded is not text:
                    fold = folded
            folds.append(fold)
            starts.append(len(rows))
        columns = dict(zip(order, zip(*rows))) if rows else {n: () for n in order}
        columns = {n: pa.array(c, types[n]) for n, c in columns.items()}
        if "field" in types:
            columns["field"] = pa.array(fields * (len(rows) // len(fields)), pa.string())
        if "method" in types:
            columns["method"] = pa.repeat(pa.scalar(method, pa.string()), len(rows))
        found = pa.StructArray.from_arrays([columns[n] for n in types], list(types))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found)
        return pa.StructArray.from_arrays([pa.array(folds, pa.string()), pa.array(doubtful, pa.bool_()), lists], ["folded", "doubtful", "fields"])

    return read


def _candidates(raw: Column, folded: Column, labels: dict[str, list[str]]) -> Column:
    """Every (label, form) a line of the document matches, as an array of candidates."""
    pattern, lookup = _label_lookup(labels)
    space = F.lit(V.ASCII_SPACE)

    marked = F.transform(
        folded,
        lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.regexp_extract(t, pattern, 1).alias("stem")),
    )
    hits = F.filter(marked, lambda h: h["stem"] != "")
    hits = F.transform(
        hits,
        lambda h: F.struct(
            h["i"].alias("i"), F.btrim(h["t"], space).alias("text"), F.upper(h["stem"]).alias("stem")
        ),
    )
    hits = F.transform(
        hits,
        lambda h: F.struct(
            h["i"].alias("i"), h["text"].alias("text"), h["stem"].alias("stem"), F.upper(h["text"]).alias("upper")
        ),
    )
    hits = F.transform(
        hits,
        lambda h: h.withField(
            "total", F.length(F.regexp_extract(h["upper"], rf"^TOTAL{S}+", 0))
        ),
    )

    return _forms(raw, folded, _read(hits, lambda h: F.element_at(lookup, h["stem"])))


def _read(hits: Column, entries) -> Column:
    """Each line with each of its entries that it starts with, and what the forms capture after the label.

    `hits` are structs with i, text, upper, and total, the length of a TOTAL before the label.
    """

    def with_rest(h, x):
        direct = F.startswith(h["upper"], x["upper"])
        start = F.when(direct, 1).otherwise(h["total"] + 1) + F.length(x["upper"])
        return F.struct(
            h["i"].alias("i"),
            x["f"].alias("f"),
            x["l"].alias("l"),
            x["label"].alias("label"),
            x["tails"].alias("tails"),
            F.substring(h["text"], start, F.length(h["text"])).alias("rest"),
        )

    def starts(h, x):
        direct = F.startswith(h["upper"], x["upper"])
        after_total = F.substring(h["upper"], h["total"] + 1, F.length(h["upper"]))
        return direct | ((h["total"] > 0) & F.startswith(after_total, x["upper"]))

    named = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(entries(h), lambda x: starts(h, x)), lambda x: with_rest(h, x))))
    return F.transform(
        named,
        lambda n: F.struct(
            n.alias("n"),
            n["rest"].rlike(ALONE_PATTERN).alias("alone"),
            *[F.regexp_extract(n["rest"], FORM_PATTERN[form], 1).alias(f"got_{form}") for form in (COLON, WIDE, TIGHT)],
        ),
    )


def _forms(raw: Column, folded: Column, read: Column) -> Column:
    """The candidates that lines with a label offer."""
    space = F.lit(V.ASCII_SPACE)

    def candidate(n, form, at, text, snippet_of):
        return F.struct(
            n["f"].alias("f"),
            n["l"].alias("l"),
            F.lit(form).alias("form"),
            n["i"].alias("i"),
            at.alias("at"),
            text.alias("raw"),
            F.substring(strip(snippet_of), 1, V.SNIPPET_CHARS).alias("snippet"),
            n["label"].alias("label"),
        )

    def forms(r):
        n = r["n"]
        here = F.get(raw, n["i"])
        out = []
        # a value on the next line, or the one after a blank line, must be indented
        next_one = F.btrim(F.get(folded, n["i"] + 1), space)
        step = F.when(next_one == "", 2).otherwise(1)
        next_raw = F.get(raw, n["i"] + step)
        next_text = F.btrim(F.get(folded, n["i"] + step), space)
        indented = (next_text != "") & next_raw.rlike(r"^(?U)[\s\x{1c}-\x{1f}]")
        wrapped = F.when(F.coalesce(indented, F.lit(False)), next_text)
        out.append(F.when(r["alone"], candidate(n, ALONE, n["i"] + step + 1, wrapped, next_raw)))
        for form in (COLON, WIDE, TIGHT):
            got = r[f"got_{form}"]
            usable = (got != "") & ~got.rlike(r"^[|:]") & ~is_label_fragment(got, n["tails"])
            out.append(F.when(usable, candidate(n, form, n["i"] + 1, got, here)))
        return F.filter(F.array(*out), lambda c: c.isNotNull())

    return F.flatten(F.transform(read, forms))


def _entry(field: Column, r: Column, value: Column, parts: tuple[str, ...] | None = None) -> Column:
    trust = F.when(r["form"] == ALONE, V.CONF_WRAP).when(r["form"] == COLON, V.CONF_COLON)
    trust = trust.when(r["form"] == WIDE, V.CONF_WIDE).otherwise(V.CONF_TIGHT)
    whole = {
        "field": field,
        "value": value,
        "raw": r["raw"],
        "confidence": F.when(value.isNull(), 0.0).otherwise(trust),
        "method": F.lit("rule"),
        "line": F.coalesce(r["at"], F.lit(-1)),
        "label_seen": F.coalesce(r["label"], F.lit("")),
        "snippet": F.coalesce(r["snippet"], F.lit("")),
    }
    return F.struct(*[c.alias(name) for name, c in whole.items() if parts is None or name in parts])


def _contest(found: Column, normalizers: dict | None = None) -> Column:
    """Winners per field among all candidates, each normalised."""
    # Only the first line a label stands alone on may offer a wrapped value.
    allowed = F.filter(
        found,
        lambda c: (c["form"] != ALONE)
        | (
            c["raw"].isNotNull()
            & ~F.exists(
                found,
                lambda d: (d["form"] == ALONE) & (d["f"] == c["f"]) & (d["l"] == c["l"]) & (d["i"] < c["i"]),
            )
        ),
    )
    names = F.expr(_sql(list(V.FIELDS)))
    valued = F.transform(
        allowed,
        lambda c: F.struct(
            c.alias("c"), is_blank(c["raw"]).alias("blank"), normalize(F.get(names, c["f"]), c["raw"], normalizers).alias("value")
        ),
    )
    # a placeholder after a label ends the search; a value that cannot be used does not
    return F.filter(valued, lambda v: v["value"].isNotNull() | (v["blank"] & (v["c"]["form"] != ALONE)))


def extract_fields(
    docs: DataFrame,
    text: str = "text",
    readable: Column | None = None,
    labels: dict[str, list[str]] | None = None,
    exact_unicode: bool = True,
    into: str = "fields",
    always_thorough: bool = False,
    normalizers: dict | None = None,
    parts: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add `into`: one entry per field, in field order, for every readable document.

    A field that was not found has NULL value and confidence 0; one whose label is
    followed by a placeholder keeps the placeholder in `raw`.  Unreadable or empty
    documents get an empty array.  `labels` replaces the built-in label lists (see
    `vocab.distinct_labels` for adding learned labels).

    Most documents are settled by the leading candidate of each field.  Only those where
    one of them turns out unusable have all candidates built and contested, which
    `always_thorough` forces; the outcome is the same.  `normalizers` (field -> function of
    a column) take the place of the built-in ones.  With `parts`, entries hold only these of
    the parts that FIELD_STRUCT names, so that no others need be built or travel.
    """
    labels = labels or V.distinct_labels()
    body = F.coalesce(F.col(text), F.lit(""))
    usable = ~is_empty(body)
    if readable is not None:
        usable = readable & usable
    step = docs.withColumn("_source", F.when(usable, body))

    if always_thorough or normalizers or not _ordered_by_length(labels):
        step = step.withColumn("_text", fold_ascii("_source", exact_unicode))
        doubtful, quick = F.col("_source").isNotNull(), None
    else:
        step = step.withColumn("_read", _leaders(labels, exact_unicode, parts)(F.make_valid_utf8("_source")))
        step = step.withColumn("_text", F.coalesce("_read.folded", "_source"))
        doubtful, quick = F.col("_read.doubtful"), F.col("_read.fields")

    split = lambda c: F.when(doubtful, F.split(c, "\n"))
    step = step.withColumns({"_raw": split("_source"), "_folded": split("_text")}).drop("_text")
    step = step.withColumn("_found", F.when(F.col("_raw").isNotNull(), _candidates(F.col("_raw"), F.col("_folded"), labels)))
    step = step.withColumn("_valid", _contest(F.col("_found"), normalizers)).drop("_found")
    step = step.withColumn(into, _settled(quick, F.col("_source").isNull(), parts))
    return step.drop("_source", "_raw", "_folded", "_read", "_valid")


def _settled(quick: Column | None = None, unread: Column | None = None, parts: tuple[str, ...] | None = None) -> Column:
    """The fields of a document: the least of its valid candidates by field, else the quick ones."""
    names = F.expr(_sql(list(V.FIELDS)))

    def winner(f):
        return F.array_min(F.filter("_valid", lambda v: v["c"]["f"] == f))

    winners = F.array(*[winner(f) for f in range(len(V.FIELDS))])
    thorough = F.transform(winners, lambda w, i: _entry(F.get(names, i), w["c"], w["value"], parts))
    none = F.array().cast(f"array<{parts_struct(parts)}>")
    unread = F.col("_raw").isNull() if unread is None else unread
    done = F.when(unread, none).when(F.col("_valid").isNotNull(), thorough)
    if quick is not None:
        done = done.otherwise(quick)
    return computed_once(done)


def _ordered_by_length(labels: dict[str, list[str]]) -> bool:
    """Whether, of two labels one of which begins with the other, the longer comes first."""
    for xs in labels.values():
        first: dict[str, int] = {}
        for i, x in enumerate(xs):
            first.setdefault(_without_total(x.upper()), i)
        for i, x in enumerate(xs):
            text = _without_total(x.upper())
            if any(first.get(text[:n], i) < i for n in range(1, len(text))):
                return False
    return True
