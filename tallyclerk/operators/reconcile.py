"""Field verdicts, record decisions, and reconciliation of any two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyclerk import vocab as V
from tallyclerk.operators.numbering import checkpointed, numbered

#: Copies of a row that are written out by one element of an array.
_COPIES = 4096
#: A key with more rows is not left to one task.
_HOT = 1 << 16

MATCH, MISMATCH, UNCERTAIN = "match", "mismatch", "uncertain"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def verdict(
    a_value: Column,
    b_value: Column,
    a_confidence: Column | None = None,
    b_confidence: Column | None = None,
    sides: tuple[str, str] = ("SI", "BL"),
    threshold: float = V.TRUST_THRESHOLD,
    equal: Column | None = None,
) -> Column:
    """(status, reason) of one field.

    An absent or untrusted value is uncertain, never a mismatch, so absence is tested
    before equality.
    """

    def said(status, reason=None):
        return F.struct(
            F.lit(status).alias("status"),
            (F.lit(None).cast("string") if reason is None else F.lit(reason)).alias("reason"),
        )

    def untrusted(confidence):
        return F.lit(False) if confidence is None else F.coalesce(confidence, F.lit(0.0)) < threshold

    same = (a_value == b_value) if equal is None else equal
    return (
        F.when(a_value.isNull(), said(UNCERTAIN, V.REASON_ABSENT.format(side=sides[0])))
        .when(b_value.isNull(), said(UNCERTAIN, V.REASON_ABSENT.format(side=sides[1])))
        .when(untrusted(a_confidence) | untrusted(b_confidence), said(UNCERTAIN, V.REASON_LOW_CONFIDENCE))
        .when(same, said(MATCH))
        .otherwise(said(MISMATCH))
    )


def field_verdicts(si: dict[str, Column], bl: dict[str, Column], threshold: float = V.TRUST_THRESHOLD) -> Column:
    """Array of (field, status, reason) in field order.

    Each side has the arrays `value` and `confidence` of its fields, so no more than these need travel.
    """
    sides = [[x[c] for c in ("value", "confidence")] for x in (si, bl)]
    out = []
    for i, field in enumerate(V.FIELDS):
        (a, a_trust), (b, b_trust) = [[F.get(c, F.lit(i)) for c in side] for side in sides]
        v = verdict(a, b, a_trust, b_trust, threshold=threshold)
        out.append(F.struct(F.lit(field).alias("field"), v["status"].alias("status"), v["reason"].alias("reason")))
    return F.array(*out)


def compare_documents(verdicts: Column, si_fields: Column | dict[str, Column], bl_fields: Column | dict[str, Column]) -> Column:
    """Array of (field, status, reason, si, bl): `field_verdicts` with what they are about.

    A side is the array of its fields, or the arrays of some of their parts by name.
    """

    def said(side, i):
        if isinstance(side, dict):
            return F.struct(*[F.get(c, F.lit(i)).alias(part) for part, c in side.items()])
        return F.get(side, F.lit(i))

    out = []
    for i in range(len(V.FIELDS)):
        v = F.get(verdicts, F.lit(i))
        out.append(F.struct(*[v[c].alias(c) for c in ("field", "status", "reason")], said(si_fields, i).alias("si"), said(bl_fields, i).alias("bl")))
    return F.array(*out)


def decide(statuses: list[Column], reasons: list[Column]) -> Column:
    """(status, review_reason) of a record: uncertainty outranks mismatch."""
    uncertain = any_of([s == UNCERTAIN for s in statuses])
    low = any_of([(s == UNCERTAIN) & F.coalesce(r.contains("confidence"), F.lit(False)) for s, r in zip(statuses, reasons)])
    mismatch = any_of([s == MISMATCH for s in statuses])
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(uncertain, "NEEDS_REVIEW").when(mismatch, "MISMATCH").otherwise("OK").alias("status"),
        F.when(uncertain & low, "low_confidence").when(uncertain, "missing_value").otherwise(none).alias("review_reason"),
    )


def decide_comparisons(comparisons: Column) -> Column:
    """`decide` over a comparison array in field order."""
    parts = [F.get(comparisons, F.lit(i)) for i in range(len(V.FIELDS))]
    return decide([p["status"] for p in parts], [p["reason"] for p in parts])


def decide_rows(rows: DataFrame, key: str) -> DataFrame:
    """`decide` over long rows (key, field, status, reason): one flag set per key.

    All three flags are combinable before the shuffle, so a hot key costs one row per task.
    """
    uncertain = F.col("status") == UNCERTAIN
    flags = rows.groupBy(key).agg(
        F.bool_or(uncertain).alias("u"),
        F.bool_or(uncertain & F.coalesce(F.col("reason").contains("confidence"), F.lit(False))).alias("low"),
        F.bool_or(F.col("status") == MISMATCH).alias("m"),
    )
    return flags.select(
        key,
        F.when(F.col("u"), "NEEDS_REVIEW").when(F.col("m"), "MISMATCH").otherwise("OK").alias("status"),
        F.when(F.col("u") & F.col("low"), "low_confidence").when(F.col("u"), "missing_value").alias("review_reason"),
    )


def mismatched_fields(comparisons: Column) -> Column:
    """Names of mismatching fields, sorted."""
    hit = F.filter(comparisons, lambda c: c["status"] == MISMATCH)
    return F.array_sort(F.transform(hit, lambda c: c["field"]))


def pair_rows(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Which row of `left` stands against which of `right`, within equal keys, at the least cost.

    Both tables hold `keys` and `values`, the latter in order of weight: a pair costs more the earlier its
    first difference stands (F values that agree in the first d cost F - d, a NULL agrees with a NULL only).
    Under this cost an assignment is cheapest if rows are paired inside the smallest group that holds both,
    so equal rows cancel by their counts, and then the rest meets in groups of F - 1, F - 2, ... leading
    values and at last of the key alone; inside a group rows pair in the order of their values, which keeps
    near numbers together. Every key pairs as many rows as its smaller side has.

    Returns one row per kind of pair: the keys, `<value>_a`, `<value>_b`, `in_a` and `in_b` (false where a
    row found no partner) and `n`, how many pairs are alike. Keys must not be NULL.

    All groups of a key lie inside it, so rows are dealt by key once and paired where they are. Keys with
    more than _HOT rows are told by a count first: their groups are no windows and their pairs are not listed,
    places come from exact row numbers, and rows meet by group and place, so a key that holds most rows is
    spread over all tasks. Both ways pair alike.
    """
    names = [f"_v{i}" for i in range(len(values))]

    def side(df, a, b):
        made = [F.col(v).alias(n) for v, n in zip(values, names)]
        return df.select(*keys, *made, F.lit(a).alias("_a"), F.lit(b).alias("_b"))

    rows = side(left, 1, 0).union(side(right, 0, 1))
    hot = checkpointed(rows.groupBy(*keys).count().filter(F.col("count") > _HOT).select(*keys))
    if hot.isEmpty():
        return _pair_in_place(rows, keys, values, names)
    # No more keys than rows by _HOT.
    hot = F.broadcast(hot)
    near = _pair_in_place(rows.join(hot, keys, "left_anti"), keys, values, names)
    return near.unionByName(_pair_spread(rows.join(hot, keys, "left_semi"), keys, values, names))


def _alike(counted: DataFrame, keys: list[str], values: list[str], names: list[str]) -> DataFrame:
    """Pairs of equal rows."""
    both = F.least("_a", "_b")
    made = [F.col(n).alias(f"{v}_{tag}") for v, n in zip(values, names) for tag in "ab"]
    return counted.filter(both > 0).select(*keys, *made, F.lit(True).alias("in_a"), F.lit(True).alias("in_b"), both.alias("n"))


def _unlike(counted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row for each one that no equal row cancels, and its `_side`, 0 or 1."""
    spare, block = F.abs(F.col("_a") - F.col("_b")), F.col("_block") * _COPIES
    return (
        counted.filter("_a <> _b")
        .select(*keys, *names, (F.col("_a") < F.col("_b")).cast("int").alias("_side"), spare.alias("_spare"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_spare") - 1) / _COPIES))))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(_COPIES - 1), F.col("_spare") - 1 - block))))
        .select(*keys, *names, "_side")
    )


def _pair_in_place(rows: DataFrame, keys: list[str], values: list[str], names: list[str]) -> DataFrame:
    """`pair_rows` of keys that one task may hold: what follows the first exchange stays in its tasks."""
    counted = rows.repartition(*keys).groupBy(*keys, *names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    rest = _unlike(counted, keys, names).withColumns({"_depth": F.lit(None).cast("int"), "_at": F.lit(0)})
    for depth in reversed(range(len(names))):
        group, unpaired = [*keys, *names[:depth]], F.col("_depth").isNull()
        order = Window.partitionBy(*group, "_open", "_side").orderBy(*names[depth:])
        rest = rest.withColumn("_open", unpaired).withColumn("_n", F.row_number().over(order))
        paired = F.col("_open")
        if depth:  # at last all rows have their places, with a partner or not
            whole = Window.partitionBy(*group)
            sizes = [F.count_if(F.col("_open") & (F.col("_side") == i)).over(whole).alias(f"_size{i}") for i in (0, 1)]
            rest = rest.select("*", *sizes)
            paired = paired & (F.col("_n") <= F.least("_size0", "_size1"))
        rest = rest.select(
            *keys, *names, "_side",
            F.when(paired, depth).otherwise(F.col("_depth")).alias("_depth"),
            F.when(paired, F.col("_n")).otherwise(F.col("_at")).alias("_at"))
    groups = [F.when(F.col("_depth") > i, F.col(n)).alias(f"_g{i}") for i, n in enumerate(names[:-1])]
    of = [F.col("_side") == i for i in (0, 1)]
    met = rest.groupBy(*keys, *groups, "_depth", "_at").agg(
        *[F.max(F.when(here, F.col(n))).alias(f"{v}_{tag}") for v, n in zip(values, names) for here, tag in zip(of, "ab")],
        *[F.bool_or(here).alias(f"in_{tag}") for here, tag in zip(of, "ab")])
    shown = [*keys, *[f"{v}_{tag}" for v in values for tag in "ab"], "in_a", "in_b"]
    pairs = met.groupBy(*shown).agg(F.count("*").alias("n"))
    return _alike(counted, keys, values, names).unionByName(pairs)


def _pair_spread(rows: DataFrame, keys: list[str], values: list[str], names: list[str]) -> DataFrame:
    """`pair_rows` of keys of any size."""
    counted = checkpointed(rows.groupBy(*keys, *names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")))

    def shown(a, b, n):
        made = [F.col(k) for k in keys]
        for v, name in zip(values, names):
            for tag, prefix in (("a", a), ("b", b)):
                made.append((F.col(prefix + name) if prefix is not None else F.lit(None).cast(counted.schema[name].dataType)).alias(f"{v}_{tag}"))
        return [*made, F.lit(a is not None).alias("in_a"), F.lit(b is not None).alias("in_b"), n.alias("n")]

    out = [_alike(counted, keys, values, names)]
    rest = _unlike(counted, keys, names)
    for depth in reversed(range(len(names))):
        placed = numbered(rest, "_side", *keys, *names, into="_n").withColumn("_group", F.struct(*keys, *names[:depth]))
        starts = placed.groupBy("_side", "_group").agg(F.min("_n").alias("_start"))
        placed = placed.join(starts, ["_side", "_group"]).withColumn("_at", F.col("_n") - F.col("_start"))

        def half(number, prefix):
            kept = [F.col(c).alias(prefix + c) for c in (*keys, *names)]
            return placed.filter(F.col("_side") == number).select("_group", "_at", F.lit(True).alias(f"{prefix}_in"), *kept)

        met = half(0, "a").join(half(1, "b"), ["_group", "_at"], "full_outer")
        pairs = met.filter("a_in AND b_in").select(
            *[F.col("a" + k).alias(k) for k in keys], *[F.col(p + n) for p in "ab" for n in names])
        pairs = pairs.groupBy(*pairs.columns).count()
        out.append(pairs.select(*shown("a", "b", F.col("count"))))
        alone = met.filter("a_in IS NULL OR b_in IS NULL")
        rest = alone.select(
            *[F.when(F.col("a_in"), F.col("a" + c)).otherwise(F.col("b" + c)).alias(c) for c in (*keys, *names)],
            F.when(F.col("a_in"), 0).otherwise(1).alias("_side"))
    left_over = rest.groupBy(*keys, *names, "_side").count()
    out.append(left_over.filter("_side = 0").select(*shown("", None, F.col("count"))))
    out.append(left_over.filter("_side = 1").select(*shown(None, "", F.col("count"))))
    return reduce(DataFrame.unionByName, out)


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    normalizers: dict | None = None,
    tolerances: dict[str, float] | None = None,
    sides: tuple[str, str] = ("left", "right"),
    pair_repeats: bool = False,
) -> DataFrame:
    """Reconcile two tables on `keys`, field by field.

    Returns per key one `<field>_status`, `<field>_reason`, both values, and the record's
    `status` and `review_reason`.  Keys on one side only come out as NEEDS_REVIEW, not as
    differences.  So does a key that a side holds more than once ('repeated_key', one row,
    no values of that side) and every row with a NULL in its key ('null_key', a row of its
    own): neither can be paired.  Each side has a row per key before the join, so no key is
    hot in it.

    With `pair_repeats`, rows of a repeated key are paired at the least cost instead (`pair_rows`;
    `fields` in order of weight), each pair has a verdict of its own, and a row without a partner comes
    out like a key of one side.  Rows that are alike in keys, fields and outcome are one, counted in `n`.
    """
    normalizers, tolerances = normalizers or {}, tolerances or {}
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()

    def side(df, tag):
        made = [normalizers[f](F.col(f)) if f in normalizers else F.col(f) for f in fields]
        return df.select(*keys, *[c.alias(f"{f}_{tag}") for c, f in zip(made, fields)])

    def per_key(df, tag):
        n = F.count("*")
        only = [F.when(n == 1, F.first(f"{f}_{tag}")).alias(f"{f}_{tag}") for f in fields]
        return df.filter(whole).groupBy(*keys).agg(*only, (n > 1).alias(f"_many_{tag}"))

    a, b = side(left, "a"), side(right, "b")
    if pair_repeats:
        plain = [df.filter(whole).toDF(*keys, *fields) for df in (a, b)]
        both = pair_rows(*plain, keys, fields).drop("in_a", "in_b").withColumns({"_many_a": F.lit(False), "_many_b": F.lit(False)})
        a, b = (df.groupBy(*df.columns).agg(F.count("*").alias("n")) for df in (a.filter(~whole), b.filter(~whole)))
    else:
        both = per_key(a, "a").join(per_key(b, "b"), keys, "full_outer")
    both = both.withColumn("_null_key", F.lit(False))
    for df in (a, b):
        both = both.unionByName(df.filter(~whole).withColumn("_null_key", F.lit(True)), allowMissingColumns=True)
    for f in fields:
        a, b = F.col(f"{f}_a"), F.col(f"{f}_b")
        equal = (F.abs(a - b) <= F.lit(tolerances[f])) if f in tolerances else None
        both = both.withColumn(f"_{f}", verdict(a, b, sides=sides, equal=equal))
    outcome = decide([F.col(f"_{f}")["status"] for f in fields], [F.col(f"_{f}")["reason"] for f in fields])
    columns = [F.col(k) for k in keys]
    for f in fields:
        columns += [
            F.col(f"{f}_a"),
            F.col(f"{f}_b"),
            F.col(f"_{f}")["status"].alias(f"{f}_status"),
            F.col(f"_{f}")["reason"].alias(f"{f}_reason"),
        ]
    many = F.coalesce("_many_a", F.lit(False)) | F.coalesce("_many_b", F.lit(False))
    odd = F.when(F.col("_null_key"), "null_key").when(many, "repeated_key")
    return both.withColumn("_o", outcome).select(
        *columns,
        F.when(odd.isNotNull(), "NEEDS_REVIEW").otherwise(F.col("_o.status")).alias("status"),
        F.coalesce(odd, F.col("_o.review_reason")).alias("review_reason"),
        *(["n"] if pair_repeats else []),
    )
