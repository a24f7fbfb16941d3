"""A JSON object read by byte ranges."""

import json

import pytest

from tallyclerk.sources import inbox as S
from tallyclerk.sources.keyed import read_keyed

ODD = ['a "quoted" } brace', "back\\slash\\", "{open", "}}}", "line\nbreak {\"x\": 1}", "", "ünïcödé } 文字", "\\\"}"]


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def truth(n):
    return {
        f"email_{i} }} {ODD[i % len(ODD)]}": {
            "category": ODD[i % len(ODD)], "status": ["OK", None][i % 2], "review_reason": ODD[(i * 3 + 1) % len(ODD)] * (1 + i % 40),
            "has_defect": i % 3 == 0, "defect_fields": [ODD[(i + j) % len(ODD)] for j in range(i % 4)], "decided_by": "rule"}
        for i in range(n)}


@pytest.mark.parametrize("form", [{"indent": 1}, {"indent": None, "separators": (",", ":")}, {"ensure_ascii": False}])
def test_equals_the_json_reader(spark, tmp_path, small_ranges, form):
    want, path = truth(300), tmp_path / "truth.json"
    path.write_text(json.dumps(want, **form), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    got = {r["email_id"]: {c: r[c] for c in r.asDict() if c != "email_id"} for r in S.read_records(spark, str(path)).collect()}
    assert got == want


def test_nested_values_and_repeated_keys(spark, tmp_path, small_ranges):
    path = tmp_path / "nested.json"
    entries = [f'"k{i % 70}": {{"n": {i}, "in": {{"x": {{"y": "}}{i}"}}, "l": [{{"z": 1}}, {{"z": {i}}}]}}}}' for i in range(100)]
    path.write_text("  {" + " ,\n".join(entries) + "}\n")
    rows = read_keyed(spark, str(path), "n bigint, `in` struct<x:struct<y:string>,l:array<struct<z:bigint>>>", "k").collect()
    want = json.loads(path.read_text())
    assert {r.k: r.asDict(True) for r in rows} == {k: {"k": k, **v} for k, v in want.items()}


@pytest.mark.parametrize("text", ["", "{}", " { } \n"])
def test_nothing(spark, tmp_path, text):
    path = tmp_path / "none.json"
    path.write_text(text)
    assert read_keyed(spark, str(path), "a string").collect() == []
