"""Registered queries against their SQL on the smallest given tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from tallyclerk.plans import queries_check, queries_text, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def computed_once(spark):
    """The check, the extraction and the joined truth are run once for all queries that begin with them."""
    kept, own = {}, {n: getattr(queries_check, n) for n in ("results", "_field_rows", "scored", "checked")}

    def once(name):
        def run(s, sf):
            if name not in kept:
                kept[name] = own[name](s, sf).persist()
            return kept[name]

        return run

    for name in own:
        setattr(queries_check, name, once(name))
    yield
    for name, fn in own.items():
        setattr(queries_check, name, fn)
    for df in kept.values():
        df.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    problem, _, _ = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLES.get(name), SF)
    assert problem is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())
