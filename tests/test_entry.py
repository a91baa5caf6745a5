"""All registered queries against their SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare, connect

# What the tables really have no rows for at this scale.
EMPTY_AT_THIS_SCALE = ()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_flagship_has_rows_and_a_stable_schema(spark, sf):
    rows = entry.entry(spark)
    assert rows.columns == ["nu_ano", "total", "media"]
    assert len(rows.collect()) == 7


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    problem = compare(registry.QUERIES[name](spark, sf), con.sql(registry.ORACLE[name]))
    if name in EMPTY_AT_THIS_SCALE:
        assert problem == "empty on both sides"
    else:
        assert problem is None, problem


def test_the_comparison_sees_differences(spark, con):
    rows = spark.createDataFrame([(1, "a")], "x bigint, y string")
    assert compare(rows, con.sql("select 1::bigint as x, 'a' as y")) is None
    assert "vs" in compare(rows, con.sql("select 2::bigint as x, 'a' as y"))
    assert "types" in compare(rows, con.sql("select 1.0::double as x, 'a' as y"))
    assert "columns" in compare(rows, con.sql("select 1::bigint as x, 'a' as z"))
    assert "rows" in compare(rows, con.sql("select 1::bigint as x, 'a' as y union all select 1, 'a'"))
