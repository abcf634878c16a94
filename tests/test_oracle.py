"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from arrears.checks.compare import compare
from arrears.registry import REGISTRY
from conftest import SF_SMALL

QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
ORACLE = {name: sql for name, (_, sql) in REGISTRY.items()}


def test_every_query_has_an_oracle():
    assert all(ORACLE.values())
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(QUERIES[name](spark, SF_SMALL), duck_small, ORACLE[name])
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "contact_channel" in df.columns


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, duck_small, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in sdf.schema.fields}
    rel = duck_small.sql(ORACLE[name])
    assert st == {c: str(t) for c, t in zip(rel.columns, rel.types)}
