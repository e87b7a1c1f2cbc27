"""Every key with SQL meaning equals its DuckDB oracle (row count, column
names, order-insensitive values) — the driver's correctness gate, run here
at sf0.001 (path-bound keys at sf0.01)."""

import pytest

from conftest import SF_ORACLE, SF_SMALL

import __spark_entry__ as E
from oracle_check import digest, duck

ORACLE = E.oracle_sql()
PATH_BOUND = {"file_inventory", "stage_manifest_check", "late_contents"}


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_ORACLE: duck(SF_ORACLE)}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(spark, cons, key):
    sf = SF_ORACLE if key in PATH_BOUND else SF_SMALL
    df = E.queries()[key](spark, sf)
    s_rows = [tuple(r) for r in df.collect()]
    rel = cons[sf].sql(ORACLE[key])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]


def test_every_key_has_a_callable(entry):
    from quarry.plans import registry
    q = entry.queries()
    assert set(ORACLE) <= set(q)
    rows_only = set(registry.QUERIES) - set(registry.ORACLE)
    assert rows_only == {"classify_model"}


def test_entry_smoke(spark, entry):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["customer_region", "article_category", "total_revenue", "unique_customers", "units_sold"]
