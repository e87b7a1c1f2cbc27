import datetime as dt
from decimal import Decimal

import pytest

from quarry.plans.model_ops import PROFILE, profile_table

ROWS = [(2**62 + 1, "b", Decimal("1.50"), dt.date(2001, 1, 2), True), (2**62 + 3, "a", Decimal("10.00"), None, None),
        (None, "b", Decimal("1.50"), dt.date(1999, 1, 2), True), (5, "a", None, None, False)]
SCHEMA = "n bigint, s string, d decimal(10,2), t date, f boolean"


@pytest.mark.parametrize("exact", [True, False])
def test_most_frequent_values_and_typed_bounds(spark, exact):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = profile_table(df, "t", df.columns, exact)
    assert out.columns == list(PROFILE)
    got = {r.column_name: (r.nulls, r.distinct_values, r.min_value, r.max_value, r.top_count) for r in out.collect()}
    assert got == {"n": (1, 3, "5", str(2**62 + 3), 1), "s": (0, 2, "a", "b", 2), "d": (1, 2, "1.50", "10.00", 2),
                   "t": (2, 2, "1999-01-02", "2001-01-02", 1), "f": (1, 2, "false", "true", 2)}
    top = {r.column_name: r.top_value for r in out.collect()}
    assert top["d"] == "1.50" and top["f"] == "true"
    if exact:
        assert top["s"] == "a" and top["n"] == str(2**62 + 1) and top["t"] == "1999-01-02"     # ties: the least as text


@pytest.mark.parametrize("exact", [True, False])
def test_tables_without_rows(spark, exact):
    df = spark.createDataFrame([], "n bigint, s string")
    assert sorted(tuple(r) for r in profile_table(df, "t", df.columns, exact).collect()) == [
        ("t", "n", 0, 0, None, None, None, 0), ("t", "s", 0, 0, None, None, None, 0)]


def test_one_scan_a_table(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = profile_table(df, "t", df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
