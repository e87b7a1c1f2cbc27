"""
products, no unpartitioned window on base rows, pushed filters, grouped
top-k as WindowGroupLimit, BM25 aggregation without a pair shuffle."""

import pytest

from conftest import SF_SMALL

from quarry.plans import registry

registry.load_all()
Q = registry.QUERIES
SIDE_EFFECT_KEYS = {"csv_ingest", "csv_null_tokens", "csv_rejects", "load_dim_article", "load_dim_customer", "load_fact_sales", "load_comments", "directory_changes",
                     "refresh_incremental", "refresh_changes", "dense_ids"}


def plan(spark, key, mode="formatted"):
    df = Q[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString() if mode == "exec" else _explain(df)


def _explain(df):
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_policy_is_a_semi_join(spark):
    assert "LeftSemi" in plan(spark, "row_policy_role_a")
    assert "LeftSemi" not in plan(spark, "row_policy_admin")


@pytest.mark.parametrize("key", sorted(set(Q) - SIDE_EFFECT_KEYS))
def test_no_cartesian_products(spark, key):
    p = plan(spark, key)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_date_bounds_pushed_to_scan(spark):
    p = plan(spark, "product_revenue_year")
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p


def test_grouped_topk_uses_window_group_limit(spark):
    for key in ("top_n_per_category", "search_topk", "vector_topk", "themes_by_product"):
        assert "WindowGroupLimit" in plan(spark, key), key


def test_search_reads_only_its_terms(spark):
    """A request of two words: its buckets' folders, its terms in the scan's filter, and no
    grouping of the frequent word's postings beyond them."""
    import re
    from quarry.operators import search as S, term_index as TI
    index = S.index_of(spark, SF_SMALL, "documents")
    words = [r.term for r in index.lexicon().orderBy("df", "term").limit(2).collect()]
    asked = TI.batch(spark.createDataFrame([(0, " ".join(words))], "item_id long, text string"), "item_id", "text")
    p = _explain(TI.search(index, asked, 3))
    buckets = re.findall(r"PartitionFilters: \[.*?bucket#\d+ IN(?:SET)? \(?([\d, ]+)\)?", p)
    assert buckets and all(len(b.split(",")) <= 2 < index.buckets for b in buckets)
    assert re.search(r"PushedFilters: \[.*In\(term, \[", p)


def test_scan_prunes_columns(spark):
    """Only used columns are read, and no raw row is shuffled by number."""
    import re
    p = plan(spark, "category_product_sales")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    li = [s for s in schemas if "l_partkey" in s]
    assert li
    cols = {c.split(":")[0] for c in li[0].split(",")}
    assert cols <= {"l_partkey", "l_extendedprice"}
    assert "REPARTITION_BY_NUM" not in p
