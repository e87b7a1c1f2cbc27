"""Golden micro-tables (FIXTURES.md A.3): policy leak, rank ties, CSV
tokens/abort/rejects, returns with NULL, chunk edge cases, stage files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.policy import ADMIN_ROLES, ROLE_A, ROLE_B, apply_policy, entitlements
from quarry.plans.verified import extremes
from quarry.sources import csv as C
from quarry.sources.files import file_inventory, manifest_check


# --- policy_two_rows (D2, R1–R3) --------------------------------------------

@pytest.fixture
def two_rows(spark):
    fact = spark.createDataFrame([(1, 10.0), (2, 20.0)], "article_id long, total_price double")
    arts = spark.createDataFrame([(1, "PROMO"), (2, "SMALL")], "article_id long, article_category string")
    return fact, arts


def test_policy_roles(spark, two_rows):
    fact, arts = two_rows
    ids = lambda df: sorted(r.article_id for r in df.collect())
    assert ids(apply_policy(spark, None, fact, ADMIN_ROLES[0], articles=arts)) == [1, 2]
    assert ids(apply_policy(spark, None, fact, ROLE_A, articles=arts)) == [1]
    assert ids(apply_policy(spark, None, fact, ROLE_B, articles=arts)) == [2]
    assert ids(apply_policy(spark, None, fact, "SOMEONE", articles=arts)) == []


def test_unqualified_correlated_predicate_leaks(spark, two_rows):
    """Why the policy is a semi join: written unqualified, the inner table
    captures ``article_id`` and every row passes (the reference's form)."""
    fact, arts = two_rows
    fact.createOrReplaceTempView("mt_fact")
    arts.createOrReplaceTempView("mt_art")
    leaked = spark.sql("SELECT * FROM mt_fact WHERE EXISTS (SELECT 1 FROM mt_art da "
                       "WHERE da.article_id = article_id AND da.article_category = 'PROMO')").count()
    assert leaked == 2
    assert apply_policy(spark, None, fact, ROLE_A, articles=arts).count() == 1


def test_secure_view_follows_session_variable(spark):
    from conftest import SF_SMALL
    from quarry.operators.policy import secure_fact_view
    from quarry.sources import tables as T

    view = secure_fact_view(spark, SF_SMALL)
    expected = apply_policy(spark, SF_SMALL, T.fact_sales(spark, SF_SMALL), ROLE_A).count()
    spark.sql(f"SET VAR quarry_role = '{ROLE_A}'")
    assert spark.table(view).count() == expected
    spark.sql("SET VAR quarry_role = 'NOBODY'")
    assert spark.table(view).count() == 0
    spark.sql(f"SET VAR quarry_role = '{ADMIN_ROLES[1]}'")
    assert spark.table(view).count() == T.fact_sales(spark, SF_SMALL).count()


def test_entitlements_small(spark):
    assert entitlements(spark).count() == 3


# --- sales_ties (W1–W3) -----------------------------------------------------

def _labels(df):
    return {r["p"]: r["performance_category"] for r in df.collect()}


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("A", 100.0), ("B", 100.0), ("C", 50.0), ("D", None)], "p string, v double")
    assert _labels(extremes(df, "v")) == {"A": "Highest", "B": "Highest", "C": "Lowest"}


def test_rank_single_and_all_null(spark):
    one = spark.createDataFrame([("A", 7.0)], "p string, v double")
    assert _labels(extremes(one, "v")) == {"A": "Highest"}
    nulls = spark.createDataFrame([("A", None), ("B", None)], "p string, v double")
    assert _labels(extremes(nulls, "v")) == {"A": "Highest", "B": "Highest"}


# --- csv_tokens (S2, K7, K8) --------------------------------------------------

SPEC = C.CsvSpec(columns=(("id", "bigint"), ("name", "string"), ("price", "decimal(10,2)"), ("d", "date")),
                 header=True, multiline=True)


def _write(text):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    with open(os.path.join(d, "f.csv"), "w") as fh:
        fh.write(text)
    return d


def test_csv_tokens_quotes_and_linebreaks(spark):
    path = _write('id,name,price,d\n'
                  '1,"a, b",1.50,2020-01-02\n'
                  '2,"say ""hi""", NULL ,\n'
                  '3,"two\nlines",None,2021-03-04\n'
                  '4, null ,,2021-03-05\n')
    rows = {r.id: r for r in C.read_typed(spark, path, SPEC).collect()}
    assert rows[1].name == "a, b" and str(rows[1].price) == "1.50"
    assert rows[2].name == 'say "hi"' and rows[2].price is None and rows[2].d is None
    assert rows[3].name == "two\nlines" and rows[3].price is None
    assert rows[4].name is None


def test_csv_bad_field_aborts_and_is_rejected(spark):
    path = _write('id,name,price,d\n1,x,12.00,2020-01-01\n2,y,abc,2020-01-01\n3,z,1.00,notadate\n')
    with pytest.raises(Exception):
        C.read_typed(spark, path, SPEC).collect()
    good, rejects = C.split_rejects(spark, path, SPEC, "id")
    assert [r.id for r in good.collect()] == [1]
    rej = sorted((r.id, r.raw_value) for r in rejects.collect())
    assert rej == [(2, "abc"), (3, "notadate")]


def test_csv_gzip_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="quarry-gz-")
    df = spark.createDataFrame([("1", "a", "2.50", "2020-01-01")], "id string, name string, price string, d string")
    C.write_csv(df, d, header=True, gzip=True)
    assert any(f.endswith(".csv.gz") for f in os.listdir(d))
    r = C.read_typed(spark, d, SPEC).collect()[0]
    assert r.id == 1 and str(r.price) == "2.50"


# --- returns_nulls (P4, A6) -------------------------------------------------

def test_is_return_false_drops_null(spark):
    df = spark.createDataFrame([(1, True, 10.0, 1), (2, False, 20.0, 0), (3, None, 30.0, 2)],
                               "id int, is_return boolean, price double, qty int")
    kept = df.filter(F.col("is_return") == F.lit(False))
    assert [r.id for r in kept.collect()] == [2]
    ratio = df.agg(F.avg(F.col("price") / F.nullif(F.col("qty"), F.lit(0))).alias("a")).collect()[0].a
    assert ratio == pytest.approx((10.0 + 15.0) / 2)


# --- chunk_texts (T2, P8) ---------------------------------------------------

TEXTS = ["", "x", "a" * 1500, "b" * 1501, "w" * 3200, "# Title\n\nPara one.\n\n## Sub\n\n" + "é" * 2000,
         "😀" * 1600 + " end"]


def test_fixed_chunks_cover_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    rows = df.select("id", "t", X.fixed_chunks("t").alias("c")).collect()
    for r in rows:
        chunks = [c for c in r.c if c]
        assert all(len(c) <= X.CHUNK_SIZE for c in chunks)
        if r.t:
            rebuilt = chunks[0] + "".join(c[X.CHUNK_OVERLAP:] for c in chunks[1:])
            assert rebuilt == r.t
        else:
            assert chunks == []


def test_line_chunks_bounded(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    for r in df.select(X.line_chunks("t").alias("c")).collect():
        assert all(len(c) <= X.CHUNK_SIZE for c in r.c)


def test_recursive_chunks(spark):
    md = "# A\n\n" + "x " * 900 + "\n# B\n\n" + "y " * 900
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, md, "w" * 4000, None])], "id int, t string")
    rows = df.select("id", X.recursive_chunks("t").alias("c")).collect()
    for r in rows[:-1]:
        assert all(0 < len(c) <= X.CHUNK_SIZE for c in r.c)
    for r, t in zip(rows, TEXTS):
        assert bool(r.c) == bool(t.strip(" \t\r\n"))
    assert rows[len(TEXTS)].c[0].startswith("# A") and any("# B" in c for c in rows[len(TEXTS)].c[1:])
    words = rows[len(TEXTS) + 1].c
    assert words[0] == "w" * 1400 and words[1] == "w" * 1500 and "".join([words[0], *(w[100:] for w in words[1:])]) == "w" * 4000


# --- stage_files (S5–S9, P5) ---------------------------------------------------

def test_file_inventory_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="quarry-stage-")
    for name in ["a.pdf", "b.PDF", "c.jpeg", "d.jpg", "e.png", "f.txt"]:
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(b"0123456789")
    pdfs = file_inventory(spark, d, "*.[pP][dD][fF]")
    assert sorted(r.file_name for r in pdfs.collect()) == ["a.pdf", "b.PDF"]
    st = {r.file_name: r.status for r in manifest_check(spark, d, ["a.pdf", "b.PDF", "zz.pdf"], "*.[pP][dD][fF]").collect()}
    assert st == {"a.pdf": "present", "b.PDF": "present", "zz.pdf": "missing"}


def test_read_contents_and_copy_by_manifest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name in ["a.pdf", "b.jpg", "c.txt"]:
        (src / name).write_bytes(name.encode())
    manifest = spark.createDataFrame([("a.pdf", "BIKE"), ("b.jpg", "SNOW"), ("zz.pdf", "BIKE")],
                                     "file_name string, stage string")
    from quarry.sources.files import copy_by_manifest, read_contents
    got = {r.file_name: bytes(r.content) for r in read_contents(spark, str(src), manifest).collect()}
    assert got == {"a.pdf": b"a.pdf", "b.jpg": b"b.jpg"}
    missing = copy_by_manifest(spark, str(src), manifest, str(tmp_path / "dst"))
    assert [r.file_name for r in missing.collect()] == ["zz.pdf"]
    copied = spark.read.parquet(str(tmp_path / "dst"))
    assert sorted((r.file_name, r.stage) for r in copied.collect()) == [("a.pdf", "BIKE"), ("b.jpg", "SNOW")]


def test_search_preview_request(spark):
    import json
    from conftest import SF_SMALL
    from quarry.operators.search import index_of, search_preview
    from quarry.sources import tables as T
    docs = T.read(spark, SF_SMALL, "documents")
    idx = index_of(spark, SF_SMALL, "documents")
    text = docs.filter("lang = 'en'").select("text").head()[0][:200]
    req = json.dumps({"query": text, "columns": ["source", "lang"], "limit": 3, "filter": {"lang": "en"}})
    out = json.loads(search_preview(idx, spark, req).collect()[0].results)
    assert 1 <= len(out) <= 3 and [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert all(r["lang"] == "en" for r in out)


def test_outbox_write(spark, tmp_path):
    from quarry.operators.analytics import write_outbox
    df = spark.createDataFrame([("EUROPE", "s", "b", 1)], "customer_region string, subject string, body string, word_count int")
    write_outbox(df, str(tmp_path / "outbox"))
    write_outbox(df, str(tmp_path / "outbox"))
    assert spark.read.parquet(str(tmp_path / "outbox")).count() == 1


# --- negative / resolution checks -------------------------------

def test_ambiguous_synonyms_resolve_by_priority(spark):
    from quarry.plans.model_ops import resolve_synonyms
    texts = spark.createDataFrame([("Show revenue and items sold by brand",), ("revenue per region",)], "text string")
    got = {r.word: (r.kind, r.target, r.occurrences) for r in resolve_synonyms(spark, texts, "text").collect()}
    assert got["revenue"] == ("metric", "total_revenue", 2)        # not the fact total_price
    assert got["items sold"] == ("metric", "units_sold", 1)        # not the dimension quantity_sold
    assert got["brand"] == ("dimension", "article_brand", 1)
    assert got["region"] == ("dimension", "customer_region", 1)


def test_validation_flags_duplicate_dimension_key(spark):
    from dataclasses import replace
    from conftest import SF_SMALL
    from quarry.plans import semantic as S
    from quarry.plans.model_ops import validate_model
    from quarry.sources import tables as T

    def dup_articles(spark, sf_dir, columns=None, **_):
        df = T.dim_article(spark, sf_dir)
        df = df.unionByName(df.limit(1))
        return df.select(*columns) if columns else df

    tables = dict(S.SALES_MODEL.tables)
    tables["dim_article"] = S.Table("dim_article", ("article_id",), dup_articles)
    bad = replace(S.SALES_MODEL, tables=tables)
    res = {r.check_name: r.violations for r in validate_model(spark, SF_SMALL, bad).collect()}
    assert res["primary_key:dim_article.article_id"] == 1
    assert res["many_to_one:fact_sales_to_dim_article"] == 1
    good = {r.check_name: r.violations for r in validate_model(spark, SF_SMALL).collect()}
    assert good["primary_key:dim_article.article_id"] == 0


def test_approximate_distinct_close_to_exact(spark):
    from conftest import SF_SMALL
    from quarry.plans.semantic import semantic_query
    exact = semantic_query(spark, SF_SMALL, ["unique_customers"]).collect()[0][0]
    approx = semantic_query(spark, SF_SMALL, ["unique_customers"], approximate_distinct=True).collect()[0][0]
    assert abs(approx - exact) <= max(2, 0.05 * exact)


def test_synonyms_match_oracle_sql_on_fixture(spark):
    """The driver data holds no model vocabulary, so the key is empty there;
    here the Spark plan and its oracle SQL run on turns that do."""
    import duckdb
    from quarry.plans.model_ops import _sql_synonyms, resolve_synonyms
    rows = [(1, 0, "user", "Show revenue and items sold by brand"),
            (1, 1, "user", "revenue per region and sales channel"),
            (2, 0, "assistant", "revenue"), (3, 0, "user", "AOV by customer tier, age")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    s = sorted(tuple(r) for r in resolve_synonyms(spark, df.filter("role = 'user'"), "text").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    d = sorted(tuple(r) for r in con.sql(_sql_synonyms()).fetchall())
    assert s == d and len(s) == 11


def test_keyword_classes_match_sql_form(spark):
    import duckdb
    names = ["Mondracer_Infant_Bike.pdf", "Premium_Bicycle.jpeg", "XTREME-road.PNG", "Carver_Skis.pdf",
             "Ski_Boots_TDBootz.jpg", "downhill notes", "snowboard"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    s = {r.name: r.c for r in df.select("name", X.keyword_class("name").alias("c")).collect()}
    assert s["Mondracer_Infant_Bike.pdf"] == "BIKE" and s["XTREME-road.PNG"] == "BIKE"
    assert s["Carver_Skis.pdf"] == "SNOW" and s["snowboard"] == "SNOW"
    con = duckdb.connect()
    con.execute("CREATE TABLE f(name VARCHAR)")
    con.executemany("INSERT INTO f VALUES (?)", [(n,) for n in names])
    d = dict(con.sql(f"SELECT name, {X.sql_keyword_class('name')} FROM f").fetchall())
    assert s == d


def test_orphans_and_duplicates_with_a_hot_key(spark):
    from quarry.operators.quality import duplicate_keys, orphans
    # key 1 holds a third of the child rows; keys 7 and 8 have no parent
    child = spark.createDataFrame([(1,)] * 30 + [(k,) for k in range(2, 62)] + [(7,), (8,), (None,)], "fk long")
    parent = spark.createDataFrame([(k,) for k in range(1, 62) if k not in (7, 8)], "pk long")
    r = orphans(child, "fk", parent, "pk").collect()[0]
    assert (r.orphan_keys, r.orphans) == (2, 4)
    d = duplicate_keys(child.filter("fk IS NOT NULL"), ["fk"]).collect()[0]
    assert (d.duplicate_keys, d.surplus_rows) == (3, 29 + 1 + 1)


def test_csv_rejects_survive_bad_keys_and_short_records(spark, tmp_path):
    from quarry.sources.csv import CsvSpec, read_typed, split_rejects
    (tmp_path / "a.csv").write_text("1,x,2.50\nbad,y,3.00\n3\n4,z,n/a\n5,w,7.25,extra\n6,v,NULL\n")
    spec = CsvSpec(columns=(("id", "bigint"), ("name", "string"), ("price", "decimal(10,2)")))
    good, rejects = split_rejects(spark, str(tmp_path), spec, "id")
    assert sorted(r["id"] for r in good.collect()) == [1, 6]
    got = {(r["id"], r["raw_value"], r["reason"]) for r in rejects.collect()}
    assert (None, "bad", "id: not a bigint") in got and (4, "n/a", "price: not a decimal(10,2)") in got
    assert (3, "3", "wrong number of fields") in got and (5, "5,w,7.25,extra", "wrong number of fields") in got
    with pytest.raises(Exception):
        read_typed(spark, str(tmp_path), spec).collect()


def test_profile_keeps_all_digits(spark):
    from quarry.plans.model_ops import profile_table
    df = spark.createDataFrame([(9007199254740992, None), (9007199254740993, "b")], "n bigint, s string")
    for exact in (True, False):
        got = {r.column_name: r for r in profile_table(df, "t", ["n", "s"], exact).collect()}
        assert (got["n"].min_value, got["n"].max_value, got["n"].distinct_values) == ("9007199254740992", "9007199254740993", 2)
        assert (got["s"].nulls, got["s"].distinct_values, got["s"].max_value) == (1, 1, "b")


def test_exact_ranks_equal_a_full_sort(spark):
    import random
    from quarry.operators.term_index import exact_ranks
    rng = random.Random(2)
    rows = [(q, d, round(rng.random(), 1)) for q in range(3) for d in range(300) if rng.random() < 0.8]
    scores = spark.createDataFrame(rows, "query_id int, doc_id bigint, score double")
    asked = [(q, d) for q in range(3) for d in range(0, 300, 7)]
    marks = scores.join(spark.createDataFrame(asked, "query_id int, doc_id bigint"), ["query_id", "doc_id"])
    got = {(r.query_id, r.doc_id): r["rank"] for r in exact_ranks(scores, marks).collect()}
    want = {}
    for q in range(3):
        for i, (_, d) in enumerate(sorted((-s, d) for x, d, s in rows if x == q)):
            if (q, d) in set(asked):
                want[(q, d)] = i + 1
    assert got == want


def test_missing_checkpoint_dir_is_an_error_off_local_mode():
    from quarry.session import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
