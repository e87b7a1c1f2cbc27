"""Base-table loaders and the star-schema binding views.

The driver data is TPC-H shaped; the reference's star schema
(``dim_article``, ``dim_customer``, ``fact_sales``, feedback comments) is
bound onto it by pure projections and joins, so every downstream plan is an
ordinary DataFrame plan that Catalyst can prune and push down through.

Scale notes
-----------
* ``region`` (5 rows) and ``nation`` (25 rows) are fixed-size by the TPC-H
  specification; the customer's region is a lookup in a 25-entry map.
* ``part`` and ``customer`` grow with the data; they are *not* forced into a
  broadcast. Spark's size-checked join selection (statistics plus AQE's
  runtime sizes against ``spark.sql.autoBroadcastJoinThreshold``) decides.
* ``fact_sales`` joins ``orders`` only when an order-level column
  (``customer_id``, ``sales_channel``) is needed. The reference declares the
  lineitem→orders foreign key as NOT NULL; ``fk_orphans`` verifies it, and
  under it the join neither drops nor duplicates fact rows. Skipping it saves
  the largest shuffle join of the schema.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Fixed values of the binding (FIXTURES.md B.1): order priorities that count
# as the 'Online' channel, and the base age of the customer age stand-in.
ONLINE_PRIORITIES = ("1-URGENT", "2-HIGH")
AGE_BASE = 18
AGE_SPAN = 63

MONEY = "decimal(12,2)"
PRICE = "decimal(10,2)"
SUM_MONEY = "decimal(38,2)"

ORDER_COLUMNS = frozenset({"customer_id", "sales_channel"})
FACT_COLUMNS = (
    "sale_id", "article_id", "date_sales", "customer_id", "quantity_sold",
    "total_price", "sales_channel", "is_return",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Session setting for text that comes in files Spark cannot split (one row group,
# gzip): rows of these tables are dealt by id to so many partitions. Unset by
# default; a table of many splits never needs it.
UNSPLITTABLE_KEY = "quarry.unsplittable.partitions"
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as its scan gives it: split sizes are the session's
    (``spark.sql.files.maxPartitionBytes``), and no raw row is shuffled unless
    the session asks for it (``UNSPLITTABLE_KEY``)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    parts = spark.conf.get(UNSPLITTABLE_KEY, None) if name in TEXT_TABLES else None
    return df.repartition(int(parts), TEXT_TABLES[name]) if parts else df


def register_base_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every base table as a temporary view of the same name."""
    for name in TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def dim_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_name").alias("article_name"),
        F.col("p_type").alias("article_category"),
        F.col("p_brand").alias("article_brand"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("article_color"),
        F.col("p_retailprice").cast(PRICE).alias("article_price"),
    )


def region_of_nation(spark: SparkSession, sf_dir: str) -> Column:
    """``map<nation key, region name>`` as a scalar subquery (25 entries, fixed
    by the schema). Used instead of a join so that the customer dimension keeps
    the size estimate of the customer scan: Spark's own size check can then
    broadcast it when small and plan a sort-merge join when it is not."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return geo.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "r_name")))).scalar()


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    region = F.element_at(region_of_nation(spark, sf_dir), F.col("c_nationkey"))
    return (
        c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            region.alias("customer_region"),
            (F.lit(AGE_BASE) + F.col("c_custkey") % AGE_SPAN).cast("int").alias("customer_age"),
            F.col("c_mktsegment").alias("customer_segment"),
        )
        # inner-join semantics: a customer whose nation has no region is dropped
        .filter(F.col("customer_region").isNotNull())
    )


def fact_sales(spark: SparkSession, sf_dir: str,
               columns: Iterable[str] | None = None,
               date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The sales fact view, optionally restricted to ``columns``.

    ``date_from``/``date_to`` (inclusive, ISO dates) are applied to the raw
    ``l_shipdate`` timestamp so that the bound reaches the Parquet scan as a
    pushed filter (a predicate on ``cast(l_shipdate as date)`` would not).
    """
    wanted = tuple(columns) if columns is not None else FACT_COLUMNS
    unknown = set(wanted) - set(FACT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown fact_sales columns: {sorted(unknown)}")

    li = read(spark, sf_dir, "lineitem")
    if date_from is not None:
        li = li.filter(F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit(date_from)))
    if date_to is not None:
        li = li.filter(F.col("l_shipdate") < F.date_add(F.to_date(F.lit(date_to)), 1)
                       .cast("timestamp_ntz"))

    exprs: dict[str, Column] = {
        "sale_id": F.col("l_orderkey"),
        "article_id": F.col("l_partkey"),
        "date_sales": F.col("l_shipdate").cast("date"),
        "customer_id": F.col("o_custkey"),
        "quantity_sold": F.col("l_quantity").cast("bigint"),
        "total_price": F.col("l_extendedprice").cast(MONEY),
        "sales_channel": F.when(F.col("o_orderpriority").isin(*ONLINE_PRIORITIES), F.lit("Online"))
                          .otherwise(F.lit("Partner")),
        "is_return": F.col("l_returnflag") == F.lit("R"),
    }
    if ORDER_COLUMNS & set(wanted):
        o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        li = li.join(o, li.l_orderkey == o.o_orderkey)
    return li.select(*[exprs[c].alias(c) for c in wanted])


COMMENT_COLUMNS = ("comment_id", "article_id", "comment_text", "lang", "source", "satisfaction")


def comments(spark: SparkSession, sf_dir: str, columns: Iterable[str] = COMMENT_COLUMNS) -> DataFrame:
    """Customer feedback bound onto ``documents``, restricted to ``columns``.

    ``article_id`` is ``doc_id mod (number of parts)`` (a stand-in, FIXTURES.md
    B.1); the part count is a scalar subquery, evaluated once by Spark.
    ``satisfaction`` is the document's ``labels.quality`` (left join, made only
    where that column is asked for, so texts are not shuffled without need).
    """
    wanted = tuple(columns)
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n_parts = read(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    if "satisfaction" in wanted:
        d = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    exprs = {"comment_id": F.col("doc_id"), "article_id": F.col("doc_id") % n_parts, "comment_text": F.col("text"),
             "lang": F.col("lang"), "source": F.col("source")}
    if "satisfaction" in wanted:
        exprs["satisfaction"] = F.col("quality")
    return d.select(*[exprs[c].alias(c) for c in wanted])


# ---------------------------------------------------------------------------
# The same bindings as DuckDB SQL, for the oracle side of the check.
# ---------------------------------------------------------------------------

SQL_DIM_ARTICLE = (
    "SELECT p_partkey AS article_id, p_name AS article_name, p_type AS article_category, "
    "p_brand AS article_brand, split_part(p_name, ' ', 1) AS article_color, "
    "CAST(p_retailprice AS DECIMAL(10,2)) AS article_price FROM part"
)

SQL_DIM_CUSTOMER = (
    "SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, r.r_name AS customer_region, "
    f"CAST({AGE_BASE} + c.c_custkey % {AGE_SPAN} AS INTEGER) AS customer_age, "
    "c.c_mktsegment AS customer_segment "
    "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
    "JOIN region r ON n.n_regionkey = r.r_regionkey"
)

SQL_FACT_SALES = (
    "SELECT l.l_orderkey AS sale_id, l.l_partkey AS article_id, "
    "CAST(l.l_shipdate AS DATE) AS date_sales, o.o_custkey AS customer_id, "
    "CAST(l.l_quantity AS BIGINT) AS quantity_sold, "
    "CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total_price, "
    "CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Online' ELSE 'Partner' END AS sales_channel, "
    "l.l_returnflag = 'R' AS is_return "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
)

SQL_COMMENTS = (
    "SELECT d.doc_id AS comment_id, d.doc_id % (SELECT count(*) FROM part) AS article_id, "
    "d.text AS comment_text, d.lang, d.source, lb.quality AS satisfaction "
    "FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id"
)


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with CTEs for the named binding views."""
    defs = {
        "dim_article": SQL_DIM_ARTICLE,
        "dim_customer": SQL_DIM_CUSTOMER,
        "fact_sales": SQL_FACT_SALES,
        "comments": SQL_COMMENTS,
    }
    ctes = ", ".join(f"{v} AS ({defs[v]})" for v in views)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {sql.lstrip()[5:]}"
    return f"WITH {ctes} {sql}"
