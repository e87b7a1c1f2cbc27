"""Analytic questions over the metric layer (revenue, trend, ranking,
segmentation, returns, channel split, formatted KPIs, summary rows).

Every plan aggregates the fact rows first (partial + final hash aggregate)
and only then applies ranking or share windows, which therefore run on
bounded aggregates: a per-category/month/year aggregate, or a per-group
top-k that Spark evaluates with ``WindowGroupLimit`` (partial top-k before
the shuffle, so a hot group never sends more than k rows per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import AS_OF, LAST_YEAR, TOP_K, register
from quarry.plans.semantic import Filter, semantic_query
from quarry.sources import tables as T

ALL_METRICS = ["total_revenue", "transaction_count", "units_sold", "unique_customers", "avg_order_value"]
_M_SQL = (
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(COUNT(fs.sale_id) AS BIGINT) AS transaction_count, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold, "
    "CAST(COUNT(DISTINCT fs.customer_id) AS BIGINT) AS unique_customers, "
    "ROUND(CAST(SUM(fs.total_price) AS DOUBLE) / NULLIF(COUNT(fs.total_price), 0), 6) AS avg_order_value"
)

# Date window of the date-range question (fixed parameter).
RANGE_FROM, RANGE_TO = "2000-01-01", "2000-03-31"
# Age bands (lower bounds, label) for the age-group question.
AGE_BANDS = ((18, "18-24"), (25, "25-34"), (35, "35-44"), (45, "45-54"), (55, "55-64"), (65, "65+"))


def _ratio(num, den):
    """num/den in double, NULL on a zero divisor, rounded to 6 places."""
    return F.round(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), 6)


# --- sales by dimension ----------------------------------------------------

@register("category_product_sales", T.with_views(
    "SELECT da.article_category, da.article_brand, CAST(COUNT(*) AS BIGINT) AS sale_rows, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "GROUP BY da.article_category, da.article_brand", "fact_sales", "dim_article"))
def category_product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = T.fact_sales(spark, sf_dir, ["article_id", "total_price"])
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category", "article_brand")
    return (fs.join(art, "article_id")
            .groupBy("article_category", "article_brand")
            .agg(F.count(F.lit(1)).alias("sale_rows"),
                 F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue"))
            .orderBy("article_category", "article_brand"))


@register("metric_total", T.with_views(f"SELECT {_M_SQL} FROM fact_sales fs", "fact_sales"))
def metric_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_query(spark, sf_dir, metrics=ALL_METRICS)


@register("metric_by_dims", T.with_views(
    f"SELECT da.article_brand, dc.customer_segment, {_M_SQL} "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "JOIN dim_customer dc ON fs.customer_id = dc.customer_id "
    "GROUP BY da.article_brand, dc.customer_segment", "fact_sales", "dim_article", "dim_customer"))
def metric_by_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_query(spark, sf_dir, metrics=ALL_METRICS,
                          dimensions=["article_brand", "customer_segment"])


@register("date_range_sales", T.with_views(
    f"SELECT fs.date_sales, {_M_SQL} FROM fact_sales fs "
    f"WHERE fs.date_sales BETWEEN DATE '{RANGE_FROM}' AND DATE '{RANGE_TO}' "
    "GROUP BY fs.date_sales", "fact_sales"))
def date_range_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_query(spark, sf_dir, metrics=ALL_METRICS, dimensions=["date_sales"],
                          filters=[Filter("date_sales", "between", RANGE_FROM, RANGE_TO)],
                          order_by=[("date_sales", "asc")])


@register("revenue_by_product", T.with_views(
    "SELECT da.article_id, da.article_name, CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "GROUP BY da.article_id, da.article_name", "fact_sales", "dim_article"))
def revenue_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_query(spark, sf_dir, metrics=["total_revenue", "units_sold"],
                          dimensions=["article_id", "article_name"])


@register("monthly_revenue", T.with_views(
    "SELECT CAST(date_trunc('month', fs.date_sales) AS DATE) AS month, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold FROM fact_sales fs GROUP BY 1", "fact_sales"))
def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic_query(spark, sf_dir, metrics=["total_revenue", "units_sold"],
                         dimensions=["date_sales"], time_grain={"date_sales": "month"})
    return out.withColumnRenamed("date_sales_month", "month").orderBy("month")


@register("seasonal_pattern", T.with_views(
    "WITH m AS (SELECT CAST(month(fs.date_sales) AS INTEGER) AS month_of_year, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue FROM fact_sales fs GROUP BY 1) "
    "SELECT month_of_year, total_revenue, "
    "ROUND(CAST(total_revenue AS DOUBLE) / NULLIF(CAST(SUM(total_revenue) OVER () AS DOUBLE), 0.0), 6) AS revenue_share "
    "FROM m", "fact_sales"))
def seasonal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = T.fact_sales(spark, sf_dir, ["date_sales", "total_price"])
    m = (fs.groupBy(F.month("date_sales").cast("int").alias("month_of_year"))
         .agg(F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue")))
    # The share window runs over the 12-row month aggregate (fixed domain).
    total = F.sum("total_revenue").over(Window.partitionBy())
    return (m.select("month_of_year", "total_revenue",
                     _ratio(F.col("total_revenue"), total).alias("revenue_share"))
            .orderBy("month_of_year"))


@register("yoy_revenue", T.with_views(
    "WITH y AS (SELECT da.article_category, CAST(year(fs.date_sales) AS INTEGER) AS sales_year, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id GROUP BY 1, 2), "
    "l AS (SELECT *, LAG(sales_year) OVER (PARTITION BY article_category ORDER BY sales_year) AS py, "
    "LAG(total_revenue) OVER (PARTITION BY article_category ORDER BY sales_year) AS pr FROM y) "
    "SELECT article_category, sales_year, total_revenue, "
    "CASE WHEN py = sales_year - 1 THEN pr END AS prev_revenue, "
    "ROUND((CAST(total_revenue AS DOUBLE) - CAST(CASE WHEN py = sales_year - 1 THEN pr END AS DOUBLE)) "
    "/ NULLIF(CAST(CASE WHEN py = sales_year - 1 THEN pr END AS DOUBLE), 0.0), 6) AS growth FROM l",
    "fact_sales", "dim_article"))
def yoy_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = semantic_query(spark, sf_dir, metrics=["total_revenue"],
                       dimensions=["article_category", "date_sales"], time_grain={"date_sales": "year"})
    y = y.select("article_category", F.year("date_sales_year").alias("sales_year"), "total_revenue")
    w = Window.partitionBy("article_category").orderBy("sales_year")
    prev = F.when(F.lag("sales_year").over(w) == F.col("sales_year") - 1, F.lag("total_revenue").over(w))
    return (y.withColumn("prev_revenue", prev)
            .withColumn("growth", _ratio(F.col("total_revenue").cast("double") - F.col("prev_revenue").cast("double"),
                                         F.col("prev_revenue")))
            .orderBy("article_category", "sales_year"))


@register("sales_by_segment", T.with_views(
    f"SELECT dc.customer_segment, dc.customer_region, {_M_SQL} "
    "FROM fact_sales fs JOIN dim_customer dc ON fs.customer_id = dc.customer_id "
    "GROUP BY dc.customer_segment, dc.customer_region", "fact_sales", "dim_customer"))
def sales_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_query(spark, sf_dir, metrics=ALL_METRICS,
                          dimensions=["customer_segment", "customer_region"],
                          order_by=[("customer_segment", "asc"), ("customer_region", "asc")])


def _age_band_sql(col: str) -> str:
    parts = []
    for lo, label in reversed(AGE_BANDS):
        parts.append(f"WHEN {col} >= {lo} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'under 18' END"


def age_band(col: str = "customer_age"):
    expr = F.lit("under 18")
    for lo, label in AGE_BANDS:
        expr = F.when(F.col(col) >= lo, F.lit(label)).otherwise(expr)
    return expr


@register("sales_by_age_band", T.with_views(
    f"SELECT {_age_band_sql('dc.customer_age')} AS age_band, {_M_SQL} "
    "FROM fact_sales fs JOIN dim_customer dc ON fs.customer_id = dc.customer_id GROUP BY 1",
    "fact_sales", "dim_customer"))
def sales_by_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The band is a dimension-side expression: compute it on the customer
    # table, then join; the aggregate groups by it.
    return semantic_query(
        spark, sf_dir, metrics=ALL_METRICS, dimensions=["age_band"],
        model=_with_age_band(),
    ).orderBy("age_band")


def _with_age_band():
    from dataclasses import replace
    from quarry.plans import semantic as S

    def loader(spark, sf_dir, columns=None, **_):
        df = T.dim_customer(spark, sf_dir).withColumn("age_band", age_band())
        return df.select(*columns) if columns else df

    fields = dict(S.SALES_MODEL.fields)
    fields["age_band"] = S.Field("age_band", "dim_customer", "dimension", "VARCHAR", ("age group",))
    tables = dict(S.SALES_MODEL.tables)
    tables["dim_customer"] = S.Table("dim_customer", ("customer_id",), loader)
    return replace(S.SALES_MODEL, fields=fields, tables=tables)


@register("channel_split", T.with_views(
    "SELECT da.article_category, "
    "CAST(SUM(CASE WHEN fs.sales_channel = 'Online' THEN fs.total_price ELSE 0 END) AS DECIMAL(38,2)) AS online_revenue, "
    "CAST(SUM(CASE WHEN fs.sales_channel = 'Partner' THEN fs.total_price ELSE 0 END) AS DECIMAL(38,2)) AS partner_revenue, "
    "ROUND(CAST(SUM(CASE WHEN fs.sales_channel = 'Online' THEN fs.total_price ELSE 0 END) AS DOUBLE) "
    "/ NULLIF(CAST(SUM(fs.total_price) AS DOUBLE), 0.0), 6) AS online_share "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id GROUP BY 1",
    "fact_sales", "dim_article"))
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = T.fact_sales(spark, sf_dir, ["article_id", "sales_channel", "total_price"])
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    zero = F.lit(0).cast(T.MONEY)

    def part(channel):
        return F.sum(F.when(F.col("sales_channel") == channel, F.col("total_price")).otherwise(zero))

    return (fs.join(art, "article_id").groupBy("article_category")
            .agg(part("Online").cast(T.SUM_MONEY).alias("online_revenue"),
                 part("Partner").cast(T.SUM_MONEY).alias("partner_revenue"),
                 _ratio(part("Online"), F.sum("total_price")).alias("online_share"))
            .orderBy("article_category"))


# --- ranking ---------------------------------------------------------------

def _product_revenue(spark, sf_dir, year=None):
    kw = {}
    if year is not None:
        kw = dict(date_from=f"{year}-01-01", date_to=f"{year}-12-31")
    fs = T.fact_sales(spark, sf_dir, ["article_id", "total_price"], **kw)
    return fs.groupBy("article_id").agg(F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue"))


@register("top_n_products", T.with_views(
    "WITH p AS (SELECT article_id, CAST(SUM(total_price) AS DECIMAL(38,2)) AS total_revenue "
    "FROM fact_sales GROUP BY article_id), "
    "r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_revenue DESC NULLS LAST, article_id) AS rt, "
    "ROW_NUMBER() OVER (ORDER BY total_revenue ASC NULLS LAST, article_id) AS rb FROM p) "
    f"SELECT 'top' AS side, CAST(rt AS INTEGER) AS rank, article_id, total_revenue FROM r WHERE rt <= {TOP_K} "
    f"UNION ALL SELECT 'bottom', CAST(rb AS INTEGER), article_id, total_revenue FROM r WHERE rb <= {TOP_K}",
    "fact_sales"))
def top_n_products(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    """Top and bottom k products by revenue.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: every task keeps
    its own k best rows, so only k × tasks rows reach the final merge.
    The rank numbers are assigned on those k rows.
    """
    p = _product_revenue(spark, sf_dir)
    top = p.orderBy(F.desc_nulls_last("total_revenue"), F.asc("article_id")).limit(k)
    bottom = p.orderBy(F.asc_nulls_last("total_revenue"), F.asc("article_id")).limit(k)
    wt = Window.orderBy(F.desc_nulls_last("total_revenue"), F.asc("article_id"))
    wb = Window.orderBy(F.asc_nulls_last("total_revenue"), F.asc("article_id"))
    return (top.select(F.lit("top").alias("side"), F.row_number().over(wt).alias("rank"), "article_id", "total_revenue")
            .unionByName(bottom.select(F.lit("bottom").alias("side"), F.row_number().over(wb).alias("rank"),
                                       "article_id", "total_revenue")))


@register("top_n_by_quantity", T.with_views(
    "WITH p AS (SELECT article_id, CAST(SUM(quantity_sold) AS BIGINT) AS units_sold FROM fact_sales GROUP BY article_id), "
    "r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY units_sold DESC NULLS LAST, article_id) AS rt, "
    "ROW_NUMBER() OVER (ORDER BY units_sold ASC NULLS LAST, article_id) AS rb FROM p) "
    f"SELECT 'top' AS side, CAST(rt AS INTEGER) AS rank, article_id, units_sold FROM r WHERE rt <= {TOP_K} "
    f"UNION ALL SELECT 'bottom', CAST(rb AS INTEGER), article_id, units_sold FROM r WHERE rb <= {TOP_K}",
    "fact_sales"))
def top_n_by_quantity(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    """Top and bottom k products by units sold; ranks are given to those k rows only."""
    p = (T.fact_sales(spark, sf_dir, ["article_id", "quantity_sold"]).groupBy("article_id")
         .agg(F.sum("quantity_sold").alias("units_sold")))
    sides = []
    for side, order in (("top", F.desc_nulls_last("units_sold")), ("bottom", F.asc_nulls_last("units_sold"))):
        best = p.orderBy(order, F.asc("article_id")).limit(k)
        rank = F.row_number().over(Window.orderBy(order, F.asc("article_id")))
        sides.append(best.select(F.lit(side).alias("side"), rank.alias("rank"), "article_id", "units_sold"))
    return sides[0].unionByName(sides[1])


@register("top_n_per_category", T.with_views(
    "WITH p AS (SELECT da.article_category, fs.article_id, CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    f"WHERE year(fs.date_sales) = {AS_OF.year} GROUP BY 1, 2), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_category ORDER BY total_revenue DESC NULLS LAST, article_id) AS rn FROM p) "
    f"SELECT article_category, CAST(rn AS INTEGER) AS rank, article_id, total_revenue FROM r WHERE rn <= {TOP_K}",
    "fact_sales", "dim_article"))
def top_n_per_category(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    """Best sellers of each category in the as-of year (grouped top-k)."""
    p = _product_revenue(spark, sf_dir, year=AS_OF.year)
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    p = p.join(art, "article_id")
    w = Window.partitionBy("article_category").orderBy(F.desc_nulls_last("total_revenue"), F.asc("article_id"))
    return (p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("article_category", "rank", "article_id", "total_revenue"))


# --- returns ---------------------------------------------------------------

@register("return_rate", T.with_views(
    "SELECT da.article_category, CAST(COUNT_IF(fs.is_return) AS BIGINT) AS returns, "
    "CAST(COUNT(*) AS BIGINT) AS sales, "
    "ROUND(CAST(COUNT_IF(fs.is_return) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0.0), 6) AS return_rate, "
    "CAST(SUM(CASE WHEN fs.is_return THEN fs.total_price END) AS DECIMAL(38,2)) AS returned_revenue "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id GROUP BY 1",
    "fact_sales", "dim_article"))
def return_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = T.fact_sales(spark, sf_dir, ["article_id", "is_return", "total_price"])
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    return (fs.join(art, "article_id").groupBy("article_category")
            .agg(F.count_if("is_return").alias("returns"),
                 F.count(F.lit(1)).alias("sales"),
                 _ratio(F.count_if("is_return"), F.count(F.lit(1))).alias("return_rate"),
                 F.sum(F.when(F.col("is_return"), F.col("total_price"))).cast(T.SUM_MONEY).alias("returned_revenue"))
            .orderBy("article_category"))


# --- formatted output ------------------------------------------------------

@register("formatted_kpis", T.with_views(
    "WITH c AS (SELECT da.article_category, CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id GROUP BY 1) "
    "SELECT article_category, "
    "'$' || format('{:,}', CAST(ROUND(total_revenue, 0) AS BIGINT)) AS revenue_text, "
    "format('{:,}', units_sold) || ' units' AS units_text, "
    "CAST(CAST(ROUND(100.0 * CAST(total_revenue AS DOUBLE) / CAST(SUM(total_revenue) OVER () AS DOUBLE), 1) "
    "AS DECIMAL(10,1)) AS VARCHAR) || '%' AS share_text FROM c",
    "fact_sales", "dim_article"))
def formatted_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue as ``$X,XXX``, units as ``X units`` and share as ``X.X%`` per category."""
    c = semantic_query(spark, sf_dir, metrics=["total_revenue", "units_sold"], dimensions=["article_category"])
    # Share window over the per-category aggregate (one row per category).
    total = F.sum("total_revenue").over(Window.partitionBy())
    share = F.round(F.lit(100.0) * F.col("total_revenue").cast("double") / total.cast("double"), 1)
    return c.select(
        "article_category",
        F.concat(F.lit("$"), F.format_number(F.round("total_revenue", 0).cast("bigint"), 0)).alias("revenue_text"),
        F.concat(F.format_number("units_sold", 0), F.lit(" units")).alias("units_text"),
        F.concat(share.cast("decimal(10,1)").cast("string"), F.lit("%")).alias("share_text"),
    ).orderBy("article_category")


@register("summary_rows", T.with_views(
    "WITH r AS (SELECT dc.customer_region, da.article_category, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(COUNT(DISTINCT fs.customer_id) AS BIGINT) AS unique_customers, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "JOIN dim_customer dc ON fs.customer_id = dc.customer_id GROUP BY 1, 2), "
    "b AS (SELECT customer_region, 'Sales summary: ' || customer_region AS subject, "
    "string_agg('- ' || article_category || ': $' || format('{:,}', CAST(ROUND(total_revenue, 0) AS BIGINT)) "
    "|| ' revenue, ' || unique_customers || ' customers, ' || units_sold || ' units', chr(10) "
    "ORDER BY total_revenue DESC, article_category) AS body FROM r GROUP BY customer_region) "
    "SELECT customer_region, subject, body, CAST(len(regexp_split_to_array(body, '\\s+')) AS INTEGER) AS word_count FROM b",
    "fact_sales", "dim_article", "dim_customer"))
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary text per region (subject + bullet per category, by revenue).

    The re-aim of the mail body: the rows go to an outbox table instead of
    being sent. A body gathers one line per category of its region, a group
    bounded by the number of categories.
    """
    from quarry.plans.verified import revenue_by_region_and_category
    r = revenue_by_region_and_category(spark, sf_dir)
    line = F.concat(
        F.lit("- "), F.col("article_category"), F.lit(": $"),
        F.format_number(F.round("total_revenue", 0).cast("bigint"), 0),
        F.lit(" revenue, "), F.col("unique_customers").cast("string"), F.lit(" customers, "),
        F.col("units_sold").cast("string"), F.lit(" units"))
    key = F.struct((-F.col("total_revenue")).alias("k1"), F.col("article_category").alias("k2"), line.alias("line"))
    b = (r.groupBy("customer_region")
         .agg(F.sort_array(F.collect_list(key)).alias("lines"))
         .select("customer_region",
                 F.concat(F.lit("Sales summary: "), F.col("customer_region")).alias("subject"),
                 F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body")))
    return b.withColumn("word_count", F.size(F.split("body", r"\s+")))


def write_outbox(rows: DataFrame, path: str) -> None:
    """Append summary rows to the outbox table (the re-aimed mail step):
    one Parquet folder per run date, rewritten whole on retry."""
    (rows.withColumn("run_date", F.current_date())
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(path))
