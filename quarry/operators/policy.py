"""Row-level access: a role-dependent filter on the sales fact.

The policy acts on ``article_id`` (the reference attaches it to that column):
admins see every row, an entitled role sees the rows whose article belongs
to one of its categories, any other role sees nothing.

Spark form for one role: a ``left_semi`` join of the fact with the entitled articles —
never an unqualified correlated predicate, which would bind to the inner
table and let every row through. The role is a literal, so the plan folds to
exactly one branch (no join for admins, no row for unknown roles).

For many roles at once every product carries its role set, one bit a role: an
expression over its category, no join and no copy of a row per role. Facts are
aggregated by role set, and only the few sets are expanded to roles; the same bit set
on an index's postings filters a search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.sources import tables as T

# The policy's roles. Admin role names are the reference's;
# category grants are bound to the test data's product types (FIXTURES.md B.1).
ADMIN_ROLES = ("ACCOUNTADMIN", "SYSADMIN")
ROLE_GRANTS = {
    "BIKE_ROLE": ("PROMO",),
    "SNOW_ROLE": ("SMALL", "LARGE"),
}
ROLE_A, ROLE_B, ROLE_OTHER = "BIKE_ROLE", "SNOW_ROLE", "PUBLIC"


def entitlements(spark: SparkSession, grants: dict[str, tuple[str, ...]] = ROLE_GRANTS) -> DataFrame:
    """The grant table ``(role, article_category)``; size = number of grants."""
    rows = [(role, cat) for role, cats in grants.items() for cat in cats]
    return spark.createDataFrame(rows, "role string, article_category string")


def apply_policy(spark: SparkSession, sf_dir: str | None, fact: DataFrame, role: str,
                 grants: dict[str, tuple[str, ...]] = ROLE_GRANTS,
                 articles: DataFrame | None = None) -> DataFrame:
    """Rows of ``fact`` (must carry ``article_id``) visible to ``role``.

    ``articles`` (``article_id``, ``article_category``) defaults to the bound
    product dimension of ``sf_dir``.
    """
    if role in ADMIN_ROLES:
        return fact
    cats = grants.get(role)
    if not cats:
        return fact.filter(F.lit(False))
    if articles is None:
        articles = T.dim_article(spark, sf_dir)
    allowed = articles.filter(F.col("article_category").isin(*cats)).select("article_id")
    return fact.join(allowed, "article_id", "left_semi")


def secure_fact_view(spark: SparkSession, sf_dir: str, view: str = "fact_sales_secure",
                     variable: str = "quarry_role") -> str:
    """Register the SQL form of the policy: a view over a session variable.

    ``SET VAR quarry_role = 'BIKE_ROLE'`` changes what the view returns; every
    consumer reading the view is filtered below its own joins and aggregates.
    Columns are qualified so that the correlated predicate binds to the outer
    row.
    """
    T.fact_sales(spark, sf_dir).createOrReplaceTempView("quarry_fact_sales")
    T.dim_article(spark, sf_dir).createOrReplaceTempView("quarry_dim_article")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} STRING DEFAULT 'PUBLIC'")
    admin = ", ".join(f"'{r}'" for r in ADMIN_ROLES)
    branches = " ".join(
        f"WHEN {variable} = '{role}' THEN EXISTS (SELECT 1 FROM quarry_dim_article da "
        f"WHERE da.article_id = fs.article_id AND da.article_category IN ({', '.join(repr(c) for c in cats)}))"
        for role, cats in ROLE_GRANTS.items())
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT fs.* FROM quarry_fact_sales fs WHERE "
        f"CASE WHEN {variable} IN ({admin}) THEN TRUE {branches} ELSE FALSE END")
    return view


def visible_sales(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Rows and revenue per category and product name as seen by ``role``."""
    fs = apply_policy(spark, sf_dir, T.fact_sales(spark, sf_dir, ["article_id", "total_price"]), role)
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category", "article_name")
    return (fs.join(art, "article_id")
            .groupBy("article_category", "article_name")
            .agg(F.count(F.lit(1)).alias("sale_rows"),
                 F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue"))
            .orderBy("article_category", "article_name"))


def _visible_sql(where: str) -> str:
    return T.with_views(
        "SELECT da.article_category, da.article_name, CAST(COUNT(*) AS BIGINT) AS sale_rows, "
        "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue "
        "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
        f"{where} GROUP BY da.article_category, da.article_name", "fact_sales", "dim_article")


def _in(cats) -> str:
    return ", ".join(f"'{c}'" for c in cats)


register("row_policy_admin", _visible_sql(""))(
    lambda spark, sf_dir: visible_sales(spark, sf_dir, ADMIN_ROLES[0]))
register("row_policy_role_a", _visible_sql(f"WHERE da.article_category IN ({_in(ROLE_GRANTS[ROLE_A])})"))(
    lambda spark, sf_dir: visible_sales(spark, sf_dir, ROLE_A))
register("row_policy_role_b", _visible_sql(f"WHERE da.article_category IN ({_in(ROLE_GRANTS[ROLE_B])})"))(
    lambda spark, sf_dir: visible_sales(spark, sf_dir, ROLE_B))


_POLICY_ROLES = (ADMIN_ROLES[0], ROLE_A, ROLE_B, ROLE_OTHER)
MAX_ROLES = 62                 # bits of a role set


def role_bit(role: str, roles=_POLICY_ROLES) -> int:
    return 1 << tuple(roles).index(role)


def role_set(category: str = "article_category", roles=_POLICY_ROLES,
             grants: dict[str, tuple[str, ...]] = ROLE_GRANTS) -> Column:
    """Bits of the roles that may see a product of ``category``: admins always, granted
    roles by category, others never (a null category is for admins alone)."""
    if len(roles) > MAX_ROLES:
        raise ValueError(f"at most {MAX_ROLES} roles at a time")
    out = F.lit(sum(role_bit(r, roles) for r in roles if r in ADMIN_ROLES)).cast("bigint")
    for r in roles:
        if r not in ADMIN_ROLES and grants.get(r):
            seen = F.coalesce(F.col(category).isin(*grants[r]), F.lit(False))
            out = out + F.when(seen, F.lit(role_bit(r, roles))).otherwise(0)
    return out


def expand_roles(sets: DataFrame, column: str = "role_set", roles=_POLICY_ROLES) -> DataFrame:
    """One row per row and role of its set, in the column ``role``."""
    named = F.array(*[F.when(F.col(column).bitwiseAND(role_bit(r, roles)) != 0, F.lit(r)) for r in roles])
    return sets.withColumn("role", F.explode(F.array_compact(named))).drop(column)


def sales_with_roles(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Sales with the role set of their product."""
    art = T.dim_article(spark, sf_dir).select("article_id", role_set().alias("role_set"))
    return T.fact_sales(spark, sf_dir, sorted({*columns, "article_id"})).join(art, "article_id")


@register("row_policy_denied", T.with_views(
    f"SELECT '{ROLE_OTHER}' AS role, CAST(0 AS BIGINT) AS visible_rows, CAST(COUNT(*) AS BIGINT) AS hidden_rows, "
    "CAST(COUNT(DISTINCT fs.article_id) AS BIGINT) AS hidden_articles FROM fact_sales fs JOIN dim_article da "
    "ON fs.article_id = da.article_id", "fact_sales", "dim_article"))
def row_policy_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default deny: what a role without grants sees of the sales, and what it does not."""
    seen = F.col("role_set").bitwiseAND(role_bit(ROLE_OTHER)) != 0
    return sales_with_roles(spark, sf_dir, []).agg(
        F.lit(ROLE_OTHER).alias("role"), F.count_if(seen).alias("visible_rows"), F.count_if(~seen).alias("hidden_rows"),
        F.count_distinct(F.when(~seen, F.col("article_id"))).alias("hidden_articles"))


def _metric_under_policy_sql() -> str:
    m = ("CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue, "
         "CAST(COUNT(fs.sale_id) AS BIGINT) AS transaction_count, "
         "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units_sold, "
         "CAST(COUNT(DISTINCT fs.customer_id) AS BIGINT) AS unique_customers, "
         "ROUND(CAST(SUM(fs.total_price) AS DOUBLE) / NULLIF(COUNT(fs.total_price), 0), 6) AS avg_order_value")
    parts = []
    for role in _POLICY_ROLES:
        if role in ADMIN_ROLES:
            cond = "TRUE"
        elif role in ROLE_GRANTS:
            cond = (f"fs.article_id IN (SELECT article_id FROM dim_article "
                    f"WHERE article_category IN ({_in(ROLE_GRANTS[role])}))")
        else:
            cond = "FALSE"
        parts.append(f"SELECT '{role}' AS role, {m} FROM fact_sales fs WHERE {cond}")
    return T.with_views(" UNION ALL ".join(parts), "fact_sales", "dim_article")


@register("metric_under_policy", _metric_under_policy_sql())
def metric_under_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five metrics as each role sees them, all roles in one scan of the fact.

    Sales are reduced to one row per (role set of the product, customer). Sums go on by
    role set, a handful of rows, and only these are expanded to roles. A customer is seen
    by the union of the role sets of what they bought, so customers are counted by
    that union and again only the unions are expanded: no sale and no customer is
    copied per role. A role that sees nothing keeps its row (counts 0, sums NULL)."""
    facts = sales_with_roles(spark, sf_dir, ["sale_id", "customer_id", "quantity_sold", "total_price"])
    base = facts.groupBy("role_set", "customer_id").agg(
        F.sum("total_price").alias("revenue"), F.count("total_price").alias("priced"), F.count("sale_id").alias("sales"),
        F.sum("quantity_sold").alias("units"))
    sums = expand_roles(base.groupBy("role_set").agg(*[F.sum(c).alias(c) for c in ("revenue", "priced", "sales", "units")]))
    sums = sums.groupBy("role").agg(*[F.sum(c).alias(c) for c in ("revenue", "priced", "sales", "units")])
    unions = base.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.bit_or("role_set").alias("role_set"))
    buyers = expand_roles(unions.groupBy("role_set").agg(F.count(F.lit(1)).alias("buyers")))
    buyers = buyers.groupBy("role").agg(F.sum("buyers").alias("buyers"))
    roles = spark.createDataFrame([(r,) for r in _POLICY_ROLES], "role string")
    zero = F.lit(0).cast("bigint")
    revenue = F.col("revenue").cast(T.SUM_MONEY)
    return (roles.join(sums, "role", "left").join(buyers, "role", "left")
            .select("role", revenue.alias("total_revenue"), F.coalesce("sales", zero).alias("transaction_count"),
                    F.col("units").alias("units_sold"), F.coalesce("buyers", zero).alias("unique_customers"),
                    F.round(revenue.cast("double") / F.nullif(F.col("priced"), zero), 6).alias("avg_order_value")))


def _grants_sql() -> str:
    rows = [f"('{r}', '{c}')" for r, cats in ROLE_GRANTS.items() for c in cats]
    admin = " UNION ALL ".join(
        f"SELECT DISTINCT '{r}' AS role, article_category FROM dim_article" for r in ADMIN_ROLES)
    return (f"SELECT * FROM (VALUES {', '.join(rows)}) AS g(role, article_category) UNION ALL {admin}")


@register("entitled_counts_by_role", T.with_views(
    f"WITH grants AS ({_grants_sql()}), "
    "v AS (SELECT g.role, da.article_category, CAST(COUNT(*) AS BIGINT) AS sale_rows, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS total_revenue "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "JOIN grants g ON g.article_category = da.article_category GROUP BY 1, 2) "
    "SELECT * FROM v UNION ALL "
    f"SELECT '{ROLE_OTHER}', article_category, 0, CAST(0 AS DECIMAL(38,2)) FROM v WHERE role = '{ADMIN_ROLES[0]}'",
    "fact_sales", "dim_article"))
def entitled_counts_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible rows per role and category for every role, in one job.

    The fact is reduced to one row per category first (partial + final
    aggregate), and only that small result meets the grants: joining raw
    rows on a low-cardinality category key would funnel them into a handful
    of tasks. Admins are granted every category of the data via ``explode``.
    """
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    per_category = (T.fact_sales(spark, sf_dir, ["article_id", "total_price"])
                    .join(art, "article_id")
                    .groupBy("article_category")
                    .agg(F.count(F.lit(1)).alias("sale_rows"),
                         F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue")))
    admin = (per_category.select("article_category")
             .select(F.explode(F.array(*[F.lit(r) for r in ADMIN_ROLES])).alias("role"), "article_category"))
    grants = entitlements(spark).unionByName(admin)
    granted = (per_category.join(grants, "article_category")
               .select("role", "article_category", "sale_rows", "total_revenue"))
    # A role without any grant sees no sale of any category the data has.
    denied = per_category.select(F.lit(ROLE_OTHER).alias("role"), "article_category", F.lit(0).cast("bigint").alias("sale_rows"),
                                 F.lit(0).cast("decimal(38,2)").alias("total_revenue"))
    return (granted.unionByName(denied)
            .orderBy("role", "article_category"))
