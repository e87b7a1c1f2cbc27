"""Semantic (metric) layer: named dimensions, facts, metrics and relationships
over the star schema, turned into one DataFrame plan per request.

The model lives on the driver as plain dataclasses; all row work is a Spark
plan: fact scan (only the needed columns) → the dimension joins the request
needs (many-to-one, declared below) → filters → ``groupBy().agg()`` (partial
plus final hash aggregate) → optional order/limit.

Filters are applied *before* the joins wherever they touch one table, so
Catalyst pushes them into that table's Parquet scan; date bounds on the time
dimension are pushed into the raw lineitem scan by the fact loader.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import tables as T


@dataclass(frozen=True)
class Field:
    """A dimension, time dimension or fact of one logical table."""
    name: str
    table: str
    kind: str                       # 'dimension' | 'time_dimension' | 'fact'
    data_type: str
    synonyms: tuple[str, ...] = ()
    sample_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Metric:
    name: str
    expr: str                       # Spark SQL aggregate over fact columns
    needs: tuple[str, ...]          # fact columns the expression reads
    output_type: str | None = None  # final cast, keeps types engine-stable
    additive: bool = True
    synonyms: tuple[str, ...] = ()

    def column(self, approximate: bool = False) -> Column:
        expr = self.expr
        if approximate and expr.lower().startswith("count(distinct "):
            # HyperLogLog++ (relative error ~1%): a fixed-size sketch per
            # group instead of shuffling every distinct value.
            expr = "approx_count_distinct(" + expr[len("count(distinct "):-1] + ", 0.01)"
        c = F.expr(expr)
        if self.output_type:
            c = c.cast(self.output_type)
        return c.alias(self.name)


@dataclass(frozen=True)
class Relationship:
    name: str
    left_table: str
    right_table: str
    left_column: str
    right_column: str


@dataclass(frozen=True)
class Table:
    name: str
    primary_key: tuple[str, ...]
    loader: Callable[..., DataFrame]


@dataclass(frozen=True)
class Filter:
    """A predicate on one logical column: op in eq, ne, in, between, lt, le, gt, ge."""
    column: str
    op: str
    value: object
    value2: object = None

    def to_column(self) -> Column:
        c = F.col(self.column)
        if self.op == "eq":
            return c == F.lit(self.value)
        if self.op == "ne":
            return c != F.lit(self.value)
        if self.op == "in":
            return c.isin(*list(self.value))
        if self.op == "between":
            return c.between(F.lit(self.value), F.lit(self.value2))
        if self.op == "lt":
            return c < F.lit(self.value)
        if self.op == "le":
            return c <= F.lit(self.value)
        if self.op == "gt":
            return c > F.lit(self.value)
        if self.op == "ge":
            return c >= F.lit(self.value)
        raise ValueError(f"unknown filter op {self.op!r}")


@dataclass
class SemanticModel:
    name: str
    tables: dict[str, Table]
    fields: dict[str, Field]
    metrics: dict[str, Metric]
    relationships: list[Relationship]
    fact_table: str = "fact_sales"
    grains: tuple[str, ...] = field(default=("day", "week", "month", "quarter", "year"))

    def table_of(self, column: str) -> str:
        if column in self.fields:
            return self.fields[column].table
        raise KeyError(f"unknown column {column!r}")

    def relationship_to(self, table: str) -> Relationship:
        for r in self.relationships:
            if r.left_table == self.fact_table and r.right_table == table:
                return r
        raise KeyError(f"no relationship from {self.fact_table} to {table}")


# ---------------------------------------------------------------------------
# The sales model. Names, synonyms and metric formulas are fixed values that
# must equal the reference model (one block, natural order). Sample values are
# those of the bound test data (FIXTURES.md B.1), not the reference's lab data.
# ---------------------------------------------------------------------------

def _fact_loader(spark: SparkSession, sf_dir: str, columns=None, date_from=None, date_to=None):
    return T.fact_sales(spark, sf_dir, columns, date_from=date_from, date_to=date_to)


def _article_loader(spark: SparkSession, sf_dir: str, columns=None, **_):
    df = T.dim_article(spark, sf_dir)
    return df.select(*columns) if columns else df


def _customer_loader(spark: SparkSession, sf_dir: str, columns=None, **_):
    df = T.dim_customer(spark, sf_dir)
    return df.select(*columns) if columns else df


# Field synonyms of the reference model, in model order.
_FIELDS = [
    Field("sale_id", "fact_sales", "dimension", "NUMBER"),
    Field("article_id", "fact_sales", "dimension", "NUMBER"),
    Field("customer_id", "fact_sales", "dimension", "NUMBER"),
    Field("quantity_sold", "fact_sales", "dimension", "NUMBER",
          ("units sold", "items sold", "qty")),
    Field("sales_channel", "fact_sales", "dimension", "VARCHAR",
          ("channel", "distribution channel", "sales medium"), ("Online", "Partner")),
    Field("is_return", "fact_sales", "dimension", "BOOLEAN",
          ("return", "refund", "reversed")),
    Field("date_sales", "fact_sales", "time_dimension", "DATE",
          ("sale date", "order date", "transaction date", "purchase date")),
    Field("total_price", "fact_sales", "fact", "NUMBER",
          ("revenue", "sales amount", "transaction value", "order value")),
    Field("article_name", "dim_article", "dimension", "VARCHAR",
          ("product name", "product", "item name")),
    Field("article_category", "dim_article", "dimension", "VARCHAR",
          ("product category", "category", "product type", "sport"),
          ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")),
    Field("article_brand", "dim_article", "dimension", "VARCHAR",
          ("brand", "manufacturer", "make")),
    Field("article_color", "dim_article", "dimension", "VARCHAR",
          ("color", "colour")),
    Field("article_price", "dim_article", "fact", "NUMBER",
          ("list price", "retail price", "RRP", "unit price")),
    Field("customer_name", "dim_customer", "dimension", "VARCHAR",
          ("customer", "client name", "buyer")),
    Field("customer_region", "dim_customer", "dimension", "VARCHAR",
          ("region", "area", "geography", "location"),
          ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")),
    Field("customer_age", "dim_customer", "dimension", "NUMBER", ("age",)),
    Field("customer_gender", "dim_customer", "dimension", "VARCHAR", ("gender", "sex")),
    Field("customer_segment", "dim_customer", "dimension", "VARCHAR",
          ("segment", "customer tier", "customer type", "loyalty tier"),
          ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
]

# Metric names, formulas and synonyms of the reference model.
_METRICS = [
    Metric("total_revenue", "sum(total_price)", ("total_price",), T.SUM_MONEY,
           synonyms=("revenue", "sales", "total sales", "gross revenue")),
    Metric("transaction_count", "count(sale_id)", ("sale_id",), "bigint",
           synonyms=("number of sales", "sales count", "orders", "number of transactions")),
    Metric("units_sold", "sum(quantity_sold)", ("quantity_sold",), "bigint",
           synonyms=("items sold", "quantity sold", "volume")),
    Metric("unique_customers", "count(DISTINCT customer_id)", ("customer_id",), "bigint",
           additive=False, synonyms=("customer count", "buyers", "number of customers")),
    # AVG(total_price): exact decimal sum over the non-null count, in double,
    # rounded to 6 places so that both engines agree digit for digit.
    Metric("avg_order_value",
           "round(CAST(sum(total_price) AS DOUBLE) / nullif(count(total_price), 0), 6)",
           ("total_price",), "double", additive=False,
           synonyms=("AOV", "average transaction value", "average basket size")),
]

SALES_MODEL = SemanticModel(
    name="sales_model",
    tables={
        "fact_sales": Table("fact_sales", ("sale_id",), _fact_loader),
        "dim_article": Table("dim_article", ("article_id",), _article_loader),
        "dim_customer": Table("dim_customer", ("customer_id",), _customer_loader),
    },
    fields={f.name: f for f in _FIELDS},
    metrics={m.name: m for m in _METRICS},
    relationships=[
        Relationship("fact_sales_to_dim_article", "fact_sales", "dim_article",
                     "article_id", "article_id"),
        Relationship("fact_sales_to_dim_customer", "fact_sales", "dim_customer",
                     "customer_id", "customer_id"),
    ],
)

# Columns the bound test data does not have (FIXTURES.md B.1: gender left out).
UNBOUND_FIELDS = frozenset({"customer_gender"})


def time_bucket(column: str, grain: str) -> Column:
    """Truncate a date column to a grain; the result stays a DATE."""
    c = F.col(column)
    if grain == "day":
        return c
    if grain == "year":
        return F.trunc(c, "year")
    if grain == "quarter":
        return F.trunc(c, "quarter")
    if grain == "month":
        return F.trunc(c, "month")
    if grain == "week":
        return F.date_trunc("week", c).cast("date")
    raise ValueError(f"unknown grain {grain!r}")


def semantic_query(
    spark: SparkSession,
    sf_dir: str,
    metrics: Sequence[str],
    dimensions: Sequence[str] = (),
    filters: Sequence[Filter] = (),
    time_grain: dict[str, str] | None = None,
    order_by: Sequence[tuple[str, str]] = (),
    limit: int | None = None,
    fact: DataFrame | None = None,
    fact_transform: Callable[[DataFrame], DataFrame] | None = None,
    transform_columns: Sequence[str] = (),
    model: SemanticModel = SALES_MODEL,
    approximate_distinct: bool = False,
) -> DataFrame:
    """Build the plan for ``metrics`` grouped by ``dimensions``.

    ``time_grain`` maps a time dimension to a grain; the output column is named
    ``<dimension>_<grain>``. ``fact`` replaces the fact source (for example a
    policy-filtered view); ``fact_transform`` is applied to the fact rows
    before any join (row policies use it so that they act below every
    aggregate and join); ``transform_columns`` are fact columns it reads.
    ``approximate_distinct`` computes distinct-count metrics with
    HyperLogLog++ (exact is the default and what the oracle checks).
    """
    time_grain = dict(time_grain or {})
    for name in metrics:
        if name not in model.metrics:
            raise KeyError(f"unknown metric {name!r}")
    for d in dimensions:
        model.table_of(d)
        if d in UNBOUND_FIELDS:
            raise KeyError(f"dimension {d!r} has no binding in this data")

    fact_name = model.fact_table
    by_table: dict[str, set[str]] = {}
    for d in dimensions:
        by_table.setdefault(model.table_of(d), set()).add(d)
    filt_by_table: dict[str, list[Filter]] = {}
    for f in filters:
        filt_by_table.setdefault(model.table_of(f.column), []).append(f)

    fact_cols: set[str] = set(by_table.get(fact_name, set())) | set(transform_columns)
    for m in metrics:
        fact_cols.update(model.metrics[m].needs)
    fact_cols.update(f.column for f in filt_by_table.get(fact_name, []))
    dim_tables = sorted(t for t in set(by_table) | set(filt_by_table) if t != fact_name)
    for t in dim_tables:
        fact_cols.add(model.relationship_to(t).left_column)

    date_from = date_to = None
    fact_filters = []
    for f in filt_by_table.get(fact_name, []):
        if model.fields[f.column].kind == "time_dimension" and f.op in ("between", "ge", "le"):
            if f.op in ("between", "ge"):
                date_from = str(f.value)
            if f.op == "between":
                date_to = str(f.value2)
            if f.op == "le":
                date_to = str(f.value)
        fact_filters.append(f)

    if fact is None:
        fact = model.tables[fact_name].loader(
            spark, sf_dir, sorted(fact_cols), date_from=date_from, date_to=date_to)
    else:
        fact = fact.select(*sorted(fact_cols))
    if fact_transform is not None:
        fact = fact_transform(fact)
    for f in fact_filters:
        fact = fact.filter(f.to_column())

    df = fact
    for t in dim_tables:
        rel = model.relationship_to(t)
        cols = {rel.right_column} | by_table.get(t, set()) | {f.column for f in filt_by_table.get(t, [])}
        dim = model.tables[t].loader(spark, sf_dir, sorted(cols))
        for f in filt_by_table.get(t, []):
            dim = dim.filter(f.to_column())
        df = df.join(dim, df[rel.left_column] == dim[rel.right_column]).drop(dim[rel.right_column])

    group_cols: list[Column] = []
    for d in dimensions:
        if d in time_grain:
            group_cols.append(time_bucket(d, time_grain[d]).alias(f"{d}_{time_grain[d]}"))
        else:
            group_cols.append(F.col(d))
    aggs = [model.metrics[m].column(approximate_distinct) for m in metrics]
    out = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)

    if order_by:
        keys = []
        for col_name, direction in order_by:
            keys.append(F.desc_nulls_last(col_name) if direction == "desc" else F.asc_nulls_last(col_name))
        out = out.orderBy(*keys)
    if limit is not None:
        out = out.limit(limit)
    return out


def metric_sql(name: str, model: SemanticModel = SALES_MODEL, table_alias: str = "") -> str:
    """DuckDB form of a metric (used by the oracle strings)."""
    pre = f"{table_alias}." if table_alias else ""
    forms = {
        "total_revenue": f"CAST(SUM({pre}total_price) AS DECIMAL(38,2))",
        "transaction_count": f"CAST(COUNT({pre}sale_id) AS BIGINT)",
        "units_sold": f"CAST(SUM({pre}quantity_sold) AS BIGINT)",
        "unique_customers": f"CAST(COUNT(DISTINCT {pre}customer_id) AS BIGINT)",
        "avg_order_value": (f"ROUND(CAST(SUM({pre}total_price) AS DOUBLE) / "
                            f"NULLIF(COUNT({pre}total_price), 0), 6)"),
    }
    return f"{forms[name]} AS {name}"
