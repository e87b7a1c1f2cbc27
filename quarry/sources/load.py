"""Typed loads into catalog tables: create or replace, column defaults, NOT NULL,
abort on error, staged write and atomic replace.

A load never writes into the table that readers see. It makes a staged table of the
same columns in a folder of its own, inserts the old rows (unless it replaces them) and
the typed rows of the file by column name — columns that the file does not have take
their DEFAULT — and only then points the table to the new folder. A load that fails
leaves the table as it was; readers of the old folder go on undisturbed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import csv as C
from quarry.sources import tables as T

DATABASE = "quarry_star"


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool = False
    default: str | None = None             # SQL literal


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    header: bool = False
    multiline: bool = False

    def spec(self, fields: tuple[str, ...] | None = None) -> C.CsvSpec:
        """How a file of ``fields`` (all columns by default, in order) is read."""
        kinds = {c.name: c.kind for c in self.columns}
        return C.CsvSpec(columns=tuple((f, kinds[f]) for f in fields or kinds), header=self.header, multiline=self.multiline)


# The four tables of the reference's load, in its column order.
DIM_ARTICLE = Table("dim_article", (
    Column("article_id", "bigint", True), Column("article_name", "string", True), Column("article_category", "string", True),
    Column("article_brand", "string"), Column("article_color", "string"), Column("article_price", T.PRICE, True)), header=True)
DIM_CUSTOMER = Table("dim_customer", (
    Column("customer_id", "bigint", True), Column("customer_name", "string"), Column("customer_region", "string"),
    Column("customer_age", "int"), Column("customer_gender", "string"), Column("customer_segment", "string")), header=True)
FACT_SALES = Table("fact_sales", (
    Column("sale_id", "bigint", True), Column("article_id", "bigint", True), Column("date_sales", "date", True),
    Column("customer_id", "bigint", True), Column("quantity_sold", "bigint", True), Column("total_price", T.MONEY, True),
    Column("sales_channel", "string"), Column("is_return", "boolean", default="false")))
COMMENTS = Table("customer_experience_comments", (
    Column("comment_id", "bigint", True), Column("comment_date", "date"), Column("article_id", "bigint"),
    Column("article_name", "string"), Column("comment_text", "string", True)), multiline=True)


def _create(spark: SparkSession, name: str, table: Table) -> None:
    columns = ", ".join(f"{c.name} {c.kind}" + (f" DEFAULT {c.default}" if c.default is not None else "")
                        for c in table.columns)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{scratch_path(spark, table.name)}'")


def create_or_replace(spark: SparkSession, table: Table, database: str = DATABASE) -> str:
    """An empty catalog table; an older one of that name goes (its files stay for its readers)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch_path(spark, database)}'")
    name = f"{database}.{table.name}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _create(spark, name, table)
    return name


def checked(rows: DataFrame, table: Table) -> DataFrame:
    """``rows``; a null in a required column fails the load."""
    required = {c.name for c in table.columns if c.required}
    return rows.select(*[
        F.coalesce(F.col(c), F.raise_error(F.lit(f"{table.name}.{c} is null")).cast(rows.schema[c].dataType)).alias(c)
        if c in required else F.col(c) for c in rows.columns])


def copy_into(spark: SparkSession, table: Table, path: str, fields: tuple[str, ...] | None = None,
              replace: bool = False, database: str = DATABASE) -> DataFrame:
    """Load the CSV at ``path`` (its fields in order) into the table; all or nothing."""
    name = f"{database}.{table.name}"
    staged = f"{name}_staged_{uuid.uuid4().hex[:12]}"
    rows = checked(C.read_typed(spark, path, table.spec(fields)), table)
    _create(spark, staged, table)
    try:
        if not replace:
            spark.sql(f"INSERT INTO {staged} SELECT * FROM {name}")
        spark.sql(f"INSERT INTO {staged} ({', '.join(rows.columns)}) SELECT * FROM {{rows}}", rows=rows)
        location = spark.sql(f"DESCRIBE FORMATTED {staged}").filter("col_name = 'Location'").first()["data_type"]
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.catalog.refreshTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")          # an external table: its files stay
    return spark.table(name)


# ---------------------------------------------------------------------------
# Keys: each table is written as the reference's files are (header or none, gzip) and loaded.
# ---------------------------------------------------------------------------

# Stand-ins for what the data lacks. The gender of a customer by id; a
# third of them has a null token instead. A comment's date, by id from a first day.
GENDERS = ("Female", "Male", "NULL")
COMMENT_DAY, COMMENT_DAYS = "2000-01-01", 700


def _database(spark: SparkSession) -> str:
    return f"{DATABASE}_{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, table: Table, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    C.write_csv(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]), path, header=table.header)
    return path


def _loaded(spark: SparkSession, table: Table, *files: tuple[DataFrame, tuple[str, ...] | None]) -> DataFrame:
    database = _database(spark)
    create_or_replace(spark, table, database)
    out = None
    for df, fields in files:
        out = copy_into(spark, table, _written(df, table, f"csv-{table.name}"), fields, database=database)
    return out


@register("load_dim_article", T.SQL_DIM_ARTICLE)
def load_dim_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, DIM_ARTICLE, (T.dim_article(spark, sf_dir), None))


@register("load_dim_customer",
          f"SELECT customer_id, customer_name, customer_region, customer_age, CASE customer_id % {len(GENDERS)} "
          f"WHEN 0 THEN '{GENDERS[0]}' WHEN 1 THEN '{GENDERS[1]}' END AS customer_gender, customer_segment "
          f"FROM ({T.SQL_DIM_CUSTOMER})")
def load_dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    gender = F.element_at(F.array(*[F.lit(g) for g in GENDERS]), (F.col("customer_id") % len(GENDERS) + 1).cast("int"))
    rows = T.dim_customer(spark, sf_dir).withColumn("customer_gender", gender)
    return _loaded(spark, DIM_CUSTOMER, (rows.select(*[c.name for c in DIM_CUSTOMER.columns]), None))


@register("load_fact_sales", T.SQL_FACT_SALES)
def load_fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gzip files without header: returns with all fields, and other sales without the last
    field, whose value is the column's default."""
    sales = T.fact_sales(spark, sf_dir)
    short = tuple(c.name for c in FACT_SALES.columns if c.name != "is_return")
    return _loaded(spark, FACT_SALES, (sales.filter("is_return"), None),
                   (sales.filter("NOT is_return").select(*short), short))


@register("load_comments", T.with_views(
    "SELECT c.comment_id, CAST(DATE '" + COMMENT_DAY + f"' + CAST(c.comment_id % {COMMENT_DAYS} AS INTEGER) AS DATE) AS comment_date, "
    "c.article_id, a.article_name, trim(c.comment_text, ' ') AS comment_text FROM comments c JOIN dim_article a "
    "ON c.article_id = a.article_id WHERE trim(coalesce(c.comment_text, ''), ' ') NOT IN ('', 'NULL', 'null', 'None')",
    "comments", "dim_article"))
def load_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks in gzip files without header."""
    day = F.date_add(F.lit(COMMENT_DAY).cast("date"), (F.col("comment_id") % COMMENT_DAYS).cast("int"))
    rows = (T.comments(spark, sf_dir, ("comment_id", "article_id", "comment_text"))
            .join(T.dim_article(spark, sf_dir).select("article_id", "article_name"), "article_id")
            .filter(~F.trim(F.coalesce("comment_text", F.lit(""))).isin(*C.NULL_TOKENS))
            .select("comment_id", day.alias("comment_date"), "article_id", "article_name", "comment_text"))
    return _loaded(spark, COMMENTS, (rows, None))
