"""Typed CSV ingest: positional fields, optional quotes, null tokens, trim,
optional header, gzip by extension, abort-on-error casts and a rejects view.

Reading is split in two steps, as the reference's load is: every field is
read as a string with an explicit all-string schema (never inferred), then
one projection applies the null-token rule and casts each field. With ANSI
mode on, a field that does not cast raises (``ON_ERROR = ABORT_STATEMENT``);
:func:`split_rejects` gives the same rows as data instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import tables as T

# The file format's null tokens (after trimming).
NULL_TOKENS = ("NULL", "null", "None", "")


@dataclass(frozen=True)
class CsvSpec:
    columns: Sequence[tuple[str, str]]     # (name, Spark SQL type) in field order
    header: bool = False
    null_tokens: Sequence[str] = NULL_TOKENS
    trim: bool = True
    multiline: bool = False                # only when quoted fields hold line breaks

    def string_schema(self) -> ST.StructType:
        return ST.StructType([ST.StructField(n, ST.StringType(), True) for n, _ in self.columns])


CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, spec: CsvSpec, abort: bool = True) -> DataFrame:
    """All fields as text. A record that does not parse (too few or too many
    fields) aborts the read, or comes with its line in ``CORRUPT``."""
    schema = spec.string_schema() if abort else spec.string_schema().add(CORRUPT, ST.StringType())
    return (spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
            .option("header", spec.header)
            .option("quote", '"').option("escape", '"')
            .option("multiLine", spec.multiline)
            .option("mode", "FAILFAST" if abort else "PERMISSIVE")
            .csv(path))


def clean(c: Column, spec: CsvSpec) -> Column:
    """Trim, then map null tokens to NULL."""
    v = F.trim(c) if spec.trim else c
    return F.when(~v.isin(*spec.null_tokens), v)


def read_typed(spark: SparkSession, path: str, spec: CsvSpec) -> DataFrame:
    """Typed rows; a field that does not cast fails the job (ANSI cast)."""
    raw = read_raw(spark, path, spec)
    return raw.select(*[clean(F.col(n), spec).cast(t).alias(n) for n, t in spec.columns])


def split_rejects(spark: SparkSession, path: str, spec: CsvSpec, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) — a reject is a non-null field whose cast fails, or a
    record with too few or too many fields. The key of a reject is null where it
    does not cast itself; its text then stands in ``raw_value``."""
    raw = read_raw(spark, path, spec, abort=False)
    cleaned = raw.select(*[clean(F.col(n), spec).alias(n) for n, _ in spec.columns], CORRUPT)
    checks = [F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit(CORRUPT).alias("column"), F.col(CORRUPT).alias("raw"),
                                                          F.lit("wrong number of fields").alias("reason")))]
    for n, t in spec.columns:
        bad = F.col(n).isNotNull() & F.col(n).try_cast(t).isNull()
        checks.append(F.when(bad, F.struct(F.lit(n).alias("column"), F.col(n).alias("raw"),
                                           F.lit(f"{n}: not a {t}").alias("reason"))))
    flagged = cleaned.withColumn("_bad", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    good = flagged.filter(F.size("_bad") == 0).select(
        *[F.col(n).cast(t).alias(n) for n, t in spec.columns])
    rejects = (flagged.filter(F.size("_bad") > 0)
               .select(F.col(key).try_cast("bigint").alias(key), F.explode("_bad").alias("b"))
               .select(key, F.col("b.raw").alias("raw_value"), F.col("b.reason").alias("reason")))
    return good, rejects


def write_csv(df: DataFrame, path: str, header: bool, gzip: bool = True) -> None:
    w = df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"')
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


# ---------------------------------------------------------------------------
# Keys: the product dimension is written to CSV from ``part`` and loaded back.
# ---------------------------------------------------------------------------

ARTICLE_SPEC = CsvSpec(columns=(
    ("article_id", "bigint"), ("article_name", "string"), ("article_category", "string"),
    ("article_brand", "string"), ("article_price", T.PRICE)), header=True)

def _part_as_strings() -> list[Column]:
    return [F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), F.col("p_brand"),
            F.col("p_retailprice").cast("string")]

_ARTICLE_SQL = ("SELECT p_partkey AS article_id, p_name AS article_name, p_type AS article_category, "
                "p_brand AS article_brand, CAST(p_retailprice AS DECIMAL(10,2)) AS article_price FROM part")

# Fixed values of the test files: which parts carry a null token as brand,
# and which carry an unreadable price (by size class, not by id).
TOKEN_BY_SIZE = ((10, "NULL"), (20, " None "), (25, ""))
BAD_PRICE_MIN_SIZE = 45
BAD_PRICE_TEXT = "n/a"


@register("csv_ingest", _ARTICLE_SQL)
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv_ingest")
    part = T.read(spark, sf_dir, "part")
    write_csv(part.select(*[c.alias(n) for c, (n, _) in zip(_part_as_strings(), ARTICLE_SPEC.columns)]),
              path, header=True)
    return read_typed(spark, path, ARTICLE_SPEC)


def _brand_with_tokens() -> Column:
    expr = F.col("p_brand")
    for hi, token in reversed(TOKEN_BY_SIZE):
        expr = F.when(F.col("p_size") <= hi, F.lit(token)).otherwise(expr)
    return expr


@register("csv_null_tokens",
          f"SELECT p_partkey AS article_id, CASE WHEN p_size <= {TOKEN_BY_SIZE[-1][0]} THEN NULL ELSE p_brand END "
          "AS article_brand FROM part")
def csv_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv_null_tokens")
    part = T.read(spark, sf_dir, "part")
    cols = _part_as_strings()
    cols[3] = _brand_with_tokens()
    write_csv(part.select(*[c.alias(n) for c, (n, _) in zip(cols, ARTICLE_SPEC.columns)]), path, header=True)
    return read_typed(spark, path, ARTICLE_SPEC).select("article_id", "article_brand")


@register("csv_rejects",
          f"SELECT p_partkey AS article_id, '{BAD_PRICE_TEXT}' AS raw_value, "
          f"'article_price: not a {T.PRICE}' AS reason FROM part WHERE p_size > {BAD_PRICE_MIN_SIZE}")
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv_rejects")
    part = T.read(spark, sf_dir, "part")
    cols = _part_as_strings()
    cols[4] = F.when(F.col("p_size") > BAD_PRICE_MIN_SIZE, F.lit(BAD_PRICE_TEXT)).otherwise(cols[4])
    write_csv(part.select(*[c.alias(n) for c, (n, _) in zip(cols, ARTICLE_SPEC.columns)]), path, header=False)
    spec = CsvSpec(columns=ARTICLE_SPEC.columns, header=False)
    _, rejects = split_rejects(spark, path, spec, "article_id")
    return rejects
