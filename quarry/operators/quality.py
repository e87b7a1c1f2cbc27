"""Data-quality checks: row counts, NOT NULL, key uniqueness, foreign keys,
declared lengths, and dense surrogate ids.

All checks are one or two aggregation passes. Key checks aggregate the key
column first (map-side partial counts), so a key that holds a third of all
rows becomes one row before any shuffle or join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.sources import tables as T


def _stack(pairs: list[tuple[str, F.Column]], name_col: str, value_col: str) -> F.Column:
    """Turn one wide row of named values into rows via explode (no join)."""
    return F.explode(F.array(*[F.struct(F.lit(n).alias(name_col), v.alias(value_col)) for n, v in pairs]))


# --- Q1 row counts ----------------------------------------------------------

@register("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM {t}" for t in T.TABLES))
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [T.read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in T.TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table_name")


# --- Q5 NOT NULL ------------------------------------------------------------

# Declared NOT NULL columns of the star schema (reference table definitions).
NOT_NULL = {
    "fact_sales": ("sale_id", "article_id", "date_sales", "customer_id", "quantity_sold", "total_price"),
    "dim_article": ("article_id", "article_name", "article_category", "article_price"),
    "dim_customer": ("customer_id",),
    "comments": ("comment_id", "comment_text", "satisfaction"),     # unrated comments violate the last
}


def null_counts(df: DataFrame, table: str, columns) -> DataFrame:
    """One pass: ``count_if(c IS NULL)`` for every column, then stacked."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.select(_stack([(c, F.col(c)) for c in columns], "column_name", "violations").alias("s")) \
        .select(F.lit(table).alias("table_name"), "s.column_name", "s.violations")


def _view(spark, sf_dir, name):
    return {"fact_sales": T.fact_sales, "dim_article": T.dim_article,
            "dim_customer": T.dim_customer, "comments": T.comments}[name](spark, sf_dir)


@register("not_null_violations", T.with_views(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM {t}"
        for t, cols in NOT_NULL.items() for c in cols),
    *NOT_NULL.keys()))
def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cols in NOT_NULL.items():
        part = null_counts(_view(spark, sf_dir, t).select(*cols), t, cols)
        out = part if out is None else out.unionByName(part)
    return out


# --- Q6 primary keys --------------------------------------------------------

PRIMARY_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber"),
    "orders": ("o_orderkey",),
    "part": ("p_partkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
}


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Number of key values that occur more than once, and the surplus rows."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"),
    )


@register("pk_violations", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys, "
    f"CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS surplus_rows "
    f"FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY {', '.join(k)})"
    for t, k in PRIMARY_KEYS.items()))
def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables' keys in one aggregate: ``(table, key)`` rows are counted
    in a single partial + final aggregate (one shuffle for every table)."""
    keys = None
    for t, key in PRIMARY_KEYS.items():
        k = F.struct(*[F.col(c).cast("bigint").alias(f"k{i}") for i, c in enumerate(key)],
                     *[F.lit(None).cast("bigint").alias(f"k{i}") for i in range(len(key), 2)])
        part = T.read(spark, sf_dir, t).select(F.lit(t).alias("table_name"), k.alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    counts = keys.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("n"))
    per_table = counts.groupBy("table_name").agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("surplus_rows"))
    names = spark.createDataFrame([(t,) for t in PRIMARY_KEYS], "table_name string")
    return (names.join(per_table, "table_name", "left")
            .select("table_name",
                    F.coalesce("duplicate_keys", F.lit(0).cast("bigint")).alias("duplicate_keys"),
                    F.coalesce("surplus_rows", F.lit(0).cast("bigint")).alias("surplus_rows")))


# --- Q7 foreign keys --------------------------------------------------------

FOREIGN_KEYS = (
    ("lineitem.l_orderkey -> orders.o_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_partkey -> part.p_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_suppkey -> supplier.s_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.o_custkey -> customer.c_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer.c_nationkey -> nation.n_nationkey", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("labels.doc_id -> documents.doc_id", "labels", "doc_id", "documents", "doc_id"),
    # Not declared: checked because the data breaks it (documents without a label).
    ("documents.doc_id -> labels.doc_id", "documents", "doc_id", "labels", "doc_id"),
)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null key has no parent.

    The child is collapsed to (key, rows) first, so the anti join sees each
    key once however skewed the child is.
    """
    keys = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    parent_keys = parent.select(F.col(pk).alias("k"))
    missing = keys.join(parent_keys, "k", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("orphan_keys"),
                       F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"))


def _stacked_keys(spark: SparkSession, sf_dir: str, by_table: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``(relation, k)`` for every (relation, column) of every table, one
    scan per table: the table's key columns are stacked with ``explode``."""
    out = None
    for table, rels in by_table.items():
        arr = F.array(*[F.struct(F.lit(name).alias("relation"), F.col(col).cast("bigint").alias("k"))
                        for name, col in rels])
        part = T.read(spark, sf_dir, table).select(F.explode(arr).alias("s")).select("s.relation", "s.k")
        out = part if out is None else out.unionByName(part)
    return out


@register("fk_orphans", " UNION ALL ".join(
    f"SELECT '{name}' AS relation, CAST(COUNT(*) AS BIGINT) AS orphan_keys, "
    f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS orphans FROM "
    f"(SELECT {fk} AS k, COUNT(*) AS n FROM {c} WHERE {fk} IS NOT NULL GROUP BY {fk}) x "
    f"WHERE NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = x.k)"
    for name, c, fk, p, pk in FOREIGN_KEYS))
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every foreign key checked in one job: each child table is scanned once
    with its foreign-key columns stacked, collapsed to ``(relation, key,
    rows)`` (a hot key becomes one row before the shuffle), and anti-joined
    once against the stacked parent keys on ``(relation, key)``."""
    children: dict[str, list[tuple[str, str]]] = {}
    parents: dict[str, list[tuple[str, str]]] = {}
    for name, c, fk, p, pk in FOREIGN_KEYS:
        children.setdefault(c, []).append((name, fk))
        parents.setdefault(p, []).append((name, pk))
    child = (_stacked_keys(spark, sf_dir, children).filter(F.col("k").isNotNull())
             .groupBy("relation", "k").agg(F.count(F.lit(1)).alias("n")))
    parent = _stacked_keys(spark, sf_dir, parents)
    missing = (child.join(parent, ["relation", "k"], "left_anti")
               .groupBy("relation").agg(F.count(F.lit(1)).alias("orphan_keys"),
                                        F.sum("n").cast("bigint").alias("orphans")))
    names = spark.createDataFrame([(r[0],) for r in FOREIGN_KEYS], "relation string")
    return (names.join(missing, "relation", "left")
            .select("relation",
                    F.coalesce("orphan_keys", F.lit(0).cast("bigint")).alias("orphan_keys"),
                    F.coalesce("orphans", F.lit(0).cast("bigint")).alias("orphans")))


# --- Q8 declared lengths ----------------------------------------------------

# Declared VARCHAR(n) limits applied to the bound columns.
LENGTH_LIMITS = (
    ("documents", "text", 4000),
    ("part", "p_name", 255),
    ("pages", "url", 255),
)


@register("length_violations", " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS column_name, CAST({n} AS INTEGER) AS max_length, "
    f"CAST(COUNT(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) AS violations FROM {t}"
    for t, c, n in LENGTH_LIMITS))
def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c, n in LENGTH_LIMITS:
        part = T.read(spark, sf_dir, t).agg(F.count_if(F.length(c) > n).alias("violations")) \
            .select(F.lit(f"{t}.{c}").alias("column_name"), F.lit(n).alias("max_length"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


# --- K5 dense ids -----------------------------------------------------------

def with_dense_id(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Number rows 1..N without a global window (two passes).

    The input is checkpointed first so that both passes see the same rows in
    the same partitions. Pass one counts rows per partition (one row per
    partition); running offsets over those counts are a window over a table
    whose size is the partition count, then broadcast back.
    """
    from pyspark.sql import Window

    from quarry.operators.term_index import write_table
    from quarry.session import scratch_path
    base = write_table(df, scratch_path(df.sparkSession, "rows"))
    tagged = base.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_pos", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offsets = offsets.fillna(0, subset=["_off"])
    # monotonically_increasing_id = (partition id << 33) + position in partition
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, F.col("_off") + local + F.lit(1))
            .drop("_pid", "_pos", "_off"))
