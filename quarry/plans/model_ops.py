"""Operations on the semantic model itself: synonym resolution, sample
values, table profiles, validation of the model against the data, and the
lookup of stored (verified) questions.

The model is driver-side metadata of fixed size (its field, metric and
synonym lists); everything that touches rows is a Spark plan. Tables derived
from the model (synonyms, stored questions) are bounded by the model's size,
which is what allows them to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.plans.registry import TOP_K, register
from quarry.plans.semantic import SALES_MODEL, SemanticModel, UNBOUND_FIELDS
from quarry.sources import tables as T

# --- M7 synonyms ----------------------------------------------------------------


def synonym_rows(model: SemanticModel = SALES_MODEL) -> list[tuple[str, str, str, int]]:
    """(phrase, kind, target, priority). Priority (D11): metric 0, dimension of
    the fact table 1, other dimension 2, fact 3; names count as synonyms."""
    rows = []
    for m in model.metrics.values():
        for s in (m.name.replace("_", " "),) + m.synonyms:
            rows.append((s.lower(), "metric", m.name, 0))
    for f in model.fields.values():
        if f.kind == "fact":
            pr, kind = 3, "fact"
        elif f.table == model.fact_table:
            pr, kind = 1, f.kind
        else:
            pr, kind = 2, f.kind
        for s in (f.name.replace("_", " "),) + f.synonyms:
            rows.append((s.lower(), kind, f.name, pr))
    return rows


def longest_phrase(model: SemanticModel = SALES_MODEL) -> int:
    """Words of the model's longest name or synonym."""
    return max(len(phrase.split()) for phrase, *_ in synonym_rows(model))


def ngrams(tok, n_max: int):
    """All 1..n_max-grams of a token array, as space-joined strings."""
    def gram_at(n: int):
        # one-argument lambda: a two-argument one is read as (element, index)
        return lambda i: F.array_join(F.slice(tok, i + 1, n), " ")

    grams = []
    empty = F.array().cast("array<string>")
    for n in range(1, n_max + 1):
        g = F.transform(F.sequence(F.lit(0), F.size(tok) - n), gram_at(n))
        grams.append(F.when(F.size(tok) >= n, g).otherwise(empty))
    return F.flatten(F.array(*grams))


def resolve_synonyms(spark: SparkSession, texts: DataFrame, text_col: str,
                     model: SemanticModel = SALES_MODEL) -> DataFrame:
    """Words/phrases of ``texts`` that name a model element: ``(word, kind,
    target, occurrences)``; a phrase naming several elements resolves by
    priority (metric first)."""
    syn = spark.createDataFrame(synonym_rows(model), "word string, kind string, target string, priority int")
    best = (syn.groupBy("word")
            .agg(F.min_by(F.struct("kind", "target"), F.struct("priority", "target")).alias("t"))
            .select("word", "t.kind", "t.target"))
    tok = X.tokens(text_col)
    phrases = texts.select(F.explode(F.array_distinct(ngrams(tok, longest_phrase(model)))).alias("word"))
    hits = phrases.join(F.broadcast(best), "word")
    return hits.groupBy("word", "kind", "target").agg(F.count(F.lit(1)).alias("occurrences"))


def _sql_synonyms(model: SemanticModel = SALES_MODEL) -> str:
    vals = ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', '{k}', '{t}', {p})" for w, k, t, p in synonym_rows(model))
    tok = X.sql_tokens("text")
    grams = " || ".join(
        f"list_transform(range(0, len(tok) - {n} + 1), lambda i: array_to_string(tok[i + 1:i + {n}], ' '))"
        for n in range(1, longest_phrase(model) + 1))
    return (
        f"WITH syn AS (SELECT * FROM (VALUES {vals}) AS s(word, kind, target, priority)), "
        "best AS (SELECT word, arg_min(kind, (priority, target)) AS kind, arg_min(target, (priority, target)) AS target "
        "FROM syn GROUP BY word), "
        f"t AS (SELECT {tok} AS tok FROM conversations WHERE role = 'user'), "
        f"ph AS (SELECT unnest(list_distinct({grams})) AS word FROM t) "
        "SELECT ph.word, b.kind, b.target, CAST(COUNT(*) AS BIGINT) AS occurrences "
        "FROM ph JOIN best b ON ph.word = b.word GROUP BY 1, 2, 3")


@register("synonym_resolution", _sql_synonyms())
def synonym_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business words in the user turns of ``conversations`` mapped to the model."""
    conv = T.read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return resolve_synonyms(spark, conv, "text")


# --- M8 sample values -------------------------------------------------------

SAMPLE_COLUMNS = {
    "dim_article": ("article_category", "article_brand", "article_color"),
    "dim_customer": ("customer_region", "customer_segment"),
}


def sample_values(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    """The k most frequent values of each dimension column (ties by value):
    one scan per table, columns stacked with ``explode``, grouped top-k."""
    loaders = {"dim_article": T.dim_article, "dim_customer": T.dim_customer}
    out = None
    for table, cols in SAMPLE_COLUMNS.items():
        df = loaders[table](spark, sf_dir)
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s"))
        part = stacked.select("s.column_name", "s.value")
        out = part if out is None else out.unionByName(part)
    counts = out.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sql_sample_values(k: int = TOP_K) -> str:
    parts = []
    for table, cols in SAMPLE_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}")
    body = " UNION ALL ".join(parts)
    return T.with_views(
        f"WITH s AS ({body}), c AS (SELECT column_name, value, CAST(COUNT(*) AS BIGINT) AS n FROM s "
        "WHERE value IS NOT NULL GROUP BY 1, 2), "
        "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c) "
        f"SELECT column_name, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}",
        "dim_article", "dim_customer")


register("sample_values", _sql_sample_values())(sample_values)


# --- M10 profile ------------------------------------------------------------

PROFILE_TABLES = {
    "fact_sales": ("sale_id", "article_id", "date_sales", "customer_id", "quantity_sold",
                   "total_price", "sales_channel", "is_return"),
    "dim_article": ("article_id", "article_name", "article_category", "article_brand",
                    "article_color", "article_price"),
}


PROFILE = ("table_name", "column_name", "nulls", "distinct_values", "min_value", "max_value", "top_value", "top_count")


def profile_table(df: DataFrame, table: str, columns, exact_distinct: bool = True) -> DataFrame:
    """Per column: nulls, distinct non-null values, min, max and the most frequent value (all as
    text; ties by value) with its count, from one scan.

    Exact: ``(column, value)`` rows, which a partial aggregate collapses before the
    shuffle, are counted; bounds are taken from the counted values in the columns' own types
    (a bigint keeps all its digits). Otherwise one aggregate with sketches: HyperLogLog++ for the
    distinct values and ``approx_top_k`` for the most frequent one. A table without
    rows has zero counts and null values.
    """
    if not exact_distinct:
        def described(c: str) -> list[Column]:
            v, top = F.col(c), F.expr(f"get(filter(approx_top_k(`{c}`, 2), x -> x.item is not null), 0)")
            return [F.lit(c).alias("column_name"), F.count_if(v.isNull()).alias("nulls"),
                    F.approx_count_distinct(v).alias("distinct_values"), F.min(v).cast("string").alias("min_value"),
                    F.max(v).cast("string").alias("max_value"), top["item"].cast("string").alias("top_value"),
                    F.coalesce(top["count"], F.lit(0).cast("bigint")).alias("top_count")]
        wide = df.agg(F.array(*[F.struct(*described(c)) for c in columns]).alias("facts"))
        rows = wide.select(F.explode("facts").alias("f")).select("f.*")
        return rows.select(F.lit(table).alias("table_name"), *PROFILE[1:])

    kinds = dict(df.dtypes)
    counted = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s"))
        .groupBy("s.column_name", "s.value").agg(F.count(F.lit(1)).alias("n")))

    def bound(pick) -> Column:
        own = [pick(F.when(F.col("column_name") == c, F.col("value").cast(kinds[c]))).cast("string") for c in columns]
        return F.coalesce(*own)

    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))
    facts = counted.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("distinct_values"),
        bound(F.min).alias("min_value"), bound(F.max).alias("max_value"), top.alias("top"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("bigint"))

    return names.join(facts, "column_name", "left").select(
        F.lit(table).alias("table_name"), "column_name", zero(F.col("nulls")).alias("nulls"),
        zero(F.col("distinct_values")).alias("distinct_values"), "min_value", "max_value",
        F.col("top.value").alias("top_value"), zero(-F.col("top.n")).alias("top_count"))


@register("table_profile", T.with_views(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, "
    f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_values, CAST(MIN({c}) AS VARCHAR) AS min_value, "
    f"CAST(MAX({c}) AS VARCHAR) AS max_value, "
    f"(SELECT CAST({c} AS VARCHAR) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top_value, "
    f"COALESCE((SELECT CAST(COUNT(*) AS BIGINT) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY COUNT(*) DESC LIMIT 1), 0) AS top_count FROM {t}"
    for t, cols in PROFILE_TABLES.items() for c in cols), *PROFILE_TABLES.keys()))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cols in PROFILE_TABLES.items():
        df = (T.fact_sales(spark, sf_dir) if t == "fact_sales" else T.dim_article(spark, sf_dir)).select(*cols)
        part = profile_table(df, t, cols)
        out = part if out is None else out.unionByName(part)
    return out


# --- M9 validation ----------------------------------------------------------

def _key_text(columns) -> Column:
    """One text per key value (null for a null single column)."""
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.to_json(F.struct(*columns))


def validate_model(spark: SparkSession, sf_dir: str, model: SemanticModel = SALES_MODEL) -> DataFrame:
    """``(check_name, violations)``: declared keys unique, relationships many-to-one
    without orphans, declared sample values present in the data.

    Every table is scanned once for its keys: they are stacked into ``(key set,
    value)`` rows and collapsed by one partial + final aggregate, which serves
    duplicates and orphans alike. Sample values are flags of one global
    aggregate a table.
    """
    keys: dict[str, set[tuple[str, ...]]] = {}
    checks, relations = [], []
    for t in model.tables.values():
        keys.setdefault(t.name, set()).add(tuple(t.primary_key))
        checks.append((f"primary_key:{t.name}.{','.join(t.primary_key)}", f"{t.name}.{','.join(t.primary_key)}"))
    for r in model.relationships:
        keys.setdefault(r.left_table, set()).add((r.left_column,))
        keys.setdefault(r.right_table, set()).add((r.right_column,))
        relations.append((f"relationship:{r.name}", f"{r.left_table}.{r.left_column}", f"{r.right_table}.{r.right_column}"))
        checks.append((f"many_to_one:{r.name}", f"{r.right_table}.{r.right_column}"))

    stacked = None
    for table, sets in keys.items():
        df = model.tables[table].loader(spark, sf_dir, sorted({c for s in sets for c in s}))
        part = df.select(F.explode(F.array(*[
            F.struct(F.lit(f"{table}.{','.join(s)}").alias("key_set"), _key_text(s).alias("k")) for s in sorted(sets)])).alias("s"))
        stacked = part.select("s.*") if stacked is None else stacked.unionByName(part.select("s.*"))
    counts = stacked.groupBy("key_set", "k").agg(F.count(F.lit(1)).alias("n"))

    duplicates = counts.groupBy("key_set").agg(F.count_if(F.col("n") > 1).alias("violations"))
    asked = spark.createDataFrame(checks, "check_name string, key_set string")
    out = asked.join(duplicates, "key_set", "left").select("check_name", "violations")
    if relations:
        ends = spark.createDataFrame(relations, "check_name string, child string, parent string")
        child = counts.filter("k is not null").join(F.broadcast(ends), F.col("key_set") == F.col("child"))
        parent = (counts.join(F.broadcast(ends.withColumnRenamed("check_name", "c")), F.col("key_set") == F.col("parent"))
                  .select(F.col("c").alias("check_name"), "k"))
        lost = (child.select("check_name", "k", "n").join(parent, ["check_name", "k"], "left_anti")
                .groupBy("check_name").agg(F.sum("n").cast("bigint").alias("violations")))
        out = out.unionByName(ends.select("check_name").join(lost, "check_name", "left"))

    by_table: dict[str, list] = {}
    for f in model.fields.values():
        if f.sample_values and f.name not in UNBOUND_FIELDS:
            by_table.setdefault(f.table, []).append(f)
    for table, fields in by_table.items():
        df = model.tables[table].loader(spark, sf_dir, [f.name for f in fields])

        def missing(f):
            there = [F.coalesce(F.max((F.col(f.name).cast("string") == v).cast("bigint")), F.lit(0).cast("bigint"))
                     for v in f.sample_values]
            return F.struct(F.lit(f"sample_values:{f.name}").alias("check_name"),
                            (F.lit(len(there)).cast("bigint") - sum(there[1:], there[0])).alias("violations"))
        out = out.unionByName(df.agg(F.array(*[missing(f) for f in fields]).alias("s")).select(F.explode("s").alias("s")).select("s.*"))
    return out.withColumn("violations", F.coalesce("violations", F.lit(0).cast("bigint")))


def _sql_validation(model: SemanticModel = SALES_MODEL) -> str:
    parts = []
    for t in model.tables.values():
        k = ", ".join(t.primary_key)
        parts.append(f"SELECT 'primary_key:{t.name}.{','.join(t.primary_key)}' AS check_name, "
                     f"CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT) AS violations "
                     f"FROM (SELECT COUNT(*) AS n FROM {t.name} GROUP BY {k})")
    for r in model.relationships:
        parts.append(f"SELECT 'relationship:{r.name}', CAST(COUNT(*) AS BIGINT) FROM {r.left_table} c "
                     f"WHERE c.{r.left_column} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {r.right_table} p WHERE p.{r.right_column} = c.{r.left_column})")
        parts.append(f"SELECT 'many_to_one:{r.name}', CAST(COUNT(*) FILTER (WHERE n > 1) AS BIGINT) "
                     f"FROM (SELECT COUNT(*) AS n FROM {r.right_table} GROUP BY {r.right_column})")
    for f in model.fields.values():
        if not f.sample_values or f.name in UNBOUND_FIELDS:
            continue
        vals = ", ".join(f"('{v}')" for v in f.sample_values)
        parts.append(f"SELECT 'sample_values:{f.name}', CAST(COUNT(*) AS BIGINT) FROM (VALUES {vals}) AS d(v) "
                     f"WHERE v NOT IN (SELECT CAST({f.name} AS VARCHAR) FROM {f.table} WHERE {f.name} IS NOT NULL)")
    return T.with_views(" UNION ALL ".join(parts), "fact_sales", "dim_article", "dim_customer")


register("model_validation", _sql_validation())(lambda spark, sf_dir: validate_model(spark, sf_dir))


# --- M11 verified questions ------------------------------------------------------

# The stored questions of the reference model, by name.
VERIFIED_QUESTIONS = (
    ("total_revenue_for_product_last_year", "What is the total revenue for the Carver Skis during last year?"),
    ("ski_products_ranked_by_revenue", "What ski products have the highest and lowest sales, ranked by total revenue?"),
    ("revenue_by_region_and_category", "What is the total revenue by customer region and product category?"),
    ("top_products_by_revenue_excl_returns", "What are the top performing products by total revenue excluding returns?"),
)


def lookup_verified(spark: SparkSession, questions: DataFrame, id_cols, text_col: str) -> DataFrame:
    """Nearest stored question by token Jaccard, per incoming question.

    The stored questions are part of the model (a handful of constants), so each
    incoming row is scored against all of them in one projection: no shuffle.
    """
    q = questions.select(*id_cols, F.array_distinct(X.tokens(text_col)).alias("qtok"))

    def scored(name: str, question: str) -> Column:
        stok = F.array_distinct(X.tokens(F.lit(question)))
        both = F.size(F.array_intersect("qtok", stok))
        score = F.round(both / (F.size("qtok") + F.size(stok) - both), 6)
        return F.when(both > 0, F.struct((-score).alias("worse"), F.lit(name).alias("name")))

    best = F.array_min(F.array_compact(F.array(*[scored(n, text) for n, text in VERIFIED_QUESTIONS])))
    return q.select(*id_cols, best.alias("b")).select(
        *id_cols, F.col("b.name").alias("matched"), F.coalesce(-F.col("b.worse"), F.lit(0.0)).alias("score"))


def _sql_lookup() -> str:
    vals = ", ".join(f"('{n}', '{q}')" for n, q in VERIFIED_QUESTIONS)
    return (
        f"WITH st AS (SELECT name, list_distinct({X.sql_tokens('question')}) AS stok FROM (VALUES {vals}) AS v(name, question)), "
        f"q AS (SELECT conv_id, turn, list_distinct({X.sql_tokens('text')}) AS qtok FROM conversations WHERE role = 'user'), "
        "qt AS (SELECT conv_id, turn, unnest(qtok) AS token FROM q), "
        "stt AS (SELECT name, unnest(stok) AS token FROM st), "
        "i AS (SELECT conv_id, turn, name, COUNT(*) AS i FROM qt JOIN stt USING (token) GROUP BY 1, 2, 3), "
        "s AS (SELECT i.conv_id, i.turn, i.name, ROUND(i.i / (len(q.qtok) + len(st.stok) - i.i), 6) AS score "
        "FROM i JOIN q USING (conv_id, turn) JOIN st USING (name)), "
        "b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, name) AS r FROM s) WHERE r = 1) "
        "SELECT q.conv_id, q.turn, b.name AS matched, COALESCE(b.score, 0.0) AS score "
        "FROM q LEFT JOIN b USING (conv_id, turn)")


@register("verified_query_lookup", _sql_lookup())
def verified_query_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn of ``conversations`` matched to its nearest stored question."""
    conv = T.read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return lookup_verified(spark, conv, ["conv_id", "turn"], "text")
