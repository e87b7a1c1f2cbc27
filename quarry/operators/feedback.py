"""Voice-of-customer analyses: satisfaction per product, recurring themes per
product category, praise and complaint per product, and feedback next to sales.

Feedback rows are the ``comments`` binding (documents with a product and a
labelled satisfaction). Each side is aggregated to one row per product
before the two meet, so the join is product-to-product, never
comment-to-sale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.plans.registry import TOP_K, register
from quarry.sources import tables as T


def satisfaction(comments: DataFrame) -> DataFrame:
    return comments.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("comments"),
        F.count("satisfaction").alias("rated"),
        F.round(F.avg(F.col("satisfaction").cast("double")), 6).alias("satisfaction"))


@register("satisfaction_by_product", T.with_views(
    "SELECT article_id, CAST(COUNT(*) AS BIGINT) AS comments, CAST(COUNT(satisfaction) AS BIGINT) AS rated, "
    "ROUND(AVG(CAST(satisfaction AS DOUBLE)), 6) AS satisfaction FROM comments GROUP BY article_id", "comments"))
def satisfaction_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satisfaction(T.comments(spark, sf_dir, ("article_id", "satisfaction")))


def themes(comments: DataFrame, group_col: str, k: int = TOP_K) -> DataFrame:
    """Top-k terms per group by number of comments using them (stop words
    dropped; ties by term)."""
    toks = F.filter(F.array_distinct(X.tokens("comment_text")), lambda t: ~t.isin(*X.STOP_WORDS))
    terms = comments.select(group_col, F.explode(toks).alias("term"))
    counts = terms.groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("comments"))
    w = Window.partitionBy(group_col).orderBy(F.desc("comments"), F.asc("term"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _stop_list_sql() -> str:
    return ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@register("themes_by_product", T.with_views(
    f"WITH c AS (SELECT da.article_category, list_distinct({X.sql_tokens('cm.comment_text')}) AS tok "
    "FROM comments cm JOIN dim_article da ON cm.article_id = da.article_id), "
    "t AS (SELECT article_category, unnest(tok) AS term FROM c), "
    f"n AS (SELECT article_category, term, CAST(COUNT(*) AS BIGINT) AS comments FROM t "
    f"WHERE term NOT IN ({_stop_list_sql()}) GROUP BY 1, 2), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_category ORDER BY comments DESC, term) AS rank FROM n) "
    f"SELECT article_category, term, comments, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP_K}",
    "comments", "dim_article"))
def themes_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring terms in the feedback of each product category."""
    c = T.comments(spark, sf_dir, ("article_id", "comment_text"))
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    return themes(c.join(art, "article_id"), "article_category")


def terms_and_pairs(text: str = "comment_text") -> Column:
    """Distinct words and neighbouring word pairs of a text, without stop words."""
    tok = X.tokens(text)
    pairs = F.zip_with(F.slice(tok, 1, F.greatest(F.size(tok) - 1, F.lit(0))), F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0))),
                       lambda a, b: F.when(~a.isin(*X.STOP_WORDS) & ~b.isin(*X.STOP_WORDS), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(F.filter(tok, lambda t: ~t.isin(*X.STOP_WORDS)), F.array_compact(pairs)))


def keyness(comments: DataFrame, group_col: str, k: int = TOP_K) -> DataFrame:
    """Terms that tell a product's praise from its complaints: per group and polarity the k words or
    word pairs of largest log-likelihood ratio between satisfied and unsatisfied comments.

    Counts are (group, term) rows with one column a polarity, so a term of a third of
    all comments is one row before the shuffle; comment numbers per group come
    from the same rated rows."""
    rated = comments.filter("satisfaction IS NOT NULL").withColumn("good", (F.col("satisfaction") > 0).cast("int"))
    sizes = rated.groupBy(group_col).agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    counts = (rated.select(group_col, "good", F.explode(terms_and_pairs()).alias("term"))
              .groupBy(group_col, "term").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b")))
    both = counts.join(sizes, group_col).filter("n_good > 0 AND n_bad > 0")
    share = (F.col("a") + F.col("b")).cast("double") / (F.col("n_good") + F.col("n_bad"))

    def part(n: str, size: str) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col(size) * share))).otherwise(0.0)

    apart = F.col("a") * F.col("n_bad") - F.col("b") * F.col("n_good")
    scored = both.select(
        group_col, "term", F.when(apart > 0, "praise").when(apart < 0, "complaint").alias("polarity"),
        F.when(apart > 0, F.col("a")).otherwise(F.col("b")).alias("comments"),
        F.round(2 * (part("a", "n_good") + part("b", "n_bad")), 6).alias("ratio")).filter("polarity IS NOT NULL")
    w = Window.partitionBy(group_col, "polarity").orderBy(F.desc("ratio"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sql_keyness() -> str:
    tok = X.sql_tokens("cm.comment_text")
    return T.with_views(
        f"WITH c AS (SELECT da.article_name, (cm.satisfaction > 0)::INT AS good, {tok} AS tok FROM comments cm JOIN dim_article da "
        "ON cm.article_id = da.article_id WHERE cm.satisfaction IS NOT NULL), "
        "z AS (SELECT article_name, SUM(good) AS n_good, SUM(1 - good) AS n_bad FROM c GROUP BY 1), "
        f"t AS (SELECT article_name, good, unnest(list_distinct(list_concat(list_filter(tok, lambda t: t NOT IN ({_stop_list_sql()})), "
        "list_transform(list_filter(range(1, len(tok)), "
        f"lambda i: tok[i] NOT IN ({_stop_list_sql()}) AND tok[i + 1] NOT IN ({_stop_list_sql()})), "
        "lambda i: tok[i] || ' ' || tok[i + 1])))) AS term FROM c), "
        "n AS (SELECT article_name, term, SUM(good) AS a, SUM(1 - good) AS b FROM t GROUP BY 1, 2), "
        "j AS (SELECT *, (a + b)::DOUBLE / (n_good + n_bad) AS share FROM n JOIN z USING (article_name) WHERE n_good > 0 AND n_bad > 0), "
        "s AS (SELECT article_name, term, CASE WHEN a * n_bad > b * n_good THEN 'praise' WHEN a * n_bad < b * n_good THEN 'complaint' END "
        "AS polarity, CAST(CASE WHEN a * n_bad > b * n_good THEN a ELSE b END AS BIGINT) AS comments, "
        "ROUND(2 * ((CASE WHEN a > 0 THEN a * ln(a / (n_good * share)) ELSE 0.0 END) "
        "+ (CASE WHEN b > 0 THEN b * ln(b / (n_bad * share)) ELSE 0.0 END)), 6) AS ratio FROM j), "
        "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_name, polarity ORDER BY ratio DESC, term) AS rank FROM s "
        "WHERE polarity IS NOT NULL) "
        f"SELECT article_name, term, polarity, comments, ratio, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP_K}",
        "comments", "dim_article")


@register("themes_praise_complaint", _sql_keyness())
def themes_praise_complaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What satisfied and unsatisfied customers say of each product."""
    c = T.comments(spark, sf_dir, ("article_id", "comment_text", "satisfaction"))
    art = T.dim_article(spark, sf_dir).select("article_id", "article_name")
    return keyness(c.join(art, "article_id"), "article_name")


@register("feedback_vs_sales", T.with_views(
    "WITH f AS (SELECT article_id, COUNT(*) AS comments, ROUND(AVG(CAST(satisfaction AS DOUBLE)), 6) AS satisfaction "
    "FROM comments GROUP BY article_id), "
    "s AS (SELECT article_id, CAST(SUM(total_price) AS DECIMAL(38,2)) AS total_revenue, "
    "CAST(COUNT(*) FILTER (WHERE is_return) AS BIGINT) AS returns FROM fact_sales GROUP BY article_id) "
    "SELECT da.article_id, da.article_category, CAST(COALESCE(f.comments, 0) AS BIGINT) AS comments, f.satisfaction, "
    "s.total_revenue, s.returns FROM dim_article da LEFT JOIN f ON da.article_id = f.article_id "
    "LEFT JOIN s ON da.article_id = s.article_id", "comments", "fact_sales", "dim_article"))
def feedback_vs_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: comment count, mean satisfaction, revenue and returns."""
    f = satisfaction(T.comments(spark, sf_dir, ("article_id", "satisfaction"))).select("article_id", "comments", "satisfaction")
    s = (T.fact_sales(spark, sf_dir, ["article_id", "total_price", "is_return"])
         .groupBy("article_id")
         .agg(F.sum("total_price").cast(T.SUM_MONEY).alias("total_revenue"),
              F.count_if("is_return").alias("returns")))
    art = T.dim_article(spark, sf_dir).select("article_id", "article_category")
    return (art.join(f, "article_id", "left").join(s, "article_id", "left")
            .select("article_id", "article_category",
                    F.coalesce("comments", F.lit(0).cast("bigint")).alias("comments"),
                    "satisfaction", "total_revenue", "returns"))
