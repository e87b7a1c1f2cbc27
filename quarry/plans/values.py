"""Word to (dimension, value): a dictionary of the model's text values with fuzzy lookup.

A word finds a value when they are equal in lower case, or one typing error apart: a
character too many, too few or another. Both sides are taken to their deletion
neighbourhood (the text itself and every text with one character left out): texts within
one error always share a neighbour, so the lookup is an equi-join on neighbours, checked by
the edit distance. No word meets a value that it shares no neighbour with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.sources import tables as T

VALUE_COLUMNS = {
    "dim_article": ("article_name", "article_category", "article_brand", "article_color"),
    "dim_customer": ("customer_region", "customer_segment"),
}


def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dimension, value, n): the distinct values of the text dimensions and how often each occurs;
    one scan a table."""
    out = None
    for table, load in (("dim_article", T.dim_article), ("dim_customer", T.dim_customer)):
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"))
                                    for c in VALUE_COLUMNS[table]]))
        part = load(spark, sf_dir).select(cells.alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    return out.filter("value IS NOT NULL").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def neighbours(text: str) -> Column:
    """``text`` (a lower-case column) and every text with one of its characters left out."""
    c = F.col(text)
    places = F.sequence(F.lit(1), F.length(c))
    fewer = F.transform(places, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, fewer).otherwise(F.array().cast("array<string>"))))


def find_values(words: DataFrame, values: DataFrame) -> DataFrame:
    """(word, dimension, value, distance) for ``words`` (word) within one error of a value."""
    asked = words.filter("word IS NOT NULL").select("word", F.lower("word").alias("low")).distinct()
    known = values.select("dimension", "value", F.lower("value").alias("own")).distinct()
    pairs = (asked.withColumn("key", F.explode(neighbours("low")))
             .join(known.withColumn("key", F.explode(neighbours("own"))), "key")
             .withColumn("distance", F.levenshtein("low", "own")))
    return pairs.filter("distance <= 1").select("word", "dimension", "value", "distance").distinct()


# Words of the key: every brand and colour as it is, and with a typing error (the
# second character missing, another last character, a character doubled).
_SQL_WORDS = ("SELECT DISTINCT unnest([v, left(v, 1) || substr(v, 3), left(v, length(v) - 1) || 'q', left(v, 2) || substr(v, 2), "
              "upper(v)]) AS word FROM (SELECT p_brand AS v FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part)")


def typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    art = T.dim_article(spark, sf_dir)
    own = art.select(F.explode(F.array("article_brand", "article_color")).alias("v"))
    forms = F.array(v, F.concat(F.left(v, F.lit(1)), F.substr(v, F.lit(3))), F.concat(F.left(v, F.length(v) - 1), F.lit("q")),
                    F.concat(F.left(v, F.lit(2)), F.substr(v, F.lit(2))), F.upper(v))
    return own.select(F.explode(forms).alias("word")).distinct()


_SQL_VALUES = T.with_views(
    "WITH d AS (" + " UNION ".join(f"SELECT '{c}' AS dimension, {c} AS value FROM {t}" for t, cols in VALUE_COLUMNS.items() for c in cols)
    + f"), w AS ({_SQL_WORDS}) SELECT DISTINCT word, dimension, value, CAST(levenshtein(lower(word), lower(value)) AS INTEGER) AS distance "
    "FROM w, d WHERE word IS NOT NULL AND value IS NOT NULL AND levenshtein(lower(word), lower(value)) <= 1", "dim_article", "dim_customer")


@register("word_to_value", _SQL_VALUES)
def word_to_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with and without a typing error, and the dimension values they stand for."""
    return find_values(typed_words(spark, sf_dir), value_dictionary(spark, sf_dir))
