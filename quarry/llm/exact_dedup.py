"""Exact dedup by two-pass Bloom filtering (operator 6).

Texts are equal when identical after every run of white space
``[\\x20\\x09-\\x0D]+`` became one space (null counts as empty). Pass one sets
Bloom bits for every text hash and keeps the bits that two rows set; pass two
tests every row. Only rows that pass shuffle, as (digest, id) without text;
all others are unique and go straight through.

Defined cases: null and empty texts are equal to each other; of equal texts the
smallest id stays (ties cannot occur on a unique id; a repeated (id, text) row
counts in ``group_size`` and every such row is returned); an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bloom import filter_bits, may_contain, repeated_plane
from quarry.llm.common import fresh_name, prepare, stash

MAX_FILTER_BYTES = 64 << 20    # size bound of the broadcast filter
SALTS = 64                     # parts that a group of equal texts is dealt into for its join


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    spark = docs.sparkSession
    prepare(spark)
    digest = stash(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
            .withColumn("key", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint")),
        "exact-digests")
    bits = filter_bits(digest.count(), max_filter_bytes)
    plane = repeated_plane(digest, "key", bits)
    tested = digest.withColumn("maybe", may_contain(digest, "key", plane, bits)).drop("key")

    unique = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest")
    # A group of copies may hold a third of all rows: its parts are summed first, and the result goes
    # back to each part, so that no task joins the whole group.
    maybe = tested.filter("maybe").select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    parts = maybe.groupBy("digest", "salt").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    whole = parts.select("digest", "salt").join(groups, "digest")
    shared = maybe.join(whole, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "digest")
    return unique.unionAll(shared).select(
        "doc_id", "keep_id", "group_size", F.equal_null("doc_id", "keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, all columns as they were."""
    gone = fresh_name(docs, "dropped")
    dropped = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(gone))
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
