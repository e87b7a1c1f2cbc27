"""Connected components of a link table, and a join that survives hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import stash_narrow

SALTS = 64


def with_minimum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the least ``value`` of its ``key``. A hot key is summed and joined
    in SALTS parts, so no task holds all its rows."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = df.groupBy(key, "_salt").agg(F.min(value).alias("_low"))
    tops = parts.groupBy(key).agg(F.min("_low").alias(out))
    whole = parts.select(key, "_salt").join(tops, key)
    return df.join(whole, [key, "_salt"]).drop("_salt")


def minima(edges: DataFrame, name: str) -> DataFrame:
    """(u, low): least neighbour of every u. Written out, so that the join with the
    edges has a plain shuffle on either side (a hot node is then split as a skewed
    join) or a broadcast where Spark finds the table small enough."""
    return stash_narrow(edges.groupBy("u").agg(F.min("v").alias("low")), name)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least
    node reachable. Alternates large-star and small-star steps until nothing moves;
    every step is written to the shared folder, so lineage stays short."""
    edges = stash_narrow(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
                  "links")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(minima(both, "links-low"), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("low", "u").alias("v")))
        small = large.join(minima(large, "links-low"), "u")
        stars = F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
        edges = stash_narrow(small.select(F.explode(stars).alias("e")).select("e.*").filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
