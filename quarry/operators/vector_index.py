"""Inverted-list vector index with exact cosine top-k.

The number of lists follows the rows (about their square root); list centres are fitted
on a bounded sample (``SAMPLE_ROWS`` rows, chosen by id hash), every vector goes to the
list of its nearest centre. The index is a table in folders by list, rows sorted by their
cosine with the centre, and one row of figures a list: its size, and the smallest and
largest cosine of its members with the centre.

A search needs no fixed number of probes. With unit vectors q and v, centre c, b = q.c
and a = v.c: q.v <= a b + sqrt(1 - a^2) sqrt(1 - b^2). Over a list's range of a that
bounds every score in it. The ``FIRST`` lists of highest bound give each query a floor,
its k-th best score there; then every other list whose bound reaches the floor is read,
and no other. So the result is that of comparing all, and how much is read depends on how
well the vectors gather: little where they do, nearly all where they spread evenly in many
dimensions; ``candidates`` reports it. Within a list the same bound, row by
row from the stored cosines, spares the vectors that cannot reach the floor.

Defined cases: vectors that are null, of another length than the first one, or zero have no
cosine and are left out; ties go by ascending id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.term_index import write_table
from quarry.session import scratch_path

SAMPLE_ROWS = 50_000           # rows that list centres are fitted on
MAX_LISTS = 4096
ROUNDS = 8                     # k-means rounds on the sample
FIRST = 2                      # lists of highest bound that give a query's floor
MAX_QUERIES = 1024             # queries of a pass: their bounds for all lists stay on the driver
SLACK = 2e-6                   # scores are rounded to 6 decimals


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame         # vec_id, vec (unit, double), own (cosine with the centre), list
    centres: np.ndarray        # (lists, dimension), unit rows
    low: np.ndarray            # smallest and largest cosine with the centre, per list
    high: np.ndarray
    size: np.ndarray


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def fit_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from evenly spread sample rows."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        some = (sums * sums).sum(axis=1) > 0
        centres[some] = unit(sums[some])
    return centres


def build(vectors: DataFrame, path: str | None = None) -> VectorIndex:
    """Index of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-index")
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).filter(
        F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    head = own.orderBy("vec_id").select("vec").first()
    if head is None:
        empty = spark.createDataFrame([], "vec_id bigint, vec array<double>, own double, list int")
        return VectorIndex(empty, np.zeros((0, 0)), *[np.zeros(0)] * 3)
    dimension = len(head["vec"])
    own = own.filter(F.size("vec") == dimension)
    n = own.count()
    lists = max(1, min(MAX_LISTS, int(math.sqrt(n))))
    share = max(1, n // SAMPLE_ROWS)
    drawn = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS)
    sample = unit(np.array([r["vec"] for r in drawn.select("vec").toLocalIterator()]))
    centres = fit_centres(sample, min(lists, len(sample)))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(matrix(batch.column(1), dimension))
            cosine = v @ shared.value.T
            near = cosine.argmax(axis=1) if len(v) else np.zeros(0, np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dimension, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), flat, pa.array(cosine[np.arange(len(v)), near]), pa.array(near.astype(np.int32))],
                names=["vec_id", "vec", "own", "list"])

    rows = own.mapInArrow(place, "vec_id bigint, vec array<double>, own double, list int")
    table = write_table(rows.hint("rebalance", "list").sortWithinPartitions("list", "own"), path, "list")
    stats = table.groupBy("list").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count(F.lit(1)).alias("n")).toPandas()
    low, high, size = np.ones(len(centres)), -np.ones(len(centres)), np.zeros(len(centres), np.int64)
    at = stats["list"].to_numpy()
    low[at], high[at], size[at] = stats["low"], stats["high"], stats["n"]
    return VectorIndex(table, centres, low, high, size)


def bound(a_low, a_high, b):
    """Largest possible q.v for v.c in [a_low, a_high] and q.c = b."""
    best = np.clip(b, a_low, a_high)
    return best * b + np.sqrt(np.maximum(0, 1 - best * best)) * np.sqrt(np.maximum(0, 1 - b * b))


def _scan(index: VectorIndex, asked: dict[int, list[int]], q: np.ndarray, ids: list, kind: str, floor: np.ndarray, k: int) -> DataFrame:
    """Local top-k of the (list, queries) pairs of ``asked``: (query_id, vec_id, score); only these lists are read."""
    spark = index.vectors.sparkSession
    dimension = q.shape[1]
    shared = spark.sparkContext.broadcast((asked, q, ids, floor, q @ index.centres.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q, ids, floor, to_centre = shared.value
        for batch in batches:
            which = batch.column(3).to_numpy(zero_copy_only=False)
            vec_id, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            v = matrix(batch.column(1), dimension)
            out: list[tuple] = []
            for one in np.unique(which).tolist():
                rows = np.flatnonzero(which == one)
                for j in asked.get(one, ()):
                    able = rows[bound(own[rows], own[rows], to_centre[j, one]) >= floor[j] - SLACK]
                    if len(able):
                        score = np.round(v[able] @ q[j], 6)
                        best = np.lexsort((vec_id[able], -score))[:k]
                        out.append((j, vec_id[able][best], score[best], len(able)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j, found, _, _ in out for _ in found], type=arrow),
                 pa.array(np.concatenate([f for _, f, _, _ in out]) if out else np.zeros(0, np.int64)),
                 pa.array(np.concatenate([s for _, _, s, _ in out]) if out else np.zeros(0)),
                 pa.array(np.array([n if i == 0 else 0 for _, f, _, n in out for i in range(len(f))], np.int64))],
                names=["query_id", "vec_id", "score", "seen"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_type(_parse_datatype_string(kind))
    only = F.col("list").isin([int(x) for x in asked]) if asked else F.lit(False)
    return index.vectors.filter(only).select("vec_id", "vec", "own", "list").mapInArrow(
        run, f"query_id {kind}, vec_id bigint, score double, seen bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact cosine top-k of each query (query_id, vec): (query_id, rank, vec_id, score), and how
    many vectors were compared with each query (query_id, candidates)."""
    spark = queries.sparkSession
    passes = max(1, -(-queries.count() // MAX_QUERIES))
    out = None
    for i in range(passes):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        found = _pass(spark, index, some, k)
        out = found if out is None else tuple(a.unionByName(b) for a, b in zip(out, found))
    return out


def _pass(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.select("query_id", "vec").collect()
    if not rows or not len(index.centres):
        none = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id bigint, score double")
        return none, none.select("query_id", F.lit(0).cast("bigint").alias("candidates"))
    q, ids = unit(np.array([r["vec"] for r in rows], np.float64)), [r["query_id"] for r in rows]
    bounds = bound(index.low, index.high, q @ index.centres.T)
    bounds[:, index.size == 0] = -np.inf
    order = np.argsort(-bounds, axis=1, kind="stable")

    def by_list(wanted: np.ndarray) -> dict[int, list[int]]:
        return {int(one): np.flatnonzero(wanted[:, one]).tolist() for one in np.flatnonzero(wanted.any(axis=0))}

    first = np.zeros(bounds.shape, bool)
    np.put_along_axis(first, order[:, :FIRST], True, axis=1)
    first &= np.isfinite(bounds)
    none = np.full(len(q), -np.inf)
    start = write_table(_scan(index, by_list(first), q, ids, kind, none, k), scratch_path(spark, "first-lists"))
    at = {query: i for i, query in enumerate(ids)}
    floor = none.copy()
    for row in best(start, k).filter(F.col("rank") == k).select("query_id", "score").collect():    # one a query
        floor[at[row["query_id"]]] = row["score"]
    rest = ~first & np.isfinite(bounds) & (bounds >= floor[:, None] - SLACK)
    found = start.unionByName(write_table(_scan(index, by_list(rest), q, ids, kind, floor, k), scratch_path(spark, "other-lists")))
    return (best(found, k).select("query_id", "rank", "vec_id", "score"),
            found.groupBy("query_id").agg(F.sum("seen").alias("candidates")))
