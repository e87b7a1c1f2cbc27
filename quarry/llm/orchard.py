"""Vector codes by product quantisation with Orchard's nearest-entry search (operator 13).

A vector's components become integers floor(256 * x) and are cut into equal
consecutive parts; every part position has a codebook, begun with that part of
the vectors of the smallest ids. A round assigns every part to its nearest
entry and replaces each entry by the floor of the mean of its parts.

The nearest entry is found by Orchard's method. For every entry the others are
listed by their distance to it. A search follows the list of its current entry,
skips entries it has visited, and goes over to the list of an entry as soon as that
is nearer. It ends when the next on the list lies more than twice the current
distance from the current entry: by the triangle inequality none after it can be as
near. In squared integers that is ``list > 4 * current``; entries at just twice the
distance are still visited, so ties fall to the lower index as they would by
comparing all. A search starts at the entry whose component sum is next to the
part's. All parts of a block of vectors go one step at a time together.

Tasks add up parts per entry in integers and send one row per (position, entry,
component); codebooks (entries * dimension integers, whatever the number of
vectors) are all that the driver and the broadcasts hold.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped, and so are those of another length than the kept vector of smallest id; a
length that the number of parts does not divide is filled up with zeros, which
changes no distance. Components beyond +-2^24 after the factor count as that, and a
label's sum that leaves 64 bits is null. Fewer vectors than entries give fewer
entries; of rows with an equal id the smaller vector comes first, and every row gets
its own code. An empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import prepare, stash

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LIMIT = 1 << 24                # largest integer component
BLOCK = 4096                   # searches that go step by step together
SALTS = 32                     # parts that a label is dealt into for its sum


def sound(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def integers(column: pa.Array, dimension: int, parts: int) -> np.ndarray:
    """(rows * parts, width) integer parts of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(-1, dimension)
    width = -(-dimension // parts)
    if width * parts > dimension:
        whole = np.pad(whole, ((0, 0), (0, width * parts - dimension)))
    return whole.reshape(-1, width)


class Lists:
    """Distance-sorted neighbour lists of one codebook, and where searches start."""

    def __init__(self, book: np.ndarray):
        self.book = book
        away = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(away, -1)                          # an entry heads its own list
        order = np.argsort(away, axis=1, kind="stable")
        self.next = order[:, 1:]
        self.away = np.take_along_axis(away, self.next, axis=1)
        sums = book.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point, ties to the lower entry."""
        n, entries = len(points), len(self.book)
        at = self.by_sum[np.minimum(np.searchsorted(self.sums, points.sum(axis=1)), entries - 1)]
        best = ((points - self.book[at]) ** 2).sum(axis=1)
        visited = np.zeros((n, entries), bool)
        visited[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n if entries > 1 else 0)
        while live.size:
            here, step = at[live], place[live]
            go = self.away[here, step] <= 4 * best[live]
            if not go.all():
                live, here, step = live[go], here[go], step[go]
            other = self.next[here, step]
            place[live] = step + 1
            new = ~visited[live, other]
            rows, met = live[new], other[new]
            visited[rows, met] = True
            far = ((points[rows] - self.book[met]) ** 2).sum(axis=1)
            now = best[rows]
            nearer = (far < now) | ((far == now) & (met < at[rows]))
            rows, met = rows[nearer], met[nearer]
            at[rows], best[rows], place[rows] = met, far[nearer], 0
            live = live[place[live] < entries - 1]
        return at, best


def assign(points: np.ndarray, lists: list[Lists]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows, parts) of the parts of a batch of vectors."""
    parts, width = len(lists), points.shape[1]
    points = points.reshape(-1, parts, width)
    codes = np.empty(points.shape[:2], np.int64)
    error = np.empty(points.shape[:2], np.int64)
    for p, book in enumerate(lists):
        for lo in range(0, len(points), BLOCK):
            codes[lo:lo + BLOCK, p], error[lo:lo + BLOCK, p] = book.nearest(points[lo:lo + BLOCK, p])
    return codes, error


def totals(points: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Number (parts, entries) and component sums (parts, entries, width) of the parts of each entry."""
    parts, width = codes.shape[1], points.shape[1]
    points = points.reshape(-1, parts, width)
    number = np.stack([np.bincount(codes[:, p], minlength=entries) for p in range(parts)])
    # Floats hold these sums exactly: components are within 2^24, an Arrow batch far under 2^29 rows.
    sums = np.stack([np.stack([np.bincount(codes[:, p], points[:, p, c], entries) for c in range(width)], axis=1)
                     for p in range(parts)])
    return number, sums.astype(np.int64)


def codebooks(vectors: DataFrame, dimension: int, first: np.ndarray, rounds: int) -> np.ndarray:
    """Entries (parts, entries, width) after ``rounds`` rounds from ``first`` over ``vectors`` (vec)."""
    spark = vectors.sparkSession
    books = first
    parts, entries, width = books.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lists = [Lists(book) for book in shared.value]
            number, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                if batch.num_rows:
                    points = integers(batch.column(0), dimension, parts)
                    n, s = totals(points, assign(points, lists)[0], entries)
                    number += n
                    sums += s
            slot = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(slot, width)), pa.array(np.tile(np.arange(width), len(slot))),
                 pa.array(np.repeat(number.ravel()[slot], width)), pa.array(sums.reshape(-1, width)[slot].ravel())],
                names=["slot", "component", "n", "total"])

        added = (vectors.select("vec").mapInArrow(add_up, "slot bigint, component bigint, n bigint, total bigint")
                 .groupBy("slot", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas())
        books = books.copy()
        flat = books.reshape(-1, width)
        flat[added["slot"].to_numpy(np.int64), added["component"].to_numpy(np.int64)] = (
            added["total"].to_numpy(np.int64) // added["n"].to_numpy(np.int64))
        shared.destroy()
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    spark = vectors.sparkSession
    prepare(spark)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vec")).filter(sound(F.col("vec")))
    lead = rows.select("vec_id", "vec").orderBy("vec_id", "vec").limit(1).collect()
    out = f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint"
    if not lead:
        return spark.createDataFrame([], out).select(
            "vec_id", "code", "error", F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dimension = len(lead[0]["vec"])
    rows = rows.filter(F.size("vec") == dimension)
    heads = [r["vec"] for r in rows.select("vec_id", "vec").orderBy("vec_id", "vec").limit(entries).collect()]
    start = integers(pa.array(heads, pa.list_(pa.float64())), dimension, parts)
    start = start.reshape(len(heads), parts, -1).transpose(1, 0, 2).copy()
    books = codebooks(rows, dimension, start, rounds)
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Lists(book) for book in shared.value]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes, error = assign(integers(batch.column("vec"), dimension, parts), lists)
            digits = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                 pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    coded = stash(rows.mapInArrow(encode, out), "vector-codes")
    shared.destroy()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    # A label may hold a third of all rows: its salted parts are summed first, and the sum goes back to each part.
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    sums = salted.groupBy("label", "salt").agg(F.try_sum("error").alias("part_error"))
    label_sums = sums.groupBy(F.col("label").alias("of")).agg(F.try_sum("part_error").alias("label_error"))
    back = (sums.join(label_sums, F.equal_null("label", "of"))
            .select(F.col("of"), F.col("salt").alias("of_salt"), "label_error"))
    return (salted.join(back, F.equal_null("label", "of") & (F.col("salt") == F.col("of_salt")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
