"""Near-duplicate groups by a MinHash LSH forest (operator 2).

A text's set holds its distinct word shingles as 64-bit hashes. Equal sets form
classes first; one representative of each goes on. The forest has ``TREES``
sorted orders of the representatives, each by another sequence of ``DEEPEST``
MinHash values (a tree's signature). Spark sorts all orders by ranges of (tree, signature, id),
which a frequent signature cannot keep from being split. One walk over the sorted
rows then reads, for every row, how many rows share its first values.

The depth adapts to the region: a row's region are the rows that share its first
SHALLOWEST values if these are at most ``REGION``, else those that share one more, up
to ``BASE``. Where even that is crowded, the walk goes on to ``DEEPEST`` values for the nearest
copies only, and the crowded region is left to an exact join (below). The walk knows
``REGION`` rows on either side of a row; rows near the edge of a range are
decided by a second walk over the edges of all ranges (4 * REGION rows of each).

Round one compares a row with its longest-common-prefix neighbour in every order and
with the leader (smallest id) of its region, which joins most copies to their
group. Round two looks only at regions that still hold several groups. In those of
at most ``REGION`` rows every pair of different groups is a candidate. The members
of crowded ones go through an exact set-similarity join: shingles are ordered from
rare to frequent, and two sets at the threshold share one among the first ones of
both (prefix filter), at positions that leave room for the overlap that their sizes
ask for. Shingles that one set holds alone make no row. The frequencies that order the
shingles may be off (they share ``MAX_SLOTS`` counters at most): any order is exact, a
better one makes fewer candidates. No member or pair is dropped.

All candidates pass a 128-bit one-bit MinHash sketch (its bound lies six standard
deviations below the threshold, a chance of 1e-9 for a link) and are then confirmed on full
sets. A pair at the threshold of 0.8 shares ``BASE`` values in no order with a chance of 9e-5
(the trees share ``PERMUTATIONS`` values); it is then missed unless it meets in a shallower
region, both are members of crowded ones, or others link them.

Defined cases: null and empty texts, and texts without words, have empty sets
and are linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are equal texts; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bloom import filter_bits, in_plane, member_plane
from quarry.llm.common import Words, chunks, give_back, mix64, prepare, separators, shingle_hashes, stash, stash_narrow, text_buffers
from quarry.llm.links import components, with_minimum

PERMUTATIONS = 128
TREES = 48
SHALLOWEST, BASE, DEEPEST = 5, 6, 8    # common MinHash values of a region: least, most, and of nearest copies
REGION = 32                    # members of a region whose pairs are all candidates at once
MAX_SLOTS = 1 << 22            # counters that order the shingles of crowded members
SLOTS_PER_SHINGLE = 4
SKETCH_MARGIN = 20             # bits below the expected agreement of a pair at the threshold (6 sigma)
MAX_FILTER_BYTES = 64 << 20
EMIT_ROWS = 4096

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ORDER = np.stack([_rng.permutation(PERMUTATIONS)[:DEEPEST] for _ in range(TREES)])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int, sep: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a chunk."""
    words = Words(raw, offsets, sep)
    return [np.unique(shingle_hashes(words.hash[a:b], k)) for a, b in zip(words.first[:-1], words.first[1:])]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values (sets x PERMUTATIONS) of non-empty sets."""
    all_ = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), PERMUTATIONS), np.uint16)
    for i in range(PERMUTATIONS):
        low = np.minimum.reduceat((all_ ^ _XOR[i]) * _ODD[i], starts)
        out[:, i] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


SIGNATURE = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, s1 bigint, s2 bigint, signature binary"


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Set size, set hash (h1, h2), sketch (s1, s2) and MinHash values of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("near")
        sep = separators()
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(raw, offsets[lo:hi + 1], k, sep)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                h = np.zeros((hi - lo, 4), np.uint64)
                sig: list = [None] * (hi - lo)
                if len(some):
                    full = [sets[i] for i in some]
                    values = minhashes(full)
                    bits = np.packbits((values & 1).astype(np.uint8), axis=1).view(np.uint64)
                    h[some, 0] = [s.sum(dtype=np.uint64) for s in full]
                    h[some, 1] = [mix64(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for s in full]
                    h[some, 2:] = bits
                    for i, row in zip(some, values):
                        sig[i] = row.tobytes()
                h = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), *(pa.array(np.ascontiguousarray(c)) for c in h.T),
                     pa.array(sig, pa.binary())], names=[c.split()[0] for c in SIGNATURE.split(", ")])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SIGNATURE)


SORTED = "tree int, k1 bigint, k2 bigint, doc_id bigint"
FOUND = f"{SORTED}, due boolean, region bigint, n int, leader bigint, neighbour bigint"


def tree_keys(reps: DataFrame) -> DataFrame:
    """(tree, k1, k2, doc_id) per representative and tree: DEEPEST values of 16 bits in the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.array([48, 32, 16, 0], np.uint64)
        trees = np.arange(TREES, dtype=np.int32)
        for big in batches:
            for lo in range(0, big.num_rows, EMIT_ROWS):
                batch = big.slice(lo, EMIT_ROWS)
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
                own = values[:, _ORDER].astype(np.uint64)                    # rows x trees x DEEPEST
                keys = [np.bitwise_or.reduce(own[:, :, part] << places, axis=2).view(np.int64).ravel()
                        for part in (slice(0, 4), slice(4, 8))]
                ids = np.repeat(batch.column(0).to_numpy(), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(trees, len(values))), *map(pa.array, keys), pa.array(ids)],
                                                 names=["tree", "k1", "k2", "doc_id"])

    return reps.select("doc_id", "signature").mapInArrow(run, SORTED)


class Stretch:
    """Rows of the sorted orders that follow one another, and how they share first values."""

    def __init__(self, tree: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        self.key = {d: k2 >> (128 - 16 * d) for d in range(SHALLOWEST, DEEPEST + 1)}     # the first four values are k1
        same, shared = np.zeros(n, bool), np.zeros(n + 1, np.int8)
        same[1:] = (tree[1:] == tree[:-1]) & (k1[1:] == k1[:-1])
        self.start, self.run, self.length = {}, {}, {}
        for d in range(SHALLOWEST, DEEPEST + 1):
            with_last = same.copy()
            with_last[1:] &= self.key[d][1:] == self.key[d][:-1]
            shared[:-1] += with_last
            self.start[d] = np.flatnonzero(~with_last)
            self.run[d] = np.cumsum(~with_last) - 1
            self.length[d] = np.diff(np.append(self.start[d], n))[self.run[d]]
        self.shared = shared                                    # depth steps in common with the row before (and 0 at the end)
        self.seed = mix64(mix64(tree.astype(np.uint64) + np.uint64(1)) ^ k1.view(np.uint64))

    def regions(self) -> tuple[np.ndarray, ...]:
        """(region, n, leader, neighbour) of every row; n is over REGION for a crowded one, 1 for none."""
        n = len(self.ids)
        depth = np.full(n, BASE)
        for d in range(BASE - 1, SHALLOWEST - 1, -1):
            depth[self.length[d] <= REGION] = d
        region, size, leader = np.zeros(n, np.uint64), np.ones(n, np.int64), self.ids.copy()
        for d in range(SHALLOWEST, DEEPEST + 1):
            low = np.minimum.reduceat(self.ids, self.start[d])[self.run[d]]
            if d <= BASE:
                own = depth == d
                region[own] = mix64(self.seed[own] + mix64(self.key[d][own].view(np.uint64) * np.uint64(16) + np.uint64(d)))
                size[own] = np.minimum(self.length[d][own], REGION + 1)
                leader[own] = low[own]
            else:
                closer = (size > REGION) & (self.length[d] > 1)
                leader[closer] = low[closer]
        back = self.shared[:-1] >= self.shared[1:]
        near = np.where(back, np.roll(self.ids, 1), np.roll(self.ids, -1))
        neighbour = np.where(np.maximum(self.shared[:-1], self.shared[1:]) > 0, near, self.ids)
        return region.view(np.int64), size, leader, neighbour


def walk(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """Regions of the rows of one sorted range, and the rows at its edges as they are (due: not
    decided here). With ``edges`` the batches hold the edges of all ranges, whose due rows are decided."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    rows = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, bool)]
    done = 0                                                    # rows decided or given on, of those still held
    ahead = 0 if edges else 2 * REGION                          # rows seen before the ones held, up to the edge's length

    def edge(lo: int, hi: int, due: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(hi - lo, pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c[lo:hi]) for c in rows[:4]), pa.array(due), none,
                                           pa.nulls(hi - lo, pa.int32()), none, none], names=names)

    def decided(lo: int, hi: int) -> pa.RecordBatch:
        region, n, leader, neighbour = (c[lo:hi] for c in Stretch(*rows[:4]).regions())
        own = n > 1
        if edges:
            own &= rows[4][lo:hi]
        return pa.RecordBatch.from_arrays([*(pa.array(c[lo:hi][own]) for c in rows[:4]), pa.array(np.zeros(own.sum(), bool)),
                                           pa.array(region[own]), pa.array(n[own].astype(np.int32)), pa.array(leader[own]),
                                           pa.array(neighbour[own])], names=names)

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        due = batch.column(4).to_numpy(zero_copy_only=False) if edges else np.zeros(batch.num_rows, bool)
        rows = [np.concatenate(c) for c in zip(rows, [*new, due])]
        if ahead and len(rows[0]) >= 4 * REGION:                # the range's beginning
            yield edge(0, 2 * REGION, np.arange(2 * REGION) < REGION)
            done, ahead = REGION, 0
        if not ahead and len(rows[0]) - REGION - done >= EMIT_ROWS:
            yield decided(done, len(rows[0]) - REGION)
            drop = max(0, len(rows[0]) - 2 * REGION - (0 if edges else REGION))
            done = len(rows[0]) - REGION - drop
            rows = [c[drop:] for c in rows]
    n = len(rows[0])
    if edges:
        if n > done:
            yield decided(done, n)
    elif ahead:                                                 # a short range is all edge
        if n:
            yield edge(0, n, np.ones(n, bool))
    else:
        if n - REGION > done:
            yield decided(done, n - REGION)
        yield edge(n - 2 * REGION, n, np.arange(2 * REGION) >= REGION)


def forest_regions(reps: DataFrame) -> DataFrame:
    """(region, n, leader, neighbour, doc_id) of every row and tree that shares a region with another."""
    order = ["tree", "k1", "k2", "doc_id"]
    keys = stash(tree_keys(reps), "near-keys")
    ranges = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    first = stash(ranges.mapInArrow(lambda batches: walk(batches, False), FOUND), "near-ranges")
    # 4 * REGION rows of every range: of a size that follows the number of partitions, not the rows.
    rest = first.filter("region is null").select(*order, "due").coalesce(1).sortWithinPartitions(*order)
    rest = rest.mapInArrow(lambda batches: walk(batches, True), FOUND)
    cols = ["region", "n", "leader", "neighbour", "doc_id"]
    return first.filter("region is not null").select(*cols).unionAll(rest.select(*cols))


def sketch_passes(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow a link."""
    least = PERMUTATIONS * (100 + percent) // 200 - SKETCH_MARGIN
    cols = ("doc_id", "n_shingles", "s1", "s2")
    for side in ("a", "b"):
        own = sketches.select(*[F.col(c).alias(side if c == "doc_id" else f"{c}_{side}") for c in cols])
        pairs = pairs.join(own, side)
    agree = PERMUTATIONS - F.bit_count(F.expr("s1_a ^ s1_b")) - F.bit_count(F.expr("s2_a ^ s2_b"))
    sizes = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent
    return pairs.filter(sizes & (agree >= least)).select("a", "b")


def picked_sets(ids: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str):
    """An iterator function from Arrow batches to (ids, sets) of the texts that a Bloom filter
    of ``ids`` (column id) picks, and the (id, text) table to map it over."""
    bits = filter_bits(ids.count(), MAX_FILTER_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(member_plane(ids, "id", bits))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        sep = separators()
        for batch in batches:
            batch = batch.filter(pa.array(in_plane(batch.column(0).to_numpy(zero_copy_only=False), shared.value, bits)))
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets):
                yield batch.column(0).slice(lo, hi - lo), shingle_sets(raw, offsets[lo:hi + 1], k, sep)

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return picked, own


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) with 100 * |a & b| >= percent * |a | b| on full sets; only texts
    of the pairs (picked by a Bloom filter of their ids) have their sets made and moved."""
    pairs = stash_narrow(pairs, "near-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    if ids.isEmpty():
        return pairs
    picked, own = picked_sets(ids, docs, k, id_col, text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, sets in picked(batches):
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([id_, pa.ListArray.from_arrays(ends, values)], names=["id", "set"])

    sets = stash(own.mapInArrow(make, "id bigint, set array<bigint>"), "near-sets")
    wide = (pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "set_a"), "a")
            .join(sets.withColumnRenamed("id", "b").withColumnRenamed("set", "set_b"), "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    linked = 100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)
    return stash_narrow(wide.filter(linked).select("a", "b"), "near-links")


def prefixes(members: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(shingle, doc_id, size, position): the rare end of every member's set, as long as a partner at
    the threshold must meet it there; without shingles that no other member has."""
    total = members.agg(F.sum("n_shingles")).first()[0]
    slots = min(MAX_SLOTS, 1 << (total * SLOTS_PER_SHINGLE - 1).bit_length())
    picked, own = picked_sets(members.select(F.col("doc_id").alias("id")), docs, k, id_col, text_col)

    def slot(s: np.ndarray) -> np.ndarray:
        return (mix64(s) & np.uint64(slots - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.int32)
        for _, sets in picked(batches):
            np.add.at(held, slot(np.concatenate(sets)), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at].astype(np.int64))], names=["slot", "n"])

    # At most MAX_SLOTS rows reach the driver.
    sums = own.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    counts = np.ones(slots, np.int32)
    counts[sums.column(0).to_numpy()] = np.minimum(sums.column(1).to_numpy(), 2**31 - 1)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in picked(batches):
            parts = []
            for i, s in enumerate(sets):
                n = shared.value[slot(s)]
                by = np.lexsort((s, n))[:len(s) - -(-percent * len(s) // 100) + 1]
                at = np.flatnonzero(n[by] > 1)
                parts.append((s[by[at]].view(np.int64), np.full(len(at), i), np.full(len(at), len(s)), at))
            shingle, row, size, at = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(shingle), ids.take(pa.array(row)), pa.array(size), pa.array(at)],
                                             names=["shingle", "doc_id", "size", "position"])

    return own.mapInArrow(emit, "shingle bigint, doc_id bigint, size bigint, position bigint")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components that share a shingle of ``rows`` (``prefixes`` with component)
    where both sets still have room for the overlap of a link."""
    # Of the components that meet at a shingle, the largest is not paired with itself.
    major = (rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("shingle").agg(F.max_by("component", "n").alias("major"), F.count(F.lit(1)).alias("k"))
             .filter("k > 1").select("shingle", "major"))
    rows = stash_narrow(rows.join(major, "shingle"), "near-prefixes")
    cols = ("doc_id", "size", "position", "component")
    left = rows.filter("component <> major").select("shingle", *(F.col(c).alias(f"{c}_a") for c in cols))
    right = rows.select("shingle", "major", *(F.col(c).alias(f"{c}_b") for c in cols))
    room = F.least(F.expr("size_a - position_a"), F.expr("size_b - position_b"))
    fits = room * (100 + percent) >= F.expr("size_a + size_b") * percent
    once = F.expr("component_b = major or doc_id_a < doc_id_b")
    met = left.join(right, (left["shingle"] == right["shingle"]) & F.expr("component_a <> component_b") & once & fits)
    return met.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def cross_pairs(regions: DataFrame) -> DataFrame:
    """Distinct pairs of members of one region that lie in different components."""
    left = regions.select("region", F.col("doc_id").alias("a"), F.col("component").alias("ca"))
    right = regions.select("region", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    return left.join(right, "region").filter("a < b and ca <> cb").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    prepare(docs.sparkSession)
    found = stash(signatures(docs, shingle_words, id_col, text_col), "near-signatures")
    some = found.filter("n_shingles > 0").select("doc_id", "n_shingles", F.struct("h1", "h2", "n_shingles").alias("set"))
    classes = stash_narrow(with_minimum(some, "set", "doc_id", "rep").select("doc_id", "rep"), "near-classes")
    reps = stash_narrow(classes.filter("doc_id = rep").select("doc_id").distinct()
                 .join(found.filter("n_shingles > 0"), "doc_id"), "near-reps")

    members = stash_narrow(forest_regions(reps), "near-members")
    star = members.select(F.col("doc_id").alias("a"), F.explode(F.array("leader", "neighbour")).alias("b")).filter("a <> b")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = confirmed(sketch_passes(star, reps, percent), docs, shingle_words, percent, id_col, text_col)

    groups = stash_narrow(components(links), "near-groups")
    own = (members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
           .withColumn("component", F.coalesce("component", "doc_id")))
    mixed = own.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region")
    open_ = stash_narrow(own.join(mixed, "region").select("region", "n", "doc_id", "component"), "near-open")
    if not open_.isEmpty():
        tests = cross_pairs(open_.filter(F.col("n") <= REGION))
        crowded = stash_narrow(open_.filter(F.col("n") > REGION).select("doc_id", "component").distinct()
                               .join(reps.select("doc_id", "n_shingles"), "doc_id"), "near-crowded")
        if not crowded.isEmpty():
            rows = prefixes(crowded, docs, shingle_words, percent, id_col, text_col)
            tests = tests.unionAll(prefix_pairs(rows.join(crowded.select("doc_id", "component"), "doc_id"), percent)).distinct()
        links = links.unionAll(confirmed(sketch_passes(tests, reps, percent), docs, shingle_words, percent, id_col, text_col))
        groups = stash_narrow(components(links), "near-groups")

    merged = (classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
              .select("doc_id", F.coalesce("component", "rep").alias("component_id"))
              .groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    out = found.select("doc_id", "n_shingles").join(merged, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.equal_null("doc_id", "component_id").alias("kept"))
