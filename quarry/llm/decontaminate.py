"""Benchmark decontamination by SimHash windows (operator 3).

Words are runs of letters and digits, compared in lower case. Every benchmark
item is covered by windows of its size class (about two thirds of its length),
at all offsets; every document by windows of each class, a quarter window
apart, so that a copy of an item holds at least two whole document windows.
Windows have 64-bit SimHash fingerprints of their words. The multi-index splits
a fingerprint into ``BLOCKS`` blocks: two fingerprints within ``RADIUS`` bits
agree in some block up to ``RADIUS // BLOCKS`` bits, so looking every block up
among the item blocks with that many bits flipped finds all of them.

A candidate says where the whole item would start in the document. The item's
size of words from there, as far as the document has them (and a few words more
or less), is compared with the item by weighted shingles: five words each, weighted by how few items have the
shingle; a similarity (weighted Jaccard) of ``percent`` or more is a leak.

Documents never shuffle. The index of the items is broadcast; a benchmark over
``MAX_ITEM_WORDS`` words is indexed and scanned in several passes.

Defined cases: null and empty texts have no leaks; items without words match
nothing; items of fewer words than a shingle are one shingle; items shorter
than ``CLASSES[0]`` words are looked up at every word; repeated items are each
reported, repeated rows give repeated results; an empty table gives an empty
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from quarry.llm.common import Words, chunks, give_back, mix64, prepare, separators, shingle_hashes, stash, text_buffers

SHINGLE = 5
PERCENT = 80
RADIUS, BLOCKS = 7, 4
BLOCK_BITS = 64 // BLOCKS
#: Window sizes; ratios of about 5 to 4.
CLASSES = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 19, 24, 30, 37, 46, 58, 72, 90, 113, 141, 176, 220, 275, 344, 430, 537, 671, 839]
SLACK = 2                      # words that a copy may have gained or lost inside
MAX_ITEM_WORDS = 1 << 20       # words of items that one pass broadcasts (about 100 MB of index)
SEGMENT_WORDS = 1 << 17        # words whose running bit sums are held at a time


def stride(size: int) -> int:
    return max(1, size // 4)


def size_class(words: int) -> int:
    """Largest window of which a copy of ``words`` words holds two at document strides."""
    return max([c for c in CLASSES if c + 2 * stride(c) - 1 <= words], default=1)


def running_sums(hashes: np.ndarray) -> np.ndarray:
    """(words + 1) x 64: how often every bit was set so far (modulo 2^16, ample for differences)."""
    bits = np.ascontiguousarray(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).T)
    out = np.zeros((64, len(hashes) + 1), np.uint16)
    np.cumsum(bits, axis=1, dtype=np.uint16, out=out[:, 1:])
    return np.ascontiguousarray(out.T)


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (uint64) of the windows of ``size`` words at ``starts``: a bit is set
    where more than half of the words set it."""
    return np.packbits((sums[starts + size] - sums[starts]) > size // 2, axis=1).view(np.uint64).ravel()


def block(prints: np.ndarray, i: int) -> np.ndarray:
    return ((prints >> np.uint64(i * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


class Index:
    """Items, their fingerprints by class, and the block tables of the multi-index."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        sep = separators(white_only=False)
        raw, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(raw, offsets, sep, fold_latin=True)
        self.percent = percent
        self.ids = [i for i, _ in items]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        shingles = [shingle_hashes(w, SHINGLE) for w in self.words]
        each, n = np.unique(np.concatenate([np.unique(s) for s in shingles]), return_counts=True) if items else (None, None)
        total = max(1, len(items))
        self.rare = 1 + math.log(total)
        # Weight 1 + ln(items / items with the shingle); a shingle of no item weighs as one of a single item.
        self.weight = dict(zip(each.tolist(), (1 + np.log(total / n)).tolist())) if items else {}
        self.shingles = [self.bag(s) for s in shingles]
        self.classes: dict[int, tuple] = {}
        by_class: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                by_class.setdefault(size_class(len(w)), []).append(i)
        for size, members in by_class.items():
            prints, item, offset = [], [], []
            for i in members:
                starts = np.arange(len(self.words[i]) - size + 1)
                prints.append(fingerprints(running_sums(self.words[i]), starts, size))
                item.append(np.full(len(starts), i))
                offset.append(starts)
            prints = np.concatenate(prints)
            self.classes[size] = (prints, np.concatenate(item), np.concatenate(offset),
                                  [self.block_table(block(prints, b)) for b in range(BLOCKS)])

    @staticmethod
    def block_table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every block value: the fingerprints whose block is within RADIUS // BLOCKS bits (CSR)."""
        assert RADIUS // BLOCKS == 1
        flips = np.array([0] + [1 << b for b in range(BLOCK_BITS)])
        near = (values[:, None] ^ flips[None, :]).ravel()
        rows = np.repeat(np.arange(len(values)), len(flips))
        by = np.argsort(near, kind="stable")
        return np.searchsorted(near[by], np.arange((1 << BLOCK_BITS) + 1)), rows[by].astype(np.int32)

    def bag(self, shingles: np.ndarray) -> dict[int, int]:
        each, n = np.unique(shingles, return_counts=True)
        return dict(zip(each.tolist(), n.tolist()))

    def similarity(self, item: int, words: np.ndarray) -> float:
        """Weighted Jaccard of the item's shingles and those of ``words``, as bags."""
        own, other = self.shingles[item], self.bag(shingle_hashes(words, SHINGLE))
        low = high = 0.0
        for s in own.keys() | other.keys():
            w, a, b = self.weight.get(s, self.rare), own.get(s, 0), other.get(s, 0)
            low += w * min(a, b)
            high += w * max(a, b)
        return low / high if high else 0.0

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within RADIUS bits, for all windows of one class, equal prints first."""
        known, _, _, tables = self.classes[size]
        found_w, found_f = [], []
        for b, (start, rows) in enumerate(tables):
            at = block(prints, b)
            n = start[at + 1] - start[at]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            w = np.repeat(hit, n[hit])
            f = rows[np.arange(len(w)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(start[at[hit]], n[hit])]
            close = np.bitwise_count(prints[w] ^ known[f]) <= RADIUS
            found_w.append(w[close])
            found_f.append(f[close])
        if not found_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found_w).astype(np.int64) * len(known) + np.concatenate(found_f))
        w, f = pairs // len(known), pairs % len(known)
        by = np.argsort(np.bitwise_count(prints[w] ^ known[f]), kind="stable")
        return w[by], f[by]

    def leaks(self, words: Words, texts: int) -> dict[int, dict[int, tuple]]:
        """text -> item -> (similarity, first word, last word + 1), the best place of each item."""
        out: dict[int, dict[int, tuple]] = {}
        if not len(words.hash):
            return out
        lengths = np.diff(words.first)
        plans, tested = [], set()
        for size in self.classes:
            n = np.maximum(0, (lengths - size) // stride(size) + 1) * (lengths >= size)
            doc = np.repeat(np.arange(texts), n)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            plans.append((size, doc, words.first[:-1][doc] + step * stride(size)))
        reach = max(self.classes, default=0)
        for base in range(0, len(words.hash), SEGMENT_WORDS):       # bounded running sums, however long a text
            sums = running_sums(words.hash[base:base + SEGMENT_WORDS + reach])
            for size, doc, starts in plans:
                _, item, offset, _ = self.classes[size]
                lo, hi = np.searchsorted(starts, [base, base + SEGMENT_WORDS])
                w, f = self.candidates(fingerprints(sums, starts[lo:hi] - base, size), size)
                at = starts[lo:hi][w]
                for d, first, i in zip(doc[lo:hi][w].tolist(), (at - offset[f]).tolist(), item[f].tolist()):
                    if (d, first, i) not in tested:
                        tested.add((d, first, i))
                        self.place(words, d, first, i, out)
        return out

    def place(self, words: Words, d: int, first: int, i: int, out: dict) -> None:
        """Compare item ``i`` with the words from ``first`` on, SLACK words more or less at either end."""
        if out.get(d, {}).get(i, (0.0,))[0] == 1.0:
            return                                                  # the item was found whole; no place is better
        floor, ceiling, size = int(words.first[d]), int(words.first[d + 1]), len(self.words[i])
        best = (0.0, 0, 0)
        if np.array_equal(words.hash[max(first, floor):first + size], self.words[i]) and first + size <= ceiling:
            best = (1.0, -first, first + size)
        else:
            low, high = max(first, floor), min(first + size, ceiling)   # a copy may be cut off by the text's ends
            around = shingle_hashes(words.hash[max(floor, low - SLACK):min(ceiling, high + SLACK)], SHINGLE)
            if not any(s in self.shingles[i] for s in around.tolist()):
                return                                              # no shingle in common, whatever the place
            if self.similarity(i, words.hash[low:high]) * 100 < self.percent / 2:
                return                                              # too far for a few words more or less
            for a in range(max(floor, low - SLACK), min(ceiling, low + SLACK) + 1):
                for b in range(max(a, high - SLACK), min(ceiling, high + SLACK) + 1):
                    best = max(best, (self.similarity(i, words.hash[a:b]), -a, b))
        if round(best[0] * 100, 9) >= self.percent:
            old = out.setdefault(d, {}).get(i)
            new = (best[0], -best[1], best[2])
            if old is None or (new[0], -new[1]) > (old[0], -old[1]):
                out[d][i] = new


SPAN = "array<struct<item_id:bigint,similarity:double,start:bigint,end:bigint>>"


def passes(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in portions of at most about ``limit`` words, by their id's hash."""
    own = items.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-size // limit))
    for part in range(parts):
        yield sorted((r["id"], r["text"]) for r in own.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect())


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", limit: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with ``leaks``: per leaked item its similarity and the place of its copy
    (byte offsets of the UTF-8 text), sorted by item."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for portion in passes(items, item_id, item_text, limit):
        shared = spark.sparkContext.broadcast((portion, percent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, sep = Index(*shared.value), separators(white_only=False)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()),
                                       ("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                raw, offsets = text_buffers(batch.column(1))
                for lo, hi in chunks(offsets):
                    words = Words(raw, offsets[lo:hi + 1], sep, fold_latin=True)
                    hits = index.leaks(words, hi - lo)
                    begin = offsets[lo:hi + 1] - offsets[lo]
                    rows = [[{"item_id": index.ids[i], "similarity": s, "start": int(words.start[a] - begin[d]),
                              "end": int(words.end[b - 1] - begin[d])} for i, (s, a, b) in sorted(hits.get(d, {}).items())]
                            for d in range(hi - lo)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, kind)],
                                                     names=["doc_id", "leaks"])

        parts.append(base.mapInArrow(run, f"doc_id bigint, leaks {SPAN}"))
    if len(parts) == 1:
        return parts[0]
    some = None
    for part in parts:                                              # few rows: documents with a leak
        hit = stash(part.filter(F.size("leaks") > 0), "leaks")
        some = hit if some is None else some.unionAll(hit)
    merged = some.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaks")))).alias("leaks"))
    return base.select("doc_id").join(merged, "doc_id", "left").withColumn(
        "leaks", F.coalesce("leaks", F.expr(f"cast(array() as {SPAN})")))


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_similarity, spans) of every row."""
    found = leaks(docs, items, **options)
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("bigint").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["similarity"])), F.lit(0.0)).alias("best_similarity"),
        F.array_join(F.transform("leaks", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("item_id", "start", "end")))),
                     ",").alias("spans"))


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT, text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", limit: int = MAX_ITEM_WORDS) -> DataFrame:
    """Rows of ``docs`` without a leak, all columns as they were."""
    prepare(docs.sparkSession)
    for i, portion in enumerate(passes(items, item_id, item_text, limit)):
        shared = docs.sparkSession.sparkContext.broadcast((portion, percent))
        docs = (docs if i == 0 else stash(docs, "clean")).filter(leaks_nothing(shared)(F.col(text_col)))
    return docs


def leaks_nothing(shared):
    """Pandas UDF: the text holds none of the items of the broadcast."""

    @pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back("decontaminate")
        index, sep = Index(*shared.value), separators(white_only=False)
        for texts in batches:
            raw, offsets = text_buffers(pa.array(texts, pa.string(), from_pandas=True))
            ok = np.ones(len(texts), bool)
            for lo, hi in chunks(offsets):
                for d in index.leaks(Words(raw, offsets[lo:hi + 1], sep, fold_latin=True), hi - lo):
                    ok[lo + d] = False
            yield pd.Series(ok)

    return test
