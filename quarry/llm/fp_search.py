"""Ranked lexical search over document FP-trees (operator 12).

Terms are the maximal runs of letters, digits and non-ASCII characters, only A-Z
lower-cased. A document is restricted to the terms that some item asks for: its
vector of (term, tf), terms by descending document frequency, is a path. Documents
of a block share the paths of a trie, so the documents below a node are those
that begin with its path. Every node holds, for its subtree, the largest tf of
each term, the least m and the least doc_id. As a score grows with tf and
falls with m, the score of (largest tf, least m) bounds all documents below.

An item goes through the trie depth first, children by descending bound; a child
is left out when its bound is below the k-th best score so far (or equals it, and
no document below has a smaller id). A leaf's bound is the score of its document,
so nothing is scored twice. The best k carry over from block to block
of a task, and the best k of all tasks are merged by rank.

Corpus figures (N, L, df) come from all documents. A term is known by a 64-bit
hash of its bytes (two terms share one with a chance of about 2^-60). Blocks are
bounded by ``BLOCK_TERMS`` entries; a document's vector is one row. What is sent to
tasks is the items' terms: at most ``MAX_TERMS`` (item, term) rows at a time,
more run in portions of items.

Scores are integers (m, w and the sum as in ``item_scores``). Defined cases: null
and empty texts have no term, are no document to N and are never found; an item
without terms has no rows; rows of one item_id are one item with all
their terms; every repeated document row is a document of its own; equal scores go by
ascending doc_id, null first; empty tables give no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import Words, chunks, prepare, separators, stash, text_buffers

TOP = 20
MAX_TERMS = 1_000_000          # (item, term) rows sent to tasks at a time
BLOCK_TERMS = 1 << 20          # vector entries of one tree
SMALL = 8                      # a subtree of fewer documents lists them directly

# The ranking's integer constants.
WEIGHT_SCALE, PART_SCALE, TF_SCALE, M_SCALE, M_BASE, M_SLOPE = 1000, 1_000_000_000, 1000, 12, 100, 25

NO_ID = np.iinfo(np.int64).min


def counted_terms(batch: pa.RecordBatch, vocabulary: np.ndarray | None = None):
    """(row, term hash or place in ``vocabulary``, tf) of the texts in column 1, and all terms per row."""
    raw, offsets = text_buffers(batch.column(1))
    table = separators(white_only=False)
    rows, terms, tfs, lengths = [], [], [], []
    for lo, hi in chunks(offsets):
        words = Words(raw, offsets[lo:hi + 1], table)
        lengths.append(np.diff(words.first))
        row = np.repeat(np.arange(lo, hi), lengths[-1])
        term = words.hash
        if vocabulary is not None:
            place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            known = vocabulary[place] == term
            row, term = row[known], place[known]
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(new)
        rows.append(row[first])
        terms.append(term[first])
        tfs.append(np.diff(np.append(first, len(row))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(tfs), np.concatenate(lengths)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, repeats): the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, tf, _ = counted_terms(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(tf)],
                names=["item_id", "term", "repeats"])

    kind = items.schema[id_col].dataType.simpleString()
    return (items.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"item_id {kind}, term bigint, repeats bigint")
            .groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")))


def vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document, terms as places in ``vocabulary`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, tf, n = counted_terms(batch, vocabulary.value)
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(at, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(tf))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    return M_BASE - M_SLOPE + (M_SLOPE * n * documents) // total


def item_scores(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((PART_SCALE * tf) // (TF_SCALE * tf + M_SCALE * m))


class Tree:
    """FP-tree of a block. Nodes are numbered so that siblings follow one another; the
    entries (term, tf maximum) of node i are ``entry[i]:entry[i + 1]``."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """Documents with their m and, from ``ptr[i]`` on, terms by ascending rank of frequency."""
        paths = term.astype(">u4")
        keys = [paths[a:b].tobytes() for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        shared = [0] * len(order)
        for i in range(1, len(order)):
            a, b = order[i - 1], order[i]
            some = min(ptr[a + 1] - ptr[a], ptr[b + 1] - ptr[b])
            differ = term[ptr[a]:ptr[a] + some] != term[ptr[b]:ptr[b] + some]
            shared[i] = int(differ.argmax()) if differ.any() else int(some)
        self._number(self._grow(shared), order)

        # Entries and bounds of a subtree, from the documents up.
        n = len(self.document)
        terms, tfs = [None] * n, [None] * n
        self.m, self.least = np.empty(n, np.int64), np.empty(n, np.int64)
        for node in range(n - 1, -1, -1):
            doc = self.document[node]
            if doc >= 0:
                terms[node], tfs[node] = term[ptr[doc]:ptr[doc + 1]], tf[ptr[doc]:ptr[doc + 1]]
                self.m[node], self.least[node] = m[doc], ids[doc]
                continue
            below = slice(self.first[node], self.last[node])
            self.m[node], self.least[node] = self.m[below].min(), self.least[below].min()
            t, f = np.concatenate(terms[below]), np.concatenate(tfs[below])
            by = np.argsort(t, kind="stable")
            t, f = t[by], f[by]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            terms[node], tfs[node] = t[head], np.maximum.reduceat(f, head)
        size = np.array([len(t) for t in terms])
        self.entry = np.concatenate([[0], np.cumsum(size)])
        self.term, self.tf = np.concatenate(terms), np.concatenate(tfs)
        self.node = np.repeat(np.arange(n), size)
        self.document, self.first, self.last = np.array(self.document), np.array(self.first), np.array(self.last)

    @staticmethod
    def _grow(shared: list[int]) -> list:
        """Nested lists of a path-compressed trie over sorted paths (leaves are their places),
        from the lengths that neighbours share."""
        open_: list[tuple[int, list]] = [(0, [])]
        for i in range(1, len(shared) + 1):
            depth = shared[i] if i < len(shared) else 0
            below: int | list = i - 1
            while open_[-1][0] > depth:
                node = open_.pop()[1]
                node.append(below)
                below = node
            if open_[-1][0] < depth:
                open_.append((depth, [below]))
            else:
                open_[-1][1].append(below)
        return open_[0][1]

    def _number(self, root: list, order: list[int]) -> None:
        self.document, self.first, self.last = [-1], [0], [0]
        queue = [root]                              # contents of the nodes, by number
        at = 0
        while at < len(queue):
            children = queue[at]
            if isinstance(children, list):
                if at and (few := leaves(children, SMALL)) is not None:
                    children = few
                self.first[at] = len(queue)
                for child in children:
                    queue.append(child)
                    self.document.append(-1 if isinstance(child, list) else order[child])
                    self.first.append(0)
                    self.last.append(0)
                self.last[at] = len(queue)
            at += 1

    def search(self, slot: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Merge the block's documents into ``best``, a heap of (score, -doc_id) of at most ``k``.
        ``slot`` has the place of each term in the item, or -1. Returns the documents scored."""
        stack = [(1 << 62, NO_ID, 0)]
        scored = 0
        while stack:
            bound, least, node = stack.pop()
            if len(best) == k and (bound, -least) <= best[0]:
                continue
            lo, hi = int(self.first[node]), int(self.last[node])
            a, b = int(self.entry[lo]), int(self.entry[hi])
            place = slot[self.term[a:b]]
            hit = np.flatnonzero(place >= 0)
            if not hit.size:
                continue
            child = self.node[a:b][hit]
            bounds = np.zeros(hi - lo, np.int64)
            np.add.at(bounds, child - lo, item_scores(weight[place[hit]], self.tf[a:b][hit], self.m[child]))
            floor = best[0][0] if len(best) == k else 1
            open_ = np.flatnonzero(bounds >= floor)
            open_ = open_[np.argsort(bounds[open_], kind="stable")]
            leaf = self.document[lo + open_] >= 0
            for c in open_[leaf][::-1].tolist():
                found = (int(bounds[c]), -int(self.least[lo + c]))
                scored += 1
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            stack += [(int(bounds[c]), int(self.least[lo + c]), lo + c) for c in open_[~leaf].tolist()]
        return scored


def leaves(node: list, limit: int) -> list[int] | None:
    """Leaves below ``node`` if they are fewer than ``limit``."""
    found, stack = [], [node]
    while stack:
        some = stack.pop()
        if isinstance(some, list):
            stack += some
        else:
            found.append(some)
        if len(found) + len(stack) >= limit:
            return None
    return found


def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, documents: int, total: int,
          block_terms: int = BLOCK_TERMS) -> Iterator[Tree]:
    """Trees of a task's rows (doc_id, n, terms, tfs), each of about ``block_terms`` entries."""
    held: list[tuple] = []
    size = 0

    def tree() -> Tree:
        ids, n, lengths, term, tf = (np.concatenate(c) for c in zip(*held))
        term = rank[term]
        doc = np.repeat(np.arange(len(ids)), lengths)
        by = np.lexsort((term, doc))
        return Tree(ids, length_norm(n, documents, total), np.concatenate([[0], np.cumsum(lengths)]), term[by], tf[by])

    for whole in batches:
        ends = np.cumsum(whole.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + block_terms - size, side="right")))
            batch = whole.slice(at, to - at)
            terms = batch.column("terms")
            ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            held.append((ids, batch.column("n").to_numpy(zero_copy_only=False),
                         terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                         terms.flatten().to_numpy(zero_copy_only=False),
                         batch.column("tfs").flatten().to_numpy(zero_copy_only=False)))
            size += int(ends[to - 1]) - before
            at = to
            if size >= block_terms:
                yield tree()
                held, size = [], 0
    if held:
        yield tree()


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", max_terms: int = MAX_TERMS,
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The best ``k`` documents of every item: item_id, rank, doc_id, score."""
    prepare(docs.sparkSession)
    asked = stash(item_terms(items, item_id_col, item_text_col), "fp-items")
    portions = max(1, -(-asked.count() // max_terms))
    out = None
    for i in range(portions):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == i)
        part = _portion(docs, some, k, id_col, text_col, block_terms)
        out = part if out is None else out.unionByName(part)
    return out


def _portion(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, block_terms: int) -> DataFrame:
    spark = docs.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()
    out = f"item_id {kind}, doc_id bigint, score bigint"
    wanted = asked.orderBy("item_id", "term").toArrow()
    hashes = wanted["term"].to_numpy().view(np.uint64)
    if not len(hashes):
        return spark.createDataFrame([], out).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    vocabulary = np.unique(hashes)
    known = spark.sparkContext.broadcast(vocabulary)
    table = stash(vectors(docs, known, id_col, text_col), "fp-vectors")
    known.destroy()
    documents, total = table.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df), dtype=np.int32)

    place = np.searchsorted(vocabulary, hashes)
    item_ids = wanted["item_id"].to_pylist()
    starts = [i for i, item in enumerate(item_ids) if i == 0 or item != item_ids[i - 1]]
    shared = spark.sparkContext.broadcast((
        [item_ids[i] for i in starts], np.append(starts, len(item_ids)), rank[place],
        weights[place] * wanted["repeats"].to_numpy(), rank))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, term, weight, rank = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        slot = np.full(len(rank), -1, np.int64)
        for tree in trees(batches, rank, documents, total, block_terms):
            for i, heap in enumerate(best):
                mine = term[at[i]:at[i + 1]]
                slot[mine] = np.arange(len(mine))
                tree.search(slot, weight[at[i]:at[i + 1]], heap, k)
                slot[mine] = -1
        rows = [(item, None if -doc == NO_ID else -doc, score) for item, heap in zip(ids, best) for score, doc in heap]
        yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "doc_id", "score"), r)) for r in rows],
                                         schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(spark.createDataFrame([], out).schema)
    found = table.filter(F.size("terms") > 0).mapInArrow(search, out)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
