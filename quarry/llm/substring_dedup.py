"""Repeated passages by line and paragraph hashing (operator 7).

Units are the lines of a text and its paragraphs (lines between lines without
words), normalised to their words: runs of letters and digits in lower case.
Digests of units are grouped over all documents; the earliest occurrence (least
doc_id, its first there) stays and all later ones are removed, with the offsets
of the original text (code points, end exclusive). Units and removed stretches have
``min_words`` words or more; with ``min_words=1`` every repeated line goes.

A passage may also stand inside a line, or be broken into lines otherwise than its
first occurrence. With ``windows`` word windows are units too, chosen by winnowing:
of every ``span`` neighbouring windows of ``size`` words the one of least digest, where
size + span - 1 = min_words. So two places that share ``min_words`` words share a
chosen window, without exception. A repeated window grows while the words beside it
equal those beside the occurrence that stays; ``span - 1`` words on either side
reach both ends of the passage. Where the earliest occurrence of a window is of a
smaller part of the passage (``size`` words at least), the window grows to that part. Overlapping
and touching stretches of a document are merged.

Only (digest, id) pairs are grouped; units that occur once are dropped map-side
by a Bloom filter before rows with context move. A very frequent unit collapses
in the partial aggregate, and is joined in SALTS parts.

Defined cases: null and empty texts have no units; a passage repeated inside
one document keeps its first place; of a window said over and over without a break
(one word many times) every ``size``-th is a unit, and the ends of such a stretch may
be missed by fewer than ``span`` words; rows that repeat one id and text are one document, rows
of one id and other texts are documents of their own, ranked by id and then a hash of the text;
rows without id are left as they are; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bloom import filter_bits, in_plane, member_plane
from quarry.llm.common import Words, chunks, fresh_name, mix64, prepare, separators, stash, stash_narrow, text_buffers
from quarry.llm.links import SALTS

MIN_WORDS = 50                 # least words of a unit and of a removed stretch
SPAN_SHARE = 4                 # one window is chosen of min_words / SPAN_SHARE neighbouring ones
MAX_FILTER_BYTES = 64 << 20

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def window_sizes(min_words: int) -> tuple[int, int]:
    """(size, span) of the word windows: size + span - 1 = min_words."""
    span = max(1, min_words // SPAN_SHARE)
    return min_words - span + 1, span


class Units:
    """Units of a chunk of texts: first and last+1 word, digest, document, and whether a window."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, windows: bool = True):
        self.words = words = Words(raw, offsets, separators(white_only=False), fold_latin=True)
        n = len(words.hash)
        base = int(offsets[0])
        data = raw[base:int(offsets[-1])]
        self.chars = np.zeros(len(data) + 1, np.int64)         # code points before every byte
        np.cumsum((data & 0xC0) != 0x80, out=self.chars[1:])
        self.begin = offsets - base
        if not n:
            self.first = self.last = self.doc = self.digest = np.zeros(0, np.int64)
            self.window = np.zeros(0, bool)
            return
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        power, back = np.full(n, _STEP), np.full(n, _BACK)
        power[0] = back[0] = 1
        back = np.cumprod(back)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * np.cumprod(power), out=run[1:])

        def digests(first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
            size = (last - first).astype(np.uint64) * np.uint64(2) + np.uint64(kind)
            return mix64((run[last] - run[first]) * back[first] + size)

        breaks = np.full(n, 2)                                  # line feeds before every word; a text's first has enough
        breaks[1:] = np.diff(np.cumsum(data == 10)[words.start])
        breaks[words.first[:-1][words.first[:-1] < n]] = 2
        pieces = []
        for least in (1, 2):                                    # lines, paragraphs
            starts = np.flatnonzero(breaks >= least)
            pieces.append(np.stack([starts, np.append(starts[1:], n)[:len(starts)]], axis=1))
        whole = np.unique(np.concatenate(pieces), axis=0)
        whole = whole[whole[:, 1] - whole[:, 0] >= min_words]
        digest = digests(whole[:, 0], whole[:, 1], 0)
        self.window = np.zeros(len(whole), bool)
        size, span = window_sizes(min_words)
        if windows and n >= min_words:
            at = np.arange(n - size + 1)
            every = digests(at, at + size, 1)
            starts = np.flatnonzero(at[:n - min_words + 1] + min_words <= words.first[1:][doc[:n - min_words + 1]])
            views = np.lib.stride_tricks.sliding_window_view(every, span)
            chosen = np.unique(starts + views[starts].argmin(axis=1))
            same = np.zeros(len(chosen) + 1, bool)              # the next one of the same digest, one word further
            same[1:-1] = (np.diff(chosen) == 1) & (every[chosen[1:]] == every[chosen[:-1]])
            count = np.arange(len(chosen))
            since = count - np.maximum.accumulate(np.where(same[:-1], 0, count))
            chosen = chosen[(since % size == 0) | ~same[1:]]
            whole = np.concatenate([whole, np.stack([chosen, chosen + size], axis=1)])
            digest = np.concatenate([digest, every[chosen]])
            self.window = np.concatenate([self.window, np.ones(len(chosen), bool)])
        self.first, self.last = whole[:, 0], whole[:, 1]
        self.doc = doc[self.first]
        self.digest = digest.view(np.int64)

    def occurrence(self) -> np.ndarray:
        """How many units of the same digest lie before a unit in its document."""
        by = np.lexsort((self.first, self.digest, self.doc))
        d, g, count = self.doc[by], self.digest[by], np.arange(len(by))
        new = np.ones(len(by), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        out = np.empty(len(by), np.int64)
        out[by] = count - np.maximum.accumulate(np.where(new, count, 0))
        return out


def unit_rows(docs: DataFrame, min_words: int, windows: bool) -> DataFrame:
    """(digest, doc_id) of every unit, repeats in a document twice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                u = Units(raw, offsets[lo:hi + 1], min_words, windows)
                own = u.occurrence() < 2
                yield pa.RecordBatch.from_arrays([pa.array(u.digest[own]), pa.array(ids[lo:hi][u.doc[own]])],
                                                 names=["digest", "doc_id"])

    return docs.mapInArrow(run, "digest bigint, doc_id bigint")


MARKED = ("digest bigint, doc_id bigint, text_key bigint, in_doc_first boolean, may_stay boolean, first bigint, last bigint, start bigint, "
          "end bigint, left array<int>, right array<int>, left_at array<int>, right_at array<int>")


def context_rows(docs: DataFrame, planes: tuple[np.ndarray, np.ndarray], bits: int, min_words: int, windows: bool) -> DataFrame:
    """Units whose digest may repeat (first plane); windows with the words beside them: 32-bit hashes,
    nearest first, and the offsets to which each would extend the unit. ``may_stay``: the first
    in a document that may be the earliest one (second plane, of digest ^ doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(planes)
    names = [c.split()[0] for c in MARKED.split(", ")]
    beside = np.arange(window_sizes(min_words)[1] - 1)

    def lists(inside: np.ndarray, values: np.ndarray) -> pa.ListArray:
        ends = np.append(0, inside.sum(axis=1).cumsum()).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = text_buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                u = Units(raw, offsets[lo:hi + 1], min_words, windows)
                pick = np.flatnonzero(in_plane(u.digest, shared.value[0], bits))
                w, first = u.words, u.occurrence()[pick] == 0
                short = (w.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                start, end = u.chars[w.start], u.chars[w.end]
                a, b, d = u.first[pick], u.last[pick], u.doc[pick]
                stay = first & in_plane(u.digest[pick] ^ ids[lo:hi][d], shared.value[1], bits)
                at = u.chars[u.begin][d]                                     # code points before the text
                left, right = a[:, None] - 1 - beside, b[:, None] + beside
                on_left = (left >= w.first[d][:, None]) & u.window[pick][:, None]
                on_right = (right < w.first[d + 1][:, None]) & u.window[pick][:, None]
                left_row, right_row = np.nonzero(on_left)[0], np.nonzero(on_right)[0]
                left, right = left[on_left], right[on_right]
                yield pa.RecordBatch.from_arrays([
                    pa.array(u.digest[pick]), pa.array(ids[lo:hi][d]), pa.array(keys[lo:hi][d]), pa.array(first), pa.array(stay),
                    pa.array(a - w.first[d]), pa.array(b - w.first[d]), pa.array(start[a] - at), pa.array(end[b - 1] - at),
                    lists(on_left, short[left]), lists(on_right, short[right]),
                    lists(on_left, start[left] - at[left_row]), lists(on_right, end[right] - at[right_row]),
                ], names=names)

    return docs.mapInArrow(run, MARKED)


def agreeing(own: str, kept: str) -> str:
    """SQL: how many leading elements of two arrays are equal."""
    both = f"least(size({own}), size({kept}))"
    stop = f"array_position(transform(slice({own}, 1, {both}), (x, i) -> x <> {kept}[i]), true)"
    return f"cast(if({stop} = 0, {both}, {stop} - 1) as int) as {own}_n"


def text_key(text_col: str):
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   windows: bool = True) -> DataFrame:
    """(doc_id, text_key, words, spans): merged stretches of a document to be removed, as
    array<struct<start,end>>; only documents that have some."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.col(text_col).alias("text")).filter("doc_id is not null")
    shared = stash_narrow(unit_rows(base, min_words, windows).groupBy("digest")
                          .agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
                          .filter("n > 1").select("digest", "keeper"), "unit-groups")
    bits = filter_bits(shared.count(), MAX_FILTER_BYTES)
    planes = tuple(member_plane(shared.selectExpr(f"{key} as key"), "key", bits) for key in ("digest", "digest ^ keeper"))
    units = context_rows(base, planes, bits, min_words, windows)
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")
    units = stash(units.withColumn("salt", salt), "unit-context")
    at_keeper = (units.filter("may_stay").select("digest", F.col("doc_id").alias("keeper"), "text_key", "left", "right")
                 .join(shared, ["digest", "keeper"]))
    kept = at_keeper.groupBy("digest").agg(F.min(F.struct("keeper", "text_key", "left", "right")).alias("k"))
    kept = units.select("digest", "salt").distinct().join(kept, "digest").select(
        "digest", "salt", "k.keeper", F.col("k.text_key").alias("kept_key"),
        F.col("k.left").alias("kept_left"), F.col("k.right").alias("kept_right"))
    kept = stash_narrow(kept, "unit-kept")
    marked = units.join(kept, ["digest", "salt"]).filter("not (doc_id = keeper and text_key = kept_key and in_doc_first)")
    marked = marked.selectExpr(
        "doc_id", "text_key", "first", "last", "start", "end", "left_at", "right_at",
        agreeing("left", "kept_left"), agreeing("right", "kept_right"))
    grown = marked.selectExpr(
        "doc_id", "text_key", "first - left_n as first", "last + right_n as last",
        "if(left_n > 0, cast(left_at[left_n - 1] as bigint), start) as start",
        "if(right_n > 0, cast(right_at[right_n - 1] as bigint), end) as end")
    lists = grown.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last", "start", "end")).alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, keys, words, spans = [], [], [], []
            for doc, key, parts in zip(*(c.to_pylist() for c in batch.columns)):
                runs = []
                for p in sorted(parts, key=lambda p: (p["first"], -p["last"])):
                    if runs and p["first"] <= runs[-1][1]:
                        if p["last"] > runs[-1][1]:
                            runs[-1][1], runs[-1][3] = p["last"], p["end"]
                    else:
                        runs.append([p["first"], p["last"], p["start"], p["end"]])
                runs = [r for r in runs if r[1] - r[0] >= min_words]
                if runs:
                    ids.append(doc)
                    keys.append(key)
                    words.append(sum(r[1] - r[0] for r in runs))
                    spans.append([{"start": r[2], "end": r[3]} for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(words, pa.int64()),
                                              pa.array(spans, kind)], names=["doc_id", "text_key", "words", "spans"])

    return lists.mapInArrow(merge, "doc_id bigint, text_key bigint, words bigint, spans array<struct<start:bigint,end:bigint>>")


def span_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                windows: bool = True) -> DataFrame:
    """(doc_id, n_spans, removed_words, removed_chars, spans) of every row; spans as start:end, comma-joined."""
    found = repeated_spans(docs, min_words, id_col, text_col, windows)
    all_ = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"))
    all_ = all_.join(found, ["doc_id", "text_key"], "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    size = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return all_.select("doc_id", F.size(spans).cast("bigint").alias("n_spans"),
                       F.coalesce("words", F.lit(0).cast("bigint")).alias("removed_words"),
                       size.alias("removed_chars"), text.alias("spans"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   windows: bool = True) -> DataFrame:
    """``docs`` without the repeated stretches, other columns as they were."""
    doc, key, spans = (fresh_name(docs, c) for c in ("repeat_doc", "repeat_key", "repeat_spans"))
    found = repeated_spans(docs, min_words, id_col, text_col, windows).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans))
    text = F.col(text_col)
    rest = F.expr(f"""aggregate({spans}, struct(cast(0 as bigint) as pos, '' as out),
        (a, s) -> struct(s.end as pos, concat(a.out, substring(`{text_col}`, cast(a.pos + 1 as int), cast(s.start - a.pos as int))) as out),
        a -> concat(a.out, substring(`{text_col}`, cast(a.pos + 1 as int))))""")
    wide = docs.join(found, (F.col(id_col).cast("bigint") == F.col(doc)) & (text_key(text_col) == F.col(key)), "left")
    return wide.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(rest)).select(*docs.columns)
