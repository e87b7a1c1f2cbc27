"""Packing into fixed windows by Karmarkar-Karp differencing (operator 8).

Documents are tokenised whole; what fills a window alone is cut off as a full
window, and what remains is cut into pieces of at most ``max_piece`` tokens.
The pieces are dealt into groups of bounded total length, and one task packs a
group: every piece starts as a partial partition into ``k`` windows holding
that piece alone; the two partials of the largest imbalance are merged so that
the fullest windows of one meet the emptiest of the other, until one near-equal
partition is left. ``k`` starts at ceil(tokens / window) and rises whenever a
window exceeds the capacity.

Defined cases: null and empty texts are documents of the end id alone (one
token, one piece); a repeated row is packed again as its own piece; an empty
table gives no pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import chunks, give_back, keep, prepare, row_slices, stash, text_buffers

WINDOW = 4096
END_ID = 2
MAX_PIECE = 1024               # longest piece of what does not fill a window alone
GROUP_WINDOWS = 256            # windows' worth of tokens that one task packs
CACHE_WORDS = 500_000          # words whose ids a worker remembers in each of two generations
BATCH_WORDS = 20_000           # unknown words encoded at a time
BATCH_BYTES = 1 << 20          # bytes of texts whose words are looked up together

PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, uid bigint")


def letters_and_marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables of bytes: ASCII letters; ASCII punctuation that a word may be cut
    before; the same without the apostrophe, for cuts after it. The signs of special
    tokens are no punctuation here."""
    letter, before = np.zeros(256, bool), np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    before[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    before[list(b"<|>")] = False
    after = before.copy()
    after[ord("'")] = False
    return letter, before, after


class Encoder:
    """Ids of whole texts, one tokenizer call per distinct word.

    The tokenizer's pre-tokenizer never joins characters across white space, nor letters
    and punctuation, and its normaliser works within a word, so the ids of a text are
    those of its words in order; a word is encoded once and remembered. A word begins
    with the space before it, at punctuation after a letter, or at a letter after
    punctuation (but an apostrophe, which takes letters along, and the signs of special
    tokens). Its first letter goes in lower case if white space stands before it and
    ASCII behind it, where no mark can join it. Arrow finds the distinct words of a block
    and gathers their ids. A word of plain Latin letters is one letter run to the
    pre-tokenizer: it goes, in lower case, straight to the merges, many words a call (the
    mark that ends a word tells their ids apart)."""

    PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+")
    LETTER, BEFORE, AFTER = letters_and_marks()

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one thread per Spark task slot
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of words not known yet. A full generation becomes the old one; its words come
        back when met again, and those met no more go with the next."""
        back = self.old.keys() & words if self.old else ()
        self.known.update([(word, self.old[word]) for word in back])
        plain, other = [], []
        for word in words:
            if word not in back:
                (plain if self.PLAIN.fullmatch(word) else other).append(word)
        if plain:
            ids = self.merges.encode_batch_fast([" ".join(plain).lower()], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            marks = np.flatnonzero(self.closes[ids]) + 1
            if len(marks) == len(plain):
                raw, ends = ids.tobytes(), (marks * 4).tolist()
                self.known.update([(word, raw[lo:hi]) for word, lo, hi in zip(plain, [0, *ends], ends)])
            else:                                           # a vocabulary without that mark
                other += plain
        for lo in range(0, len(other), BATCH_WORDS):
            some = other[lo:lo + BATCH_WORDS]
            for word, enc in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[word] = np.array(enc.ids, "<u4").tobytes()

    def words(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the words of the texts between ``bounds`` begin; writes spaces for line
        feeds, and small first letters, into ``raw``."""
        raw[raw == 10] = 32
        space, letter, ascii_ = raw == 32, self.LETTER[raw], raw < 128
        begins = np.zeros(len(raw) + 1, bool)
        begins[:-1] = space
        begins[bounds] = True
        wide = np.zeros(len(raw), bool)                     # last byte of a letter from \u00c0 to \u00ff
        wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        begins[1:-1] |= (letter | wide)[:-1] & self.BEFORE[raw[1:]]
        begins[1:-1] |= self.AFTER[raw[:-1]] & letter[1:]
        first = letter.copy()
        first[1:] &= space[:-1]
        first[:-1] &= ascii_[1:]
        raw[first] |= 32
        return np.flatnonzero(begins)

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text (null: none)."""
        data, offsets = text_buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        for lo, hi in chunks(offsets, BATCH_BYTES):
            bounds = offsets[lo:hi + 1] - offsets[lo]
            raw = data[offsets[lo]:offsets[hi]].copy()
            begins = self.words(raw, bounds)
            block = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(raw))
            block = block.dictionary_encode()
            words = block.dictionary.to_numpy(zero_copy_only=False).tolist()
            new = [word for word in words if word not in self.known]
            if len(self.known) + len(new) > self.cache_words:
                self.old, self.known = self.known, {}
                new = words
            self.learn(new)
            ids = pa.array(map(self.known.__getitem__, words), pa.large_binary(), size=len(words)).take(block.indices)
            _, ends, joined = ids.buffers()
            ends = np.frombuffer(ends, np.int64)[np.searchsorted(begins, bounds)].tolist()
            joined = memoryview(joined) if joined is not None else b""
            for a, b in zip(ends, ends[1:]):
                yield bytes(joined[a:b])


@cache
def shared_encoder(path: str, cache_words: int) -> Encoder:
    return Encoder(path, cache_words)


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One a worker process: later tasks find the words that earlier ones met, until a
    task of another operator begins there."""
    give_back("encoder")
    keep("encoder", shared_encoder.cache_clear)
    return shared_encoder(path, cache_words)


def cut(tokens: int, window: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) pieces of a document: full windows, then equal parts of the rest."""
    full = tokens // window * window
    out = [(s, window) for s in range(0, full, window)]
    rest = tokens - full
    if rest:
        n = -(-rest // max_piece)
        marks = [full + rest * i // n for i in range(n + 1)]
        out += [(a, b - a) for a, b in zip(marks, marks[1:])]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW, max_piece: int = MAX_PIECE, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Token pieces of every document (PIECE_SCHEMA); uid tells repeated rows apart."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path, cache_words)
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in row_slices(whole, 1):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), ids_of.encode(batch.column(1))):
                    ids += end
                    total = len(ids) // 4
                    for start, length in cut(total, window, max_piece):
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total, uid))
                        uid += 1
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, PIECE_SCHEMA)


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp k-way partition: (window of each size, load of each window).

    A partial partition keeps its filled slots alone, fullest first (at first one slot
    with one piece); the slots it does not name are empty. Slots form a forest: a
    slot that a merge joins from either side gets a number of its own, the parent
    of both; windows are read off top-down."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    heap = []
    for rank, item in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        size = int(sizes[item])
        heap.append((-size, rank, [size], [item]))
    merges, nodes, tie = [], n, n
    while len(heap) > 1:
        _, _, la, sa = heapq.heappop(heap)
        _, _, lb, sb = heapq.heappop(heap)
        if len(la) + len(lb) <= k:                  # every filled slot meets an empty one
            loads, slots = la + lb, sa + sb
        else:                                       # the fullest of one side meet the emptiest of the other
            both = len(la) + len(lb) - k
            alone = k - len(lb)
            loads, slots = la[:alone] + lb[:k - len(la)], sa[:alone] + sb[:k - len(la)]
            joined = list(range(nodes, nodes + both))
            merges.append((joined, sa[alone:], sb[k - len(la):][::-1]))
            loads += [x + y for x, y in zip(la[alone:], lb[k - len(la):][::-1])]
            slots += joined
            nodes += both
        by = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, slots = [loads[i] for i in by], [slots[i] for i in by]
        spread = loads[0] - (loads[-1] if len(loads) == k else 0)
        heapq.heappush(heap, (-spread, tie, loads, slots))
        tie += 1
    _, _, loads, slots = heap[0]
    window = np.full(nodes, -1, np.int64)
    window[slots] = np.arange(len(slots))
    for parents, a, b in reversed(merges):
        window[a] = window[parents]
        window[b] = window[parents]
    return window[:n], np.array(loads + [0] * (k - len(loads)))


def pack_group(sizes: np.ndarray, window: int) -> np.ndarray:
    """Window of each size; the window count rises until none exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        where, loads = difference(sizes, k)
        if loads.max(initial=0) <= window:
            return where
        # A window is over by up to (max - window): that much more room is needed on average.
        k += max(1, int(k * (loads.max() - window) / window / 2))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, max_piece: int = MAX_PIECE, group_windows: int = GROUP_WINDOWS,
         cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``cache_words`` trades a worker's memory (some 200 bytes a word and generation) for time."""
    prepare(docs.sparkSession)
    table = stash(pieces(docs, tokenizer_path, id_col, text_col, window, max_piece, cache_words), "pack-pieces")
    full = table.filter(F.col("length") == window)
    rest = table.filter(F.col("length") < window)
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (group_windows * window)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)     # the same result on a retried task
        where = pack_group(group["length"].to_numpy(np.int64), window)
        group["sequence_id"] = (group["bin"].to_numpy(np.int64) << 32) + where
        group = group.sort_values(["sequence_id", "uid"], ignore_index=True)
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns=["bin", "uid"])

    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = (rest.withColumn("bin", F.pmod(F.xxhash64("uid"), F.lit(groups)))
              .groupBy("bin").applyInPandas(run, out))
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                        F.shiftleft(F.lit(1).cast("bigint"), 62).bitwiseOR(F.col("uid")).alias("sequence_id"),
                        F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)
