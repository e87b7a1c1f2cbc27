"""Helpers shared by the training-data operators: session set-up, scratch
tables in the shared folder, and vectorised word hashing over Arrow buffers.

Word hashing reads the UTF-8 bytes of a whole Arrow chunk at once: every byte
is replaced by a 64-bit random number, multiplied by a running odd power and
summed cumulatively, so the hash of any word is a difference of two prefix
sums (all arithmetic modulo 2^64). Equal words get equal hashes wherever they
stand; different words collide with a chance of about 2^-60 per pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, scratch_path, ship_package

CHUNK_BYTES = 1 << 18          # text bytes hashed at a time (a longer single text is one chunk)

FILES_PER_CORE = 2

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20          # bytes of an Arrow batch, unless the session sets its own

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW_INV = np.uint64(pow(int(_POW_BASE), -1, 2**64))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# The white space of the operator contracts.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder known, package importable in Python workers, and Arrow
    batches bounded by bytes: whole texts are long, so a bound on rows is none."""
    ensure_checkpoint_dir(spark)
    if spark.conf.get(ARROW_BYTES).rstrip("bB") == str(64 << 20):       # Spark's own default
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    ship_package(spark)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it
    back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stash_narrow(df: DataFrame, name: str) -> DataFrame:
    """``stash`` for tables of ids and counts: at most FILES_PER_CORE files for every
    core of the cluster. Shuffle partitions are then written several by one task,
    one after the other, so a task holds no more than before."""
    files = FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return stash(df.coalesce(files), name)


_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Note that tasks of ``owner`` leave something in this worker process for later tasks."""
    _KEPT[owner] = drop


def give_back(owner: str = "") -> None:
    """Drop what tasks of other operators left in this reused worker process, and return
    the memory to the system. Called where a task begins."""
    others = [o for o in _KEPT if o != owner]
    for other in others:
        _KEPT.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):           # another C library: it keeps its free lists
            pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 byte offsets of a string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (lo, hi) whose texts together stay near ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def row_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES * 16):
    """Slices of an Arrow batch whose texts together stay near ``limit`` bytes (one
    longer text is a slice of its own), so Python copies of texts stay few."""
    _, offsets = text_buffers(batch.column(column))
    for lo, hi in chunks(offsets, limit):
        yield batch.slice(lo, hi - lo)


_POWS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWS or len(_POWS["p"]) < n:
        m = max(n, CHUNK_BYTES + (1 << 16))
        p, q = np.full(m, _POW_BASE), np.full(m, _POW_INV)
        p[0] = q[0] = 1
        _POWS["p"], _POWS["q"] = np.cumprod(p), np.cumprod(q)
    return _POWS["p"][:n], _POWS["q"][:n]


def separators(white_only: bool = True) -> np.ndarray:
    """Lookup table byte -> is separator: white space, or all ASCII but letters and digits."""
    table = np.zeros(256, bool)
    if white_only:
        table[list(WHITE)] = True
    else:
        table[:128] = True
        table[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return table


class Words:
    """Words of a chunk of texts: ``hash``, byte ``start``/``end`` within the
    chunk's buffer, and ``first`` (word index where each text begins, n+1)."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray, fold_latin: bool = False):
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = raw[base:base + size]
        bounds = (offsets - base).astype(np.int64)
        if size == 0:
            self.hash = np.zeros(0, np.uint64)
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = ~sep[data]
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        before = np.empty(size, bool)
        before[0] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(size, bool)
        after[-1] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        low = data
        upper = (data >= 65) & (data <= 90)
        if fold_latin:
            prev = np.zeros(size, np.uint8)
            prev[1:] = data[:-1]
            upper |= (prev == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = data + (upper.view(np.uint8) << 5)
        p, q = _powers(size)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[low] * p, out=run[1:])
        self.hash = mix64((run[self.end] - run[self.start]) * q[self.start])
        self.first = np.searchsorted(self.start, bounds)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; a shorter, non-empty
    sequence is one shingle as a whole."""
    n = len(words)
    if n == 0:
        return words
    weights = mix64(np.arange(1, k + 1, dtype=np.uint64) * _POW_BASE) | np.uint64(1)
    if n < k:
        total = np.array([n], np.uint64)
        for j in range(n):
            total = total + words[j:j + 1] * weights[j:j + 1]
        return mix64(total)
    out = words[:n - k + 1] * weights[0]
    for j in range(1, k):
        out = out + words[j:n - k + 1 + j] * weights[j]
    return mix64(out + np.uint64(k))
