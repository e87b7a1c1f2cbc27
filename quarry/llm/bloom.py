"""Two-plane Bloom filter built by Spark tasks: finds keys that may occur twice.

Every key sets ``HASHES`` bits. A bit belongs to the *repeated* plane once two
keys have set it. A key that really occurs twice has all its bits there, so
testing all bits against that plane misses no repeated key; a single key
passes only by chance. The number of bits follows the row count and is bounded
by ``max_bytes``: beyond the bound the filter lets more single keys through,
and results stay exact because callers confirm what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from quarry.llm.common import give_back, mix64

HASHES = 3
BITS_PER_KEY = 16
SEGMENT_BITS = 1 << 18         # bits that one merge group holds (32 KiB per plane and task)
FLUSH_KEYS = 1 << 20           # keys a task holds before it emits their bits


def filter_bits(rows: int, max_bytes: int) -> int:
    """Power of two: BITS_PER_KEY bits a key, at most ``max_bytes``."""
    want = max(SEGMENT_BITS, rows * BITS_PER_KEY)
    return min(1 << (want - 1).bit_length(), 1 << (max_bytes * 8).bit_length() - 1)


def bit_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """HASHES distinct-seeded bit positions per key (shape keys x HASHES)."""
    keys = keys.astype(np.int64).view(np.uint64)
    return np.stack([mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) & np.uint64(bits - 1)
                     for i in range(HASHES)], axis=1).astype(np.int64)


def _pack(offsets: np.ndarray, seg_bits: int) -> bytes:
    """Segment-local sorted bit numbers: a bitmap, or the numbers where that is shorter."""
    if len(offsets) * 4 < seg_bits // 8:
        return b"s" + offsets.astype(np.uint32).tobytes()
    plane = np.zeros(seg_bits, np.uint8)
    plane[offsets] = 1
    return b"d" + np.packbits(plane).tobytes()


def _add(plane: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"s":
        at = np.frombuffer(packed, np.uint32, offset=1)
        plane[at] = np.minimum(plane[at] + 1, 2)
    else:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1))
        np.minimum(plane + bits, 2, out=plane)


def repeated_plane(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """Packed bitmap (``bits``/8 bytes) of the bits that two rows of ``df`` set."""
    return _plane(df, key, bits, 2)


def member_plane(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """Packed bitmap of the bits that any row of ``df`` sets: a plain Bloom filter."""
    return _plane(df, key, bits, 1)


def _plane(df: DataFrame, key: str, bits: int, least: int) -> np.ndarray:
    """Bits that ``least`` rows set.

    Tasks emit packed bit planes by segment, one task merges one segment, and
    only the finished plane (size bound: ``max_bytes``) reaches the driver."""
    seg_bits = min(SEGMENT_BITS, bits)

    def emit(keys: np.ndarray) -> Iterator[pd.DataFrame]:
        pos = bit_positions(keys, bits)
        pos.sort(axis=1)
        own = np.ones_like(pos, bool)
        own[:, 1:] = pos[:, 1:] != pos[:, :-1]          # a key counts once per bit
        at, n = np.unique(pos[own], return_counts=True)
        cuts = np.flatnonzero(np.diff(at // seg_bits)) + 1
        rows = []
        for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
            seg = int(at[lo]) // seg_bits
            local = at[lo:hi] - seg * seg_bits
            rows.append((seg, _pack(local, seg_bits), _pack(local[n[lo:hi] > 1], seg_bits)))
        yield pd.DataFrame(rows, columns=["seg", "once", "twice"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("bloom")
        held, size = [], 0
        for batch in batches:
            held.append(batch[key].to_numpy())
            size += len(batch)
            if size >= FLUSH_KEYS:
                yield from emit(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from emit(np.concatenate(held))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(seg_bits, np.uint8)
        for once, twice in zip(group["once"], group["twice"]):
            _add(plane, once)
            _add(plane, twice)
        return pd.DataFrame([(int(group["seg"].iloc[0]), np.packbits(plane >= least).tobytes())], columns=["seg", "plane"])

    parts = df.select(key).mapInPandas(build, "seg int, once binary, twice binary")
    merged = parts.groupBy("seg").applyInPandas(merge, "seg int, plane binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():                     # at most bits / 8 bytes
        at = row["seg"] * (seg_bits // 8)
        out[at:at + seg_bits // 8] = np.frombuffer(row["plane"], np.uint8)
    return out


def in_plane(keys: np.ndarray, plane: np.ndarray, bits: int) -> np.ndarray:
    """Which keys have every bit set in ``plane``."""
    pos = bit_positions(keys, bits)
    return ((plane[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).all(axis=1)


def may_contain(df: DataFrame, key: str, plane: np.ndarray, bits: int) -> Column:
    """Boolean column: every bit of the key is set in ``plane`` (broadcast once)."""
    shared = df.sparkSession.sparkContext.broadcast(plane)

    @pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(in_plane(keys.to_numpy(), shared.value, bits))

    return test(F.col(key))
