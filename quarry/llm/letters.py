"""Letter sequences of whole texts as numpy arrays (for character models)."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

CHUNK_CHARS = 1 << 20


@cache
def letter_kinds() -> np.ndarray:
    """Per code point: 1 letter, 2 mark (belongs to the word, is no letter), 0 other."""
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c in "LM":
            kinds[cp] = 1 if c == "L" else 2
    return kinds


def text_chunks(texts: list, limit: int = CHUNK_CHARS):
    """(lo, hi) ranges of texts of about ``limit`` characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def letter_runs(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text number of each symbol, text has a letter).

    Symbols are lower-case code points; every run of other characters is one 0,
    and every text starts and ends with a 0. Null counts as empty."""
    low = [f" {t.lower()} " if t else "  " for t in texts]
    cps = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    kind = letter_kinds()[cps]
    sym = np.where(kind > 0, cps, 0).astype(np.uint64)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    has = np.zeros(len(low), bool)
    has[doc[kind == 1]] = True
    return sym[keep], doc[keep], has


def gram_codes(sym: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes (``bits`` a symbol, first symbol highest) that lie in one text, and their text number."""
    if len(sym) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = sym[:len(sym) - n + 1].copy()
    for j in range(1, n):
        code = (code << np.uint64(bits)) | sym[j:len(sym) - n + 1 + j]
    own = doc[:len(sym) - n + 1] == doc[n - 1:]
    return code[own], doc[n - 1:][own]
