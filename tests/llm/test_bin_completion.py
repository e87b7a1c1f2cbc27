import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import bin_completion as B

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length int, piece string, part string, nth int"


def optimum(sizes, window):
    """Fewest windows, over all subsets."""
    best = [(0, window)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for m in range(1, 1 << len(sizes)):
        for i, size in enumerate(sizes):
            if m >> i & 1:
                k, used = best[m ^ (1 << i)]
                best[m] = min(best[m], (k, used + size) if used + size <= window else (k + 1, size))
    return best[-1][0]


def counts_of(sizes, window):
    return np.bincount(np.array(sizes, np.int64), minlength=window)


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w - 1), max_size=10))))
def test_search_reaches_the_optimum(case):
    window, sizes = case
    counts = counts_of(sizes, window)
    best = B.complete(counts, window)
    used = np.zeros(window, np.int64)
    for filling, times in best:
        assert sum(s * u for s, u in filling) <= window
        for size, uses in filling:
            used[size] += uses * times
    assert (used == counts).all()
    assert sum(t for _, t in best) == optimum(sizes, window)
    assert B.lower_bound(counts, window) <= optimum(sizes, window)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=9))
def test_fillings_leave_out_dominated_sets_only(sizes):
    """Every feasible set beside the largest piece is a filling, or gives way to one that
    holds its pieces in as many or fewer places."""
    window = 20
    search = B.Search(counts_of(sizes, window), window)
    search.work = 10**6
    found = [f for f, _ in search.fillings(window)]
    largest = max(sizes)
    assert found and all(f[0][0] == largest for f in found)
    rest = sorted(sizes)
    rest.remove(largest)
    feasible = {tuple(sorted(s for i, s in enumerate(rest) if m >> i & 1)) for m in range(1 << len(rest))}
    feasible = {s for s in feasible if sum(s) <= window - largest}

    def fits(small, big):
        """Whether the pieces of ``small`` can be dealt into pieces of ``big``."""
        if not small:
            return True
        return any(small[-1] <= b and fits(small[:-1], big[:i] + (b - small[-1],) + big[i + 1:])
                   for i, b in enumerate(big))

    sets = []
    for filling in found:
        some = [s for s, u in filling for _ in range(u)]
        some.remove(largest)
        sets.append(tuple(sorted(some)))
    for some in feasible:
        assert any(fits(some, chosen) for chosen in sets), (sizes, some, sets)


def test_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(1, 60, 80).tolist()
        rooms = []
        for size in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - size)
            else:
                rooms.append(60 - size)
        best = B.best_fit(counts_of(sizes, 60).tolist(), 60)
        assert sum(t for _, t in best) == len(rooms)
        left = sorted(60 - sum(s * u for s, u in f) for f, t in best for _ in range(t))
        assert left == sorted(rooms)


def test_search_beats_best_fit_decreasing():
    sizes = [6, 6, 5, 5, 5, 4, 4, 3, 2]             # 40 tokens, windows of 10: best fit needs five
    assert sum(t for _, t in B.best_fit(counts_of(sizes * 1000, 10).tolist(), 10)) > 4000
    assert sum(t for _, t in B.complete(counts_of(sizes * 1000, 10), 10)) == 4000


def encode_all(texts, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in texts]


@pytest.mark.parametrize("window", [16, 4096])
def test_every_token_once_in_gapless_windows(spark, window):
    texts = ["The quick brown fox jumps over it.", None, "", "a " * 9000, "the same text", "the same text",
             "Señor, años — ¿qué? 中文 字", "x"] + ["word " * n for n in range(1, 60)]
    rows = [(i, t, 1, "a", "b", 3) for i, t in enumerate(texts)] + [(4, "the same text", 1, "a", "b", 3)]
    got = B.pack_few(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, window=window).collect()
    ids = dict(enumerate(encode_all(texts, B.END_ID)))
    copies = {i: 2 if i == 4 else 1 for i in ids}
    windows, seen = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.start == r.piece * window and (r.length == window or r.start + r.length == len(ids[r.doc_id]))
        seen.setdefault(r.doc_id, []).append(r.piece)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, whole in ids.items():
        assert sorted(seen[i]) == sorted(list(range(-(-len(whole) // window))) * copies[i])
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    lengths = [r.length for r in got]
    alone = sum(n == window for n in lengths)
    assert len(windows) >= alone + B.lower_bound(counts_of([n for n in lengths if n < window], window), window)


def test_empty_table(spark):
    assert B.pack_few(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_whole_table_is_packed_without_loss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = B.pack_few(docs, PATH)
    tokens, windows, rows = got.agg(F.sum("length"), F.countDistinct("sequence_id"), F.countDistinct("doc_id")).first()
    assert rows == docs.count()
    assert windows <= -(-tokens // B.WINDOW) + 1
