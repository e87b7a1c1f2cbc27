import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import orchard as O

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, vec int"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(0, 2**32 - 1))
def test_nearest_equals_comparing_all(entries, width, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-6, 6, (entries, width))       # equal entries and many equal distances
    points = rng.integers(-8, 8, (300, width))
    at, far = O.Lists(book).nearest(points)
    away = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (at == away.argmin(axis=1)).all() and (far == away.min(axis=1)).all()


def test_lists_are_left_early():
    """Well-separated entries: a search looks at few of them."""
    rng = np.random.default_rng(2)
    book = rng.integers(-10**6, 10**6, (64, 4))
    lists = O.Lists(book)
    points = book[rng.integers(0, 64, 500)] + rng.integers(-50, 50, (500, 4))
    stops = [int((lists.away[e] <= 4 * ((p - book[e]) ** 2).sum()).sum()) for p, e in zip(points, lists.nearest(points)[0])]
    assert max(stops) < 3


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, l) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])] if kept else []
    x = np.array([[min(max(int(np.floor(256 * np.float64(np.float32(c)))), -2**24), 2**24) for c in v] for _, v, _ in kept], object)
    width = -(-x.shape[1] // parts)
    x = np.hstack([x, np.zeros((len(x), width * parts - x.shape[1]), object)]).reshape(len(x), parts, width)
    books = [x[:entries, p].copy() for p in range(parts)]

    def near(p):
        away = ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return [min(range(len(books[p])), key=lambda i: (row[i], i)) for row in away], [min(row) for row in away]

    for _ in range(rounds):
        new = []
        for p in range(parts):
            at, book = np.array(near(p)[0]), books[p].copy()
            for e in set(at.tolist()):
                some = x[at == e, p]
                book[e] = [int(s) // len(some) for s in some.sum(axis=0)]
            new.append(book)
        books = new
    final = [near(p) for p in range(parts)]
    error = [sum(final[p][1][i] for p in range(parts)) for i in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{final[p][0][n]:02x}" for p in range(parts)), error[n], by_label[label], digest)
                   for n, (i, _, label) in enumerate(kept)), key=str)


def run(spark, rows):
    table = spark.createDataFrame([(i, v, l, "x", "y", 1) for i, v, l in rows], SCHEMA)
    return sorted([tuple(r) for r in O.compress(table.repartition(3)).collect()], key=str)


@pytest.mark.parametrize("n,dimension", [(150, 32), (40, 16), (90, 20), (70, 3)])
def test_equals_brute_force(spark, n, dimension):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(dimension)], [None, 1, 2][i % 3])
            for i in rng.permutation(n)]
    rows += [(-1, None, 1), (-2, [None] * dimension, 1), (-3, [float("nan")] * dimension, 2), (-4, [float("inf")] * dimension, 2),
             (n + 1, [1.0] * (dimension + 1), 1), (n + 2, [], 1), (n + 3, [3e38] * dimension, 7), rows[3]]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []
