import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import fp_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, rank int, term string, n int, score string"
ITEMS = "item_id bigint, text string, terms string, doc_id int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    some = [x for x in found if x[2]]
    n_docs, total = len(some), sum(x[2] for x in some)
    df = Counter(t for _, c, _ in some for t in c)
    out = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    for item, want in asked.items():
        scored = []
        for doc, count, n in some:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * count[t]) // (1000 * count[t] + 12 * m)) for t, r in want.items() if t in count)
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=5, **how):
    d = spark.createDataFrame([(i, t, 1, "a", 2, "b") for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    return sorted([tuple(r) for r in S.ranked(d, q, k, **how).collect()], key=str)


WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "año", "中文", "x1", "zeta", "eta"]


def sample(rng, n, longest):
    return [" ".join(rng.choice(WORDS, int(rng.integers(0, longest)), p=np.array([30, 20, 15, 10, 8, 6, 5, 3, 2, 1]) / 100))
            for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"block_terms": 64}, {"max_terms": 4}])
def test_equals_brute_force(spark, how):
    rng = np.random.default_rng(3)
    docs = list(enumerate(sample(rng, 300, 30)))
    docs += [(i, "alpha zeta eta") for i in range(400, 440)]          # many equal scores: smallest ids first
    docs += [(500, None), (501, ""), (502, "--- !!"), (503, "eta " * 5000), (7, docs[7][1]), (None, "eta x1")]
    items = list(enumerate(sample(rng, 12, 12))) + [(20, None), (21, ""), (22, "eta eta ETA, zeta"), (None, "x1"), (3, "eta")]
    assert run(spark, docs, items, **how) == brute(docs, items, 5)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "alpha")]) == []
    assert run(spark, [(1, "alpha beta")], []) == []
    assert run(spark, [(1, None)], [(1, "alpha")]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), min_size=1, max_size=8, unique=True), min_size=1, max_size=60),
       st.lists(st.integers(0, 11), min_size=1, max_size=6, unique=True), st.integers(1, 4))
def test_one_tree(docs, asked, k):
    rng = np.random.default_rng(len(docs))
    docs = [sorted(d) for d in docs]
    tf = [rng.integers(1, 9, len(d)) for d in docs]
    m = rng.integers(75, 200, len(docs))
    ptr = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tree = S.Tree(np.arange(len(docs)), m, ptr, np.concatenate(docs).astype(np.int32), np.concatenate(tf))
    for node in range(len(tree.document)):            # a node's entries bound those of its children
        entry = dict(zip(tree.term[tree.entry[node]:tree.entry[node + 1]].tolist(), tree.tf[tree.entry[node]:].tolist()))
        for child in range(tree.first[node], tree.last[node]):
            for e in range(tree.entry[child], tree.entry[child + 1]):
                assert entry[tree.term[e]] >= tree.tf[e] and tree.m[node] <= tree.m[child]
    assert sorted(tree.document[tree.document >= 0].tolist()) == list(range(len(docs)))
    slot = np.full(12, -1)
    slot[asked] = np.arange(len(asked))
    weight = rng.integers(0, 500, len(asked))
    best = []
    tree.search(slot, weight, best, k)
    want = []
    for i, d in enumerate(docs):
        score = sum(int(S.item_scores(weight[slot[t]], f, m[i])) for t, f in zip(d, tf[i]) if slot[t] >= 0)
        if score > 0:
            want.append((score, -i))
    assert sorted(best, reverse=True) == sorted(want, reverse=True)[:k]


def test_bounds_leave_documents_out():
    """Documents of other vocabularies are never scored."""
    rng = np.random.default_rng(1)
    docs = [sorted(rng.choice(40, 12, replace=False) + 40 * (i % 5)) for i in range(2000)]
    ptr = np.arange(0, 2001 * 12, 12)
    tree = S.Tree(np.arange(2000), np.full(2000, 100), ptr, np.concatenate(docs).astype(np.int32), np.ones(24000, np.int64))
    slot = np.full(200, -1)
    slot[80:90] = np.arange(10)
    best = []
    assert tree.search(slot, np.full(10, 100), best, 5) < 400
    assert len(best) == 5
