import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import links, near_dedup

SCHEMA = "doc_id bigint, text string, rep int, component_id string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], SCHEMA)


def brute(rows, k, percent=80):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x]
        sets[d] = frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = rng.choices(vocab, k=rng.randrange(1, 150))
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 10) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "one"), (5005, "É x"), (5006, "é x"),
                   (5007, "z " * 60_000), (5008, "z z")]


@pytest.mark.parametrize("k,seed", [(2, 1), (5, 2)])
def test_components_match_brute_force(spark, k, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in near_dedup.near_duplicates(docs(spark, rows), k, 80).collect()}
    assert got == brute(rows, k)


def sorted_orders(rng, n):
    """Rows of a few trees whose signatures share first values often, some regions crowded."""
    rows = set()
    while len(rows) < n:
        v = [rng.choice((1, 1, 1, 40000))] + [0] * 3 + [rng.choice((7, 7, 7, 9, rng.randrange(50))) for _ in range(4)]
        k1, k2 = (int.from_bytes(b"".join(x.to_bytes(2, "big") for x in part), "big", signed=True) for part in (v[:4], v[4:]))
        rows.add((rng.randrange(3), k1, k2, rng.randrange(10**6)))
    return sorted(rows)


@pytest.mark.parametrize("cuts", [[], [1], [40, 100], [500, 501, 900, 2600], list(range(50, 3000, 97))])
def test_walk_finds_regions_of_adaptive_depth(cuts):
    """Whatever the ranges, every row gets the region that a count over all rows gives it."""
    rng = random.Random(5)
    rows = sorted_orders(rng, 3000)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batch(part, due=None):
        cols = [pa.array(c, t) for c, t in zip(zip(*part), types)]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(due)] if due else []),
                                          names=["tree", "k1", "k2", "doc_id", "due"][:4 + bool(due)])

    found, edges = [], []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        parts = [batch(rows[i:min(i + 700, b)]) for i in range(a, b, 700)]
        for r in (r for out in near_dedup.walk(iter(parts), False) for r in out.to_pylist()):
            (edges if r["region"] is None else found).append(r)
    edges.sort(key=lambda r: (r["tree"], r["k1"], r["k2"], r["doc_id"]))
    if edges:
        last = batch([(r["tree"], r["k1"], r["k2"], r["doc_id"]) for r in edges], [r["due"] for r in edges])
        found += [r for out in near_dedup.walk(iter([last]), True) for r in out.to_pylist()]
    got = {(r["tree"], r["k1"], r["k2"], r["doc_id"]): r for r in found}
    assert len(got) == len(found)

    def prefix(row, d):
        return row[0], row[1], row[2] >> (128 - 16 * d)

    groups = {d: {} for d in range(near_dedup.SHALLOWEST, near_dedup.BASE + 1)}
    for d, g in groups.items():
        for row in rows:
            g.setdefault(prefix(row, d), []).append(row)
    regions = {}
    for row in rows:
        d = next((d for d, g in groups.items() if len(g[prefix(row, d)]) <= near_dedup.REGION), near_dedup.BASE)
        same = groups[d][prefix(row, d)]
        if len(same) == 1:
            assert row not in got
            continue
        r = got[row]
        assert r["n"] == min(len(same), near_dedup.REGION + 1)
        regions.setdefault((d, *prefix(row, d)), set()).add(r["region"])
        assert r["neighbour"] in {x[3] for x in same} | {x[3] for x in groups[near_dedup.SHALLOWEST][prefix(row, near_dedup.SHALLOWEST)]}
        if len(same) <= near_dedup.REGION:
            assert r["leader"] == min(x[3] for x in same)
    assert all(len(x) == 1 for x in regions.values())
    assert len(set.union(*regions.values())) == len(regions)
    assert any(r["n"] > near_dedup.REGION for r in found) and any(1 < r["n"] <= near_dedup.REGION for r in found)


def test_signature_keys_sort_by_values():
    values = np.arange(near_dedup.PERMUTATIONS, dtype=np.uint16)
    own = values[near_dedup._ORDER]
    assert own.shape == (near_dedup.TREES, near_dedup.DEEPEST)
    assert all(len(set(row)) == near_dedup.DEEPEST for row in own.tolist())


def test_crowded_regions_lose_no_group(spark, monkeypatch):
    """Many copies that differ a little: regions over the limit at every depth."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(200)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), 2).collect()}
    assert got == brute(rows, 2)


def test_links_inside_a_large_family_on_shared_boilerplate(spark, monkeypatch):
    """Members are alike by 0.75 to 0.79, so a family stays apart, but for the two with shorter tails (0.82)."""
    monkeypatch.setattr(near_dedup, "REGION", 2)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(200)]
    rows = [(i, " ".join(shared + [f"u{rng.randrange(10**9)}" for _ in range(22 if i in (70, 90) else 31)])) for i in range(250)]
    want = brute(rows, 5)
    assert sum(not kept for _, _, kept in want.values()) == 1
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    out = near_dedup.near_duplicates(docs(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")]), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(docs(spark, []), 2).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
