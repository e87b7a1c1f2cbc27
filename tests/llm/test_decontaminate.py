import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, leaks int, item_id string, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id bigint, text string, doc_id int")


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def case(seed=1):
    rng = random.Random(seed)
    bench = [(i, " ".join(words(rng, rng.randrange(3, 90)))) for i in range(60)]
    out, want = [], {}
    for d in range(200):
        w = words(rng, rng.randrange(0, 400))
        if d % 4 == 0:
            i, t = rng.choice(bench)
            at = rng.randrange(0, len(w) + 1)
            copy = t if d % 8 else t.upper().replace(" ", ",\n ")
            w[at:at] = [copy]
            want[d] = i
        out.append((d, " ".join(w)))
    return bench, out, want


def brute(bench, texts, percent=80):
    """Every place of every text against every item, by the same similarity."""
    index = dc.Index(bench, percent)
    found = {}
    for d, t in texts:
        raw, offsets = dc.text_buffers(pa.array([t], pa.string()))
        w = dc.Words(raw, offsets, dc.separators(False), fold_latin=True).hash
        for i, own in enumerate(index.words):
            for a in range(max(0, len(w) - len(own) + 1)) if len(own) else ():
                if index.similarity(i, w[a:a + len(own)]) * 100 >= percent:
                    found.setdefault(d, set()).add(index.ids[i])
    return found


def test_planted_copies_and_brute_force(spark):
    bench, texts, want = case()
    extra = [(900, None), (901, ""), (902, "?? !!"), (903, "ab cd " * 50_000 + bench[7][1])]
    rows = dc.leak_report(docs(spark, texts + extra), items(spark, bench + [(70, None), (71, ""), (72, "..")])).collect()
    got = {r.doc_id: set(map(int, r.item_ids.split(","))) for r in rows if r.contaminated}
    assert len(rows) == 204 and all(i in got[d] for d, i in want.items()) and 7 in got[903]
    small = texts[:60]
    exact = brute(bench, small)
    assert {d: s for d, s in got.items() if d < 60} == exact
    assert all(r.n_items == 0 and r.spans == "" and r.best_similarity == 0 for r in rows if not r.contaminated)


def test_near_copies_long_items(spark):
    rng = random.Random(3)
    bench = [(i, " ".join(words(rng, 80))) for i in range(10)]
    texts = []
    for d in range(10):
        w = bench[d][1].split()
        w[rng.randrange(8, 72)] = "changedword"
        texts.append((d, " ".join(words(rng, 50) + w + words(rng, 50))))
    got = {r.doc_id: r.item_ids for r in dc.leak_report(docs(spark, texts), items(spark, bench)).collect()}
    assert sum(got[d] == str(d) for d in range(10)) >= 9


def test_copies_cut_off_by_the_ends_of_the_document(spark):
    """Trimmed by 3 to 10 % at the edges, against all windows that the document clips."""
    rng = random.Random(5)
    bench = [(i, " ".join(words(rng, rng.randrange(40, 80)))) for i in range(12)]
    texts, want = [], {}
    for i, t in bench:
        w = t.split()
        for part in (0.03, 0.06, 0.1):
            cut, rest = max(3, round(part * len(w))), words(rng, 50)
            for own in (w[cut:] + rest, rest + w[:-cut], w[cut:], w[:-cut]):
                want[len(texts)] = {i}
                texts.append((len(texts), " ".join(own)))
    index, exact = dc.Index(bench, 80), {}
    for d, t in texts:
        raw, offsets = dc.text_buffers(pa.array([t], pa.string()))
        w = dc.Words(raw, offsets, dc.separators(False), fold_latin=True).hash
        for i, own in enumerate(index.words):
            if any(index.similarity(i, w[max(0, a):max(0, a + len(own))]) >= 0.8 for a in range(-len(own) // 4, len(w))):
                exact.setdefault(d, set()).add(i)
    rows = dc.leak_report(docs(spark, texts), items(spark, bench)).collect()
    got = {r.doc_id: set(map(int, r.item_ids.split(","))) for r in rows if r.contaminated}
    assert got == exact == want
    assert dc.clean(docs(spark, texts), items(spark, bench)).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    index = dc.Index([(i, " ".join(words(random.Random(i), 20))) for i in range(50)], 80)
    size, (known, *_) = next(iter(index.classes.items()))
    prints = known[rng.integers(0, len(known), 300)].copy()
    for j in range(300):
        for bit in rng.choice(64, rng.integers(0, 12), replace=False):
            prints[j] ^= np.uint64(1) << np.uint64(bit)
    w, f = index.candidates(prints, size)
    want = {(i, j) for i in range(300) for j in range(len(known)) if int(prints[i] ^ known[j]).bit_count() <= dc.RADIUS}
    assert set(zip(w.tolist(), f.tolist())) == want


def test_several_passes_empty_tables_and_clean(spark):
    bench, texts, want = case(2)
    one = dc.leak_report(docs(spark, texts), items(spark, bench))
    many = dc.leak_report(docs(spark, texts), items(spark, bench), limit=500)
    key = lambda df: sorted((r.doc_id, r.item_ids) for r in df.collect())
    assert key(one) == key(many)
    assert dc.leak_report(docs(spark, []), items(spark, bench)).count() == 0
    assert dc.leak_report(docs(spark, texts), items(spark, [])).filter("contaminated").count() == 0
    kept = dc.clean(docs(spark, texts), items(spark, bench))
    assert len(kept.columns) == 5 and not {r.doc_id for r in kept.collect()} & set(want)
