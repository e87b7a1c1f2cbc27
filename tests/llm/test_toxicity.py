import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import toxicity

DOCS = "doc_id bigint, text string, toxic int, gram string, label_id int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, 9, "", 0) for i, t in data], DOCS)


def marks(spark, data):
    return spark.createDataFrame([(i, y, 0) for i, y in data], "doc_id bigint, toxic int, text int")


def corpus(n=600):
    rng = np.random.default_rng(8)
    common = ["".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["zgrump", "vaxkof", "quizzle"]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(20, 200)))
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choice(bad, 4):
                words.insert(int(rng.integers(0, len(words))), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, "?!"), (9004, docs[1][1] + " " + "abc " * 60_000 + "zgrump vaxkof zgrump quizzle")]
    out = toxicity.toxicity(rows(spark, docs + extra), marks(spark, labels + [(1, None), (77777, 1)])).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    assert np.mean([p == y for p, y in held]) > 0.98
    assert got[9004].peak > 1 and got[9001].predicted == got[9002].predicted == 0


def test_ratios_equal_brute_force_kneser_ney(spark):
    docs, labels = corpus(80)
    y = dict(labels)
    train = spark.createDataFrame([(t, bool(y[i])) for i, t in docs], "text string, toxic boolean").repartition(3)
    tables = toxicity.ratio_tables(toxicity.class_counts(train, "text"))
    top = [Counter(), Counter()]
    for i, t in docs:
        s = f" {t} "
        top[y[i]].update(s[j:j + 5] for j in range(len(s) - 4))
    counts = {5: top}
    for n in range(4, 0, -1):
        counts[n] = [Counter(g[1:] for g in counts[n + 1][c]) for c in (0, 1)]
    pooled = counts[1][0] + counts[1][1]
    context = {n: [defaultdict(list) for _ in (0, 1)] for n in counts}
    for n in counts:
        for c in (0, 1):
            for g, k in counts[n][c].items():
                context[n][c][g[:-1]].append(k)

    def p(c, g):
        n = len(g)
        if n == 1:
            return pooled[g] / sum(pooled.values())
        seen = context[n][c].get(g[:-1])
        if not seen:
            return p(c, g[1:])
        return (max(counts[n][c][g] - 0.75, 0) + 0.75 * len(seen) * p(c, g[1:])) / sum(seen)

    text = docs[0][1] + " zqy " + docs[6][1][:200]
    sym, doc = toxicity.symbols([text])
    codes, _ = toxicity.gram_codes(sym, doc, 5, toxicity.SYMBOL_BITS)
    got = toxicity.log_ratios(codes, tables)
    s = f" {text} "
    want = [math.log(p(1, s[j:j + 5]) / p(0, s[j:j + 5])) if s[j + 4] in pooled else None for j in range(len(s) - 4)]
    known = [j for j, w in enumerate(want) if w is not None and all(ch in pooled for ch in s[j:j + 5])]
    assert len(known) > 300
    close = [abs(got[j] - want[j]) < 1e-3 for j in known]
    assert np.mean(close) > 0.99          # the rest shares a slot of a scoring table


def test_no_labels_empty_table_repeats(spark):
    out = toxicity.toxicity(rows(spark, [(1, "abc def"), (1, "abc def")]), marks(spark, [])).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.0, 0)] * 2
    assert toxicity.toxicity(rows(spark, []), marks(spark, [])).count() == 0
