import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import language

SCHEMA = "doc_id bigint, text string, lang string, lang_pred int, score string, vector string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, l, 0, "", "") for i, t, l in data], SCHEMA)


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n))


def corpus():
    rng = np.random.default_rng(3)
    sets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ñéüijklm", "dd": "бвгдежз"}
    return [(i, words(rng, sets[l], 30 + i % 50), l) for i, l in enumerate(list(sets) * 60)]


def test_learns_held_out_and_edge_cases(spark):
    data = corpus()
    extra = [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 !!", None), (9004, "abc abd " * 40_000, None), (9005, "éüñi ñüé jñé", None)]
    got = {r.doc_id: r for r in language.identify(rows(spark, data + extra)).collect()}
    assert len(got) == len(data) + 5
    for i, _, lang in data:
        assert got[i].lang_pred == lang and 0 < got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003))
    assert got[9004].lang_pred == "aa" and got[9005].lang_pred == "cc"


def test_cosine_equals_brute_force(spark):
    data = corpus()[:80]
    df = rows(spark, data)
    langs, protos = language.prototypes(df, dim=64)
    space = language.Space(64)

    def bundle(text):
        s = [0]
        for ch in f"{text.lower()} ":
            if ch.isalpha() or s[-1] != 0:
                s.append(ord(ch) if ch.isalpha() else 0)
        total = np.zeros(64)
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
        return total

    own = {l: sum(bundle(t) for _, t, x in data if x == l) for l in langs}
    for l, p in zip(langs, protos):
        assert np.allclose(p, own[l] / np.linalg.norm(own[l]), atol=1e-5)
    got = {r.doc_id: r for r in language.predict(df, langs, protos).collect()}
    for i, t, _ in data[:20]:
        d = bundle(t)
        cos = [d @ own[l] / np.linalg.norm(d) / np.linalg.norm(own[l]) for l in langs]
        assert abs(got[i].score - max(cos)) < 1e-4 and got[i].lang_pred == langs[int(np.argmax(cos))]


def test_no_training_rows_empty_table_repeats(spark):
    assert language.identify(rows(spark, [])).count() == 0
    got = language.identify(rows(spark, [(1, "abc", None), (1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
