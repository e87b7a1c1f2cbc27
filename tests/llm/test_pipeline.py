import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate(low)) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

    kept = cp.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}     # all have a known language

    kept = cp.exact_stage(spark, kept, SF)
    first = {}
    for d in sorted(ids):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    ids = set(first.values())
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and kept.columns == docs.columns

    kept = cp.near_stage(spark, kept, SF)
    sets = {d: shingles(texts[d]) for d in sorted(ids)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    ids = {d for d in sets if find(d) == d}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and kept.columns == docs.columns

    kept = cp.benchmark_stage(spark, kept, SF)
    items = [" ".join(plain(b)) for b in bench]
    ids = {d for d in ids if not any(f" {b} " in f" {' '.join(plain(texts[d]))} " for b in items)}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and kept.columns == docs.columns

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in cp.packing_stage(spark, kept, SF).collect():
        part = np.array(tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")[r.start:r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert set(got) == ids


def test_run_equals_the_stages(spark):
    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ends = out.groupBy("sequence_id").agg((F.max(F.col("offset") + F.col("length")) <= 4096).alias("fits"))
    assert out.count() > 0 and ends.filter("not fits").count() == 0


def test_edge_rows_pass_every_stage(spark):
    rows = [(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "12 ?!", "en", "s", 5), (None, "some words that have no id", "en", "s", 9),
            (4, "the same text here", "en", "s", 1), (4, "the same text here", "en", "s", 1), (5, "the  same text here", "en", "s", 1),
            (6, "le texte " * 30_000, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = sorted(r.doc_id or 0 for r in docs.collect())
    assert left == [0, 4, 4, 6]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_clashing_columns_are_carried(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(
        ["found", "gone", "dropped", "_found", "_gone", "_dropped", "kept", "digest", "score", "signature", "leaks", "spans"])])
    narrow = docs
    for _, stage in cp.STAGES[:-1]:
        wide, narrow = stage(spark, wide, SF), stage(spark, narrow, SF)
    assert wide.columns[:len(docs.columns)] == docs.columns and wide.columns[-1] == "spans"
    assert {r.doc_id for r in wide.collect()} == {r.doc_id for r in narrow.collect()}
    assert all(r[-12:] == tuple(range(12)) for r in wide.collect())
