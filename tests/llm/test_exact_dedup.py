import hashlib
import re

import numpy as np

from quarry.llm import bloom, exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, key string, keep_id int, maybe int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", "k", 0, 0) for i, t in rows], SCHEMA)


def brute(rows):
    groups, out = {}, {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            out[i] = (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_groups_match_brute_force(spark):
    rows = [(i, f"text  {i % 700}\n") for i in range(1000)] + [(2000, None), (2001, ""), (2002, " "), (2003, "\t\n"),
            (2004, "é x"), (2005, "é x"), (2006, "text 3 "), (2007, "y" * 200_000), (2008, "y" * 200_000)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_saturated_filter_stays_exact(spark):
    rows = [(i, f"t{i % 4000}") for i in range(6000)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup.exact_groups(docs(spark, rows), max_filter_bytes=1 << 8).collect()}
    assert got == brute(rows)


def test_repeated_rows_empty_table_and_drop(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b")]
    out = exact_dedup.exact_groups(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == [
        (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True)]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    kept = exact_dedup.drop_duplicates(docs(spark, [(1, "a"), (2, " a"), (3, "a"), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and len(kept.columns) == 6


def test_plane_has_every_repeated_bit(spark):
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 5000)
    df = spark.createDataFrame([(int(k),) for k in [*keys, *keys[:300]]], "k bigint").repartition(7)
    bits = 1 << 18
    plane = np.unpackbits(bloom.repeated_plane(df, "k", bits))
    hit = plane[bloom.bit_positions(keys, bits)].all(axis=1)
    assert hit[:300].all() and hit[300:].mean() < 0.05
