import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length int, bin int, start string"


def check(df, texts, window=packing.WINDOW):
    """Every id in exactly one piece, gapless offsets, capacity kept, ids as encoded."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    rows = df.collect()
    seen, seqs = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(ids)
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[d])
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    return seqs


def test_pack_matches_tokenizer(spark):
    long = " ".join(f"Wörter{i} are, the\tword{i}!!" for i in range(3000))
    texts = {1: None, 2: "", 3: "a", 4: long, 5: "Σας ΟΔΟΣ ſ İ é é  x y \x1c z", 6: "tab\tline\r\n end's we'll",
             7: "<|endoftext|> mid<|startoftext|>x", 8: "ﬁ x́ ́́ ́"}
    df = spark.createDataFrame([(k, v, 9, 9, "x") for k, v in texts.items()], SCHEMA)
    check(packing.pack(df, PATH), texts)


def test_real_documents_pack_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    seqs = check(packing.pack(docs, PATH), texts)
    used = sum(n for s in seqs.values() for _, n in s)
    assert used / (len(seqs) * packing.WINDOW) > 0.97


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty, PATH).count() == 0
    twice = spark.createDataFrame([(1, "one two", 0, 0, "")] * 3, SCHEMA)
    rows = packing.pack(twice, PATH).collect()
    assert len(rows) == 3 and {r.doc_tokens for r in rows} == {rows[0].doc_tokens}
    assert sorted(r.offset for r in rows) == [0, rows[0].length, 2 * rows[0].length]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_differencing_is_a_partition(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1000, 400)
    where, loads = packing.difference(sizes, 20)
    assert np.bincount(where, weights=sizes, minlength=20).astype(int).tolist() == loads.tolist()
    assert loads.max() - loads.min() < 0.02 * loads.mean()
    assert np.bincount(packing.pack_group(sizes, 2000), weights=sizes).max() <= 2000


def test_small_cache_gives_the_same_ids():
    texts = [f"word{i % 7} Other{i} again, stem{i % 90}s {i}" for i in range(600)]
    plain, small = packing.Encoder(PATH), packing.Encoder(PATH, cache_words=50)
    want = list(plain.encode(texts))
    for _ in range(2):
        got = [ids for lo in range(0, 600, 20) for ids in small.encode(texts[lo:lo + 20])]
        assert got == want
    assert len(small.known) <= 200


def test_differencing_of_many_tiny_pieces():
    import tracemalloc
    tracemalloc.start()
    where = packing.pack_group(np.full(100_000, 1), 4096)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert np.bincount(where).max() <= 4096 and where.max() + 1 == 25


def test_differencing_loads_add_up():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes, k = rng.integers(1, 50, rng.integers(1, 40)), int(rng.integers(1, 12))
        where, loads = packing.difference(sizes, k)
        assert (np.bincount(where, sizes, k).astype(int) == loads).all() and len(loads) == k


def encodes(texts, ids):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [np.frombuffer(b, "<u4").tolist() for b in ids] == [e.ids for e in want]


def test_a_word_is_learnt_once_whatever_its_first_case_and_marks():
    stems = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7)) + "en\u00e9" * (i % 2) for i in range(200)]
    texts = [" ".join(w + tail for w in stems for tail in ("", ",", ".", "!?", ";", ")", ":")),
             "\n".join(("(" if i % 3 else "") + w.title() for i, w in enumerate(stems))]
    enc = packing.Encoder(PATH)
    assert encodes(texts, enc.encode(texts))
    assert len(enc.known) < 2.5 * len(set(stems))


def test_cut_words_keep_the_ids_of_marks_apostrophes_and_special_tokens():
    parts = ["T", "J", "\u030c", "\u0331", "\u0338", "\u0130", "\u00c9", "\u00e9", "\u00d7", "\u00f7", "\u03a3", "\u212a",
             "'", "'s", "'LL", "s", "t", ",", ".", "-", "_", "(", "\"", "\u201d", "\u2026", "=", "<", "|", ">", "7", " ", "\n", "\t",
             "\u00a0", "\x0b", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", " The", "\ud55c", "\u1112"]
    rng = np.random.default_rng(8)
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 12, 8000)]
    for c in range(0xA0, 0x500):
        texts.append(f" T{chr(c)}x \u00c9{chr(c)}. a,{chr(c)} ({chr(c)}a \u00c9,{chr(c)}\n{chr(c)}J{chr(c)}'s {chr(c)}, {chr(c)}T -{chr(c)}- I{chr(c)}")
    assert encodes(texts, packing.Encoder(PATH).encode(texts))


def test_texts_without_words_between_others():
    enc = packing.Encoder(PATH)
    for texts in ([""], ["", ""], ["a", "", "", "b"], [" ", "\n", ""], [""] * 3 + ["A"]):
        assert encodes(texts, enc.encode(texts))
    assert list(enc.encode([None, "a", None])) == [b"", *enc.encode(["a"]), b""]
