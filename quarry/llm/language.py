"""Language identification by hyperdimensional profiles (operator 9).

Every letter has a random vector of +1 and -1 (seeded by its code point). The
vector of a letter n-gram binds its letters' vectors: the product of each,
rotated by its place. A language prototype bundles (adds) the n-gram vectors of
all training texts of that language; a document bundles its own n-grams, and
the language whose prototype has the largest cosine with it wins.

Training sums letter n-gram counts per language with Spark and bundles each
count once, which gives the same prototypes as bundling text by text. Only the
prototypes (languages x ``dim`` numbers) reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
so is everything when no training row has a language. Ties go to the
alphabetically first language. Repeated rows give repeated results; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from quarry.llm.common import fresh_name, give_back, prepare
from quarry.llm.letters import gram_codes, letter_runs, text_chunks

DIM = 1024
ORDER = 3
SYMBOL_BITS = 21               # a code point
FLUSH_GRAMS = 1 << 22          # n-gram counts that a training task holds before it emits their sums


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


class Space:
    """Random letter vectors, made when first met."""

    def __init__(self, dim: int):
        self.dim, self.letters = dim, {}

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = np.random.default_rng([7, cp]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[cp]

    def bind(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Vectors of n-gram codes (one row each, float32)."""
        out = np.ones((len(codes), self.dim), np.int8)
        for place in range(order):
            cps = (codes >> np.uint64(SYMBOL_BITS * (order - 1 - place))) & np.uint64((1 << SYMBOL_BITS) - 1)
            each, at = np.unique(cps, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(c)), order - 1 - place) for c in each])
            out *= table[at]
        return out.astype(np.float32)


def counts_by_language(docs: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, gram, n) over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_chunks(texts):
                sym, doc, _ = letter_runs(texts[lo:hi])
                codes, of = gram_codes(sym, doc, order, SYMBOL_BITS)
                number, names = pd.factorize(np.array(langs[lo:hi], object))
                for i, lang in enumerate(names):
                    at, each = pd.factorize(codes[number[of] == i])
                    held.setdefault(lang, []).append((each, np.bincount(at, minlength=len(each))))
                    size += len(each)
                if size > FLUSH_GRAMS:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    def emit(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            at, each = pd.factorize(np.concatenate([c for c, _ in parts]))
            n = np.bincount(at, weights=np.concatenate([k for _, k in parts]), minlength=len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(each), pa.string()), pa.array(each.astype(np.int64)), pa.array(n)],
                                             names=["lang", "gram", "n"])

    parts = docs.select(text_col, lang_col).filter(F.col(lang_col).isNotNull()).mapInArrow(
        run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM,
               order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit-length prototypes."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Space(dim), {}
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.iloc[lo:lo + 4096]
                vectors = space.bind(part["gram"].to_numpy(np.int64).view(np.uint64), order)
                for lang, rows in part.groupby("lang").indices.items():
                    add = part["n"].to_numpy(np.float64)[rows] @ vectors[rows]
                    sums[lang] = sums.get(lang, 0) + add
        yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sort(np.stack(group["vector"].to_numpy()), axis=0).sum(axis=0)    # whatever the order of parts
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "vector": [total.tolist()]})

    shape = "lang string, vector array<double>"
    rows = (counts_by_language(docs, text_col, lang_col, order).mapInPandas(bundle, shape)
            .groupBy("lang").applyInPandas(add_up, shape).collect())
    rows = sorted((r["lang"], np.array(r["vector"])) for r in rows if any(r["vector"]))
    if not rows:
        return [], np.zeros((0, dim), np.float32)
    return [lang for lang, _ in rows], np.stack([v / np.linalg.norm(v) for _, v in rows]).astype(np.float32)


def classify(texts: list, langs: list[str], protos: np.ndarray, order: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Language and cosine of every text."""
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    for lo, hi in text_chunks(texts) if langs else ():
        sym, doc, has = letter_runs(texts[lo:hi])
        codes, of = gram_codes(sym, doc, order, SYMBOL_BITS)
        if not len(codes):
            continue
        at, each = pd.factorize(codes)
        vectors = np.zeros((hi - lo, protos.shape[1]), np.float32)
        for a in range(0, len(each), 2048):                      # bounded blocks of n-gram vectors
            own = (at >= a) & (at < a + 2048)
            width = min(2048, len(each) - a)
            n = np.bincount(of[own] * width + at[own] - a, minlength=(hi - lo) * width)
            vectors += n.reshape(hi - lo, width).astype(np.float32) @ space.bind(each[a:a + width], order)
        length = np.linalg.norm(vectors, axis=1)
        cosine = vectors @ protos.T / np.maximum(length, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        lang[lo:hi] = np.where(has, np.array(langs, object)[best], "und")
        score[lo:hi] = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0)
    return lang, score


def predicted(docs: DataFrame, langs: list[str], protos: np.ndarray, text_col: str = "text", order: int = ORDER) -> Column:
    """Column struct<lang_pred, score> of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(protos)

    @pandas_udf("lang_pred string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        give_back("language")
        lang, score = classify(texts.tolist(), langs, model.value, order, Space(model.value.shape[1]))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return found(F.col(text_col))


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            order: int = ORDER) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.select("doc_id", predicted(own, langs, protos, "text", order).alias("found")).select("doc_id", "found.*")


def accepted(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             dim: int = DIM, order: int = ORDER) -> DataFrame:
    """Rows of ``docs`` whose language is known with a cosine of at least ``least``, columns as they were."""
    prepare(docs.sparkSession)
    langs, protos = prototypes(docs.filter(fold(F.col(id_col)) != 2), text_col, lang_col, dim, order)
    found = fresh_name(docs, "found")
    verdict = docs.withColumn(found, predicted(docs, langs, protos, text_col, order))
    return verdict.filter((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= least)).drop(found)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             dim: int = DIM, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows outside the held-out fold, predicted for all."""
    prepare(docs.sparkSession)
    langs, protos = prototypes(docs.filter(fold(F.col(id_col)) != 2), text_col, lang_col, dim, order)
    found = predict(docs, langs, protos, id_col, text_col, order)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
