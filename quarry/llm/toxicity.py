"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two letter 5-gram models with absolute discounting, one of toxic and one of
ordinary labelled texts, backing off over continuation counts of orders 4 to 2
to letter counts that both classes share; an expression that neither class has
seen takes the ratio of a shorter one, and in the end none. A text is compared by its length-normalised log-likelihoods: the mean toxic-to-ordinary
log ratio per letter over the whole text and over its windows of ``WINDOW``
letters, of which the highest and the shares above ``WARM`` and ``HOT`` nats
count. A logistic curve, fitted on labelled texts that the models were not
trained on, turns the four numbers into a score.

Folds by crc32(id as text) mod 4: 0 and 1 train the models, 3 fits the curve,
2 is held out. N-gram counts cover all labelled texts and grow with them; the
scoring tables have 2^``TABLE_BITS`` slots by order (n-grams that share a slot
share the count-weighted mean of their ratios), which bounds the broadcast.

Defined cases: null and empty texts have ratio 0 everywhere and get a score
all the same; rows without label, and null labels, train nothing; a document
labelled more than once counts as toxic if one label says so; without labels of
both classes every score is 0. Repeated rows get repeated results; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bloom import filter_bits, may_contain, member_plane
from quarry.llm.common import mix64, prepare, stash, stash_narrow
from quarry.llm.language import fold
from quarry.llm.letters import gram_codes, letter_runs, text_chunks

ORDER = 5
SYMBOL_BITS = 12               # letters by code point modulo 4093: alphabets stay apart
DISCOUNT = 0.75
TABLE_BITS = {5: 22, 4: 20, 3: 18, 2: 16}       # slots of the scoring tables, by order
WINDOW = 16                    # letters
WARM, HOT = 0.35, 0.75         # nats per letter that make a window count
THRESHOLD = 0.3
NEWTON_STEPS = 50
CURVE_ROWS = 200_000           # labelled rows that fit the logistic curve, at most
FLUSH_GRAMS = 1 << 22
MAX_FILTER_BYTES = 64 << 20


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    sym, doc, _ = letter_runs(texts)
    return np.where(sym > 0, sym % np.uint64(4093) + np.uint64(1), np.uint64(0)), doc


def class_counts(labelled: DataFrame, text_col: str) -> DataFrame:
    """(gram, tox, ord): how often every letter 5-gram occurs in either class."""

    def emit(held: list[list]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([c for side in held for c, _ in side] or [np.zeros(0, np.uint64)])
        at, each = pd.factorize(codes)
        sums, lo = [], 0
        for side in held:
            n = np.concatenate([k for _, k in side] or [np.zeros(0)])
            sums.append(np.bincount(at[lo:lo + len(n)], weights=n, minlength=len(each)).astype(np.int64))
            lo += len(n)
        yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                                         names=["gram", "tox", "ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[], []], 0
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for lo, hi in text_chunks(texts):
                codes, of = gram_codes(*symbols(texts[lo:hi]), ORDER, SYMBOL_BITS)
                for side in (0, 1):
                    at, each = pd.factorize(codes[toxic[lo:hi][of] == side])
                    held[side].append((each, np.bincount(at, minlength=len(each))))
                    size += len(each)
                if size > FLUSH_GRAMS:
                    yield from emit(held)
                    held, size = [[], []], 0
        yield from emit(held)

    return (labelled.select(text_col, "toxic").mapInArrow(run, "gram bigint, tox bigint, ord bigint")
            .groupBy("gram").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord")))


def levels(grams: DataFrame) -> dict[int, DataFrame]:
    """Counts of either class by order: raw for 5-grams, below that the number of
    different letters that the class has seen before the gram (continuation counts)."""
    out = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        out[order] = out[order + 1].groupBy(F.col("gram").bitwiseAND((1 << SYMBOL_BITS * order) - 1).alias("gram")).agg(
            *[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("tox", "ord")])
    return out


def ratio_tables(grams: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order, two scoring tables: log ratio of the grams that a class has seen (NaN: neither
    has), and log ratio of the backoff weights by context.

    p(gram) = max(count - D, 0) / context + weight(context) * p(gram without its first letter);
    order 1 is shared by both classes."""
    counts, parts = levels(grams), []
    pooled = counts[1].withColumn("n", F.col("tox") + F.col("ord"))
    share = F.col("n") / pooled.agg(F.sum("n")).scalar()
    lower = stash_narrow(pooled.select("gram", share.alias("tox_p"), share.alias("ord_p")), "toxic-order-1")
    for order in range(2, ORDER + 1):
        level = counts[order].withColumn("context", F.shiftrightunsigned("gram", SYMBOL_BITS))
        contexts = level.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_all") for c in ("tox", "ord")],
            *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in ("tox", "ord")])

        def weight(c: str):
            return F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

        def probability(c: str):
            own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all"))
            return F.coalesce(own, F.lit(0.0)) + weight(c) * F.col(f"{c}_p")

        found = (level.withColumn("suffix", F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (order - 1)) - 1))
                 .join(lower.withColumnRenamed("gram", "suffix"), "suffix").join(contexts, "context")
                 .select("gram", probability("tox").alias("tox_q"), probability("ord").alias("ord_q"),
                         (F.col("tox") + F.col("ord")).alias("n")))
        lower = stash_narrow(found.withColumnsRenamed({"tox_q": "tox_p", "ord_q": "ord_p"}), f"toxic-order-{order}")
        back = contexts.select(F.col("context").alias("gram"), F.log(weight("tox") / weight("ord")).alias("ratio"),
                               (F.col("tox_all") + F.col("ord_all")).alias("n"))
        parts += [lower.select("gram", F.log(F.col("tox_p") / F.col("ord_p")).alias("ratio"), "n")
                  .withColumn("part", F.lit(2 * order)), back.withColumn("part", F.lit(2 * order + 1))]
        lower = lower.drop("n")
    return slots(parts)


def slot_of(codes: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(codes) >> np.uint64(64 - bits)).astype(np.int64)


def slots(parts: list[DataFrame]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """float32 tables by hashed n-gram from (gram, ratio, n, part); part is twice the order,
    and one more for backoff weights. At most 2^TABLE_BITS rows a table reach the driver."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part, n, slot = b["part"].to_numpy(), b["n"].to_numpy(np.float64), np.zeros(len(b), np.int32)
            codes = b["gram"].to_numpy(np.int64).view(np.uint64)
            for order in TABLE_BITS:
                own = part // 2 == order
                slot[own] = slot_of(codes[own], TABLE_BITS[order])
            yield pd.DataFrame({"part": part, "slot": slot, "sum": b["ratio"].to_numpy() * n, "n": n})

    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    found = (all_.mapInPandas(place, "part int, slot int, sum double, n double").groupBy("part", "slot")
             .agg((F.sum("sum") / F.sum("n")).cast("float").alias("ratio")).toArrow())
    part, slot, ratio = (found.column(c).to_numpy() for c in ("part", "slot", "ratio"))
    tables = {}
    for order, bits in TABLE_BITS.items():
        pair = (np.full(1 << bits, np.nan, np.float32), np.zeros(1 << bits, np.float32))
        for i, table in enumerate(pair):
            own = part == 2 * order + i
            table[slot[own]] = ratio[own]
        tables[order] = pair
    return tables


def log_ratios(codes: np.ndarray, tables: dict) -> np.ndarray:
    """Toxic-to-ordinary log ratio of the last letter of every 5-gram, backing off while a gram is new to both."""
    out, left = np.zeros(len(codes)), np.arange(len(codes))
    for order in range(ORDER, 1, -1):
        seen, back = tables[order]
        gram = codes[left] & np.uint64((1 << SYMBOL_BITS * order) - 1)
        ratio = seen[slot_of(gram, TABLE_BITS[order])]
        new = np.isnan(ratio)
        out[left[~new]] += ratio[~new]
        left = left[new]
        out[left] += back[slot_of(gram[new] >> np.uint64(SYMBOL_BITS), TABLE_BITS[order])]
    return out


def features(docs: DataFrame, tables: dict, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mean, peak, warm, hot) of every row: nats per letter overall and in the
    highest window, and the shares of windows above WARM and HOT."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def score(texts: list) -> np.ndarray:
        sym, doc = symbols(texts)
        codes, of = gram_codes(sym, doc, ORDER, SYMBOL_BITS)
        out = np.zeros((len(texts), 4))
        if not len(codes):
            return out
        ratio = log_ratios(codes, shared.value)
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        run = np.concatenate([[0.0], np.cumsum(ratio)])
        length = np.diff(first)
        out[:, 0] = (run[first[1:]] - run[first[:-1]]) / np.maximum(length, 1)
        # Every letter ends one window; at a text's start the window is cut short, its divisor is not.
        end = np.arange(1, len(ratio) + 1)
        begin = np.maximum(end - WINDOW, first[:-1][of])
        windows = (run[end] - run[begin]) / WINDOW
        some = np.flatnonzero(length)
        out[some, 1] = np.maximum.reduceat(windows, first[:-1][some])
        for i, least in ((2, WARM), (3, HOT)):
            out[some, i] = np.add.reduceat((windows > least).astype(np.float64), first[:-1][some]) / length[some]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [score(texts[lo:hi]) for lo, hi in text_chunks(texts)]
            all_ = np.concatenate(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in all_.T)],
                                             names=["doc_id", "mean", "peak", "warm", "hot"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        run, "doc_id bigint, mean double, peak double, warm double, hot double")


def inputs() -> list:
    """Calibrated numbers: mean and peak in nats, the shares on a log scale, and the intercept's one."""
    return [F.col("mean"), F.col("peak"), F.log1p(F.col("warm") * 1000), F.log1p(F.col("hot") * 1000), F.lit(1.0)]


def fit_curve(scored: DataFrame) -> np.ndarray | None:
    """Weights of the logistic curve (intercept last), by damped Newton steps over at most
    CURVE_ROWS labelled rows, those of the smallest id hash."""
    data = (scored.select(*[c.alias(f"x{i}") for i, c in enumerate(inputs())], F.col("toxic").cast("double").alias("y"),
                          F.xxhash64("doc_id").alias("at")).orderBy("at", "y").limit(CURVE_ROWS).drop("at").toPandas())
    x, y = data.drop(columns="y").to_numpy(np.float64), data["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    w, prior = np.zeros(x.shape[1]), np.array([0.1] * (x.shape[1] - 1) + [0.0])  # keeps separable data finite
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + prior @ (w * w) / 2)

    now = loss(w)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-6), x.T @ (y - p) - prior * w)
        scale = 1.0
        while scale > 1e-6 and loss(w + scale * step) > now:
            scale /= 2
        w, last = w + scale * step, now
        now = loss(w)
        if last - now < 1e-6 * max(1.0, abs(now)):
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, mean, peak, warm, hot) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    marks = stash_narrow(labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 2))
                  .groupBy(F.col(id_col).cast("bigint").alias("label_id")).agg((F.max(label_col) > 0).alias("toxic")), "toxic-labels")
    count = marks.count()
    bits = filter_bits(count, MAX_FILTER_BYTES)
    known = member_plane(marks, "label_id", bits)
    own = F.col(id_col).cast("bigint")
    train = (docs.select(own.alias("label_id"), F.col(text_col).alias("text"))
             .filter(F.col("label_id").isNotNull() & fold(F.col("label_id")).isin(0, 1))
             .filter(may_contain(docs, "label_id", known, bits)).join(marks, "label_id"))
    grams = stash_narrow(class_counts(train, "text"), "toxic-grams")
    tables = ratio_tables(grams)
    found = stash(features(docs, tables, id_col, text_col), "toxic-features")
    curve = fit_curve(found.filter(fold(F.col("doc_id")) == 3).join(marks, F.col("doc_id") == F.col("label_id")))
    if curve is None:
        score = F.lit(0.0)
    else:
        z = sum((c * float(w) for c, w in zip(inputs(), curve)), F.lit(0.0))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), score.alias("score"),
                        (score >= threshold).cast("int").alias("predicted"), "mean", "peak", "warm", "hot")
