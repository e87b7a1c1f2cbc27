"""Secret scan by character Markov models (operator 10, DataFrame functions only).

Base rules find assignments, access keys and hex runs. On top, two character
bigram models, one of random strings and one of ordinary identifiers, score
every other long token; a token whose log-likelihood ratio per character is at
least ``MIN_RATIO`` is a ``markov`` span. The models learn from labelled
samples that the corpus gives: secrets that the base rules found are the random
class; words of ``IDENTIFIER`` outside them are the ordinary one, but for those of
runs with digits between letters or of quickly changing case (``MIXED``), as random
strings have. A secret counts once however often it occurs, a word once for every
different word before it, so copies of rows teach nothing. Counts cover all rows.

Offsets are code points: the gaps between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so running lengths give every start.

Defined cases: null and empty texts have no spans (the digest of the empty
string); without base matches the random model is uniform; repeated rows give
repeated results; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import prepare

# The base rules, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"          # runs are maximal, so short ones can be left out at once
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

TOKEN = "[A-Za-z0-9+/_=-]{16,}"           # scored where it has a letter and a digit
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{7,}"
RUN = "[A-Za-z0-9+/_=-]{8,}"              # what words are taken from
MIXED = "[A-Za-z][0-9]+[A-Za-z]|[a-z][A-Z][a-z]?[A-Z]|[A-Z][a-z][A-Z]"
ALPHABET = 128                            # ASCII
SYMBOLS = 66                              # letters, digits, + / _ =
MIN_RATIO = 0.5                           # nats per character
SMOOTHING = 0.5                           # added to every character's count
BACKOFF = 4.0                             # weight of a character's own frequency against its pairs

SPAN = "struct<start:int,kind:int,end:int,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def matches(pattern: str, kind: int, value_group: int, least: int) -> Column:
    """Spans of ``pattern`` whose value has at least ``least`` characters, as array<SPAN>."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"""
        aggregate(
            arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {value_group})),
            struct(0 as pos, {NONE} as spans),
            (a, m) -> struct(
                a.pos + length(m['0']) + coalesce(length(m['1']), 0) as pos,
                if(length(m['2']) >= {least},
                   array_append(a.spans, struct(a.pos + length(m['0']) as start, {kind} as kind,
                                                a.pos + length(m['0']) + length(m['1']) as end, m['2'] as value)),
                   a.spans) as spans),
            a -> a.spans)"""
    return F.expr(f"if(text rlike {p}, {found}, {NONE})")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, assign, access, hex): whole texts with the spans of the base rules."""
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("assign", matches(ASSIGN, 0, 2, MIN_ASSIGN))
            .withColumn("access", matches(ACCESS, 1, 0, MIN_ACCESS))
            .withColumn("hex", matches(HEX, 2, 0, MIN_HEX)))


def bigrams(strings: DataFrame) -> DataFrame:
    """(pair, n) of (word, n): neighbouring ASCII codes, the first after a start code 0."""
    pairs = F.expr("transform(sequence(1, length(word)), i -> "
                   f"if(i = 1, 0, ascii(substring(word, i - 1, 1))) * {ALPHABET} + ascii(substring(word, i, 1)))")
    return (strings.filter(F.length("word") > 0).select(F.explode(pairs).alias("pair"), "n")
            .groupBy("pair").agg(F.sum("n").alias("n")))


def ratios(docs: DataFrame, id_col: str, text_col: str) -> list[float]:
    """Random-to-ordinary log ratio of every pair (ALPHABET x ALPHABET numbers)."""
    spans = base_spans(docs, id_col, text_col).withColumn("some", F.expr("size(assign) + size(access) + size(hex) > 0"))
    secrets = (spans.filter("some").select(F.explode(F.concat("assign", "access", "hex")).alias("s"))
               .select(F.col("s.value").alias("word")).distinct().withColumn("n", F.lit(1)))
    plain = F.col("text")
    for rule in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, rule, " ")
    runs = F.regexp_extract_all(F.when(F.col("some"), plain).otherwise(F.col("text")), F.lit(RUN), F.lit(0))
    named = F.array_join(F.filter(runs, lambda r: ~r.rlike(MIXED)), " ")
    words = (spans.select(F.regexp_extract_all(named, F.lit(IDENTIFIER), F.lit(0)).alias("w"))
             .select(F.explode(F.expr("transform(w, (x, i) -> struct(x as word, xxhash64(get(w, i - 1)) as before))")).alias("s"))
             .select("s.word", "s.before").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # At most ALPHABET^2 pairs a class reach the driver.
    counts = [{r["pair"]: r["n"] for r in bigrams(side).collect()} for side in (secrets, words)]
    if not counts[1]:
        return [0.0] * (ALPHABET * ALPHABET)
    before = [[0] * ALPHABET for _ in counts]
    after = [[0] * ALPHABET for _ in counts]
    for own, first, second in zip(counts, before, after):
        for pair, n in own.items():
            first[pair // ALPHABET] += n
            second[pair % ALPHABET] += n

    totals = [sum(x) for x in after]

    def log_p(side: int, pair: int) -> float:
        a, b = divmod(pair, ALPHABET)
        alone = (after[side][b] + SMOOTHING) / (totals[side] + SMOOTHING * SYMBOLS)
        return math.log((counts[side].get(pair, 0) + BACKOFF * alone) / (before[side][a] + BACKOFF))

    return [round(log_p(0, pair) - log_p(1, pair), 6) for pair in range(ALPHABET * ALPHABET)]


def markov_spans(table: list[float]) -> Column:
    """Tokens with a letter and a digit that score as random and meet no base span."""
    ratio = F.from_json(F.lit(json.dumps(table)), "array<double>")

    def score(value: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            before = F.when(i == 1, 0).otherwise(F.ascii(F.substring(value, i - 1, F.lit(1))))
            return total + F.get(ratio, before * ALPHABET + F.ascii(F.substring(value, i, F.lit(1))))
        return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0.0), step) / F.length(value)

    def random(s: Column) -> Column:
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & apart & (score(s["value"]) >= MIN_RATIO)

    return F.filter(matches(TOKEN, 3, 0, 0), random)


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row."""
    prepare(docs.sparkSession)
    table = ratios(docs, id_col, text_col)
    found = (base_spans(docs, id_col, text_col).withColumn("base", F.concat("assign", "access", "hex"))
             .withColumn("markov", markov_spans(table)))
    count = {k: F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS}
    return found.select("doc_id", *count.values(), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "markov")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "*") -> DataFrame:
    """``docs`` with every character of a found span replaced by ``mask``, other columns as they were."""
    table = ratios(docs, id_col, text_col)
    spans = (docs.withColumn("_row", F.struct(*docs.columns))
             .select("_row", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .withColumn("assign", matches(ASSIGN, 0, 2, MIN_ASSIGN)).withColumn("access", matches(ACCESS, 1, 0, MIN_ACCESS))
             .withColumn("hex", matches(HEX, 2, 0, MIN_HEX)).withColumn("base", F.concat("assign", "access", "hex"))
             .withColumn("all", F.array_sort(F.concat("base", markov_spans(table)))))
    # Overlapping spans are masked once: each covers from where the former ended.
    pieces = F.expr("""aggregate(all, struct(0 as pos, '' as out),
        (a, s) -> if(s.end <= a.pos, a, struct(s.end as pos,
            concat(a.out, substring(text, a.pos + 1, greatest(s.start - a.pos, 0)),
                   repeat('%s', s.end - greatest(s.start, a.pos))) as out)),
        a -> concat(a.out, substring(text, a.pos + 1)))""" % mask.replace("'", "\\'"))
    clean = F.when(F.size("all") > 0, pieces).otherwise(F.col(f"_row.`{text_col}`"))
    return spans.select(*[(clean if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
