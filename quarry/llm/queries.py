"""Queries ``opN_<name>`` of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    bin_completion, decontaminate, exact_dedup, fp_search, language, near_dedup, orchard, packing, secrets, site_tree,
    substring_dedup, toxicity, warc,
)

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.span_report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bin_completion.pack_few(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, QueryFn] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_site_tree": op4_site_tree,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_secrets": op10_secrets,
    "op11_bin_completion": op11_bin_completion,
    "op12_fp_search": op12_fp_search,
    "op13_orchard": op13_orchard,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SQL = f"""
        WITH q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
        i AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY ALL),
        t AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS terms FROM documents),
        c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM t WHERE len(terms) > 0),
        p AS (SELECT row, doc_id, n, term, count(*) AS tf
              FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
              FROM p JOIN c ON true WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
        s AS (SELECT item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf)
                         // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))))::BIGINT AS score
              FROM i JOIN w USING (term) JOIN p USING (term) JOIN c ON true GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20"""


def codes_sql() -> str:
    """Product quantisation by comparing every part with all 64 entries."""
    away = "list_sum(list_transform(list_zip(p.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = ["""v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """p AS (SELECT row, pos, vec[pos * w + 1:(pos + 1) * w] AS part
              FROM (SELECT row, vec, len(vec) // 16 AS w, unnest(range(16)) AS pos FROM v))""",
             "b0 AS (SELECT pos, row - 1 AS i, part AS entry FROM p WHERE row <= 64)"]
    for n in range(3):
        steps.append(f"""a{n} AS (SELECT row, pos, min({{'d': {away}, 'i': b.i}}) AS near
              FROM p JOIN b{n} b USING (pos) GROUP BY row, pos)""")
        if n < 2:
            steps.append(f"""m{n} AS (SELECT pos, i, list(mean ORDER BY k) AS entry FROM (
                  SELECT pos, i, k, floor(sum(x) / count(*))::BIGINT AS mean
                  FROM (SELECT pos, a.near.i AS i, unnest(part) AS x, unnest(range(len(part))) AS k
                        FROM p JOIN a{n} a USING (row, pos)) GROUP BY pos, i, k) GROUP BY pos, i)""")
            steps.append(f"""b{n + 1} AS (SELECT pos, i, coalesce(m.entry, b.entry) AS entry
              FROM b{n} b LEFT JOIN m{n} m USING (pos, i))""")
    steps.append("""c AS (SELECT row, string_agg(lower(printf('%02x', near.i)), '' ORDER BY pos) AS code,
                     sum(near.d)::BIGINT AS error FROM a2 GROUP BY row)""")
    steps.append("""h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY pos, i)) AS codebooks_sha256
              FROM b2)""")
    return f"""
        WITH {', '.join(steps)}
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM v JOIN c USING (row) JOIN h ON true"""


ORACLE: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top
              FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 8), lambda i: translate(
                   to_base(('0x' || substr(h, 5 * i + 1, 5))::BIGINT, 32, 4),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM d""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_fp_search": RANKED_SQL,
    "op13_orchard": codes_sql(),
}
