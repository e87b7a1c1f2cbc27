"""Search keys: BM25 top-k over documents, the chunk table and comments, attribute
filters, JSON result rows and fusion — on the term-partitioned index of
``term_index`` — and vector top-k, by comparing all or on ``vector_index``.

An index is built once per session, table folder and text column, and every key that
searches the same text reads the same tables; a refreshed one is in
``streaming.refresh``.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import docs as D
from quarry.operators import policy as P
from quarry.operators import term_index as TI
from quarry.operators import vector_index as VI
from quarry.operators.term_index import BM25_B, BM25_K1, RRF_K
from quarry.plans.registry import TOP_K, register
from quarry.sources import tables as T

# Second ranked field of a document: its heading line.
TITLE_SQL = "split_part(text, chr(10), 1)"
# Largest number of query vectors inlined per scoring pass.
MAX_INLINE_QUERY_VECTORS = 4096

# The attributes of the reference's two search services, and the
# stand-in for a comment's date (the data has none): days by id from a first day.
CHUNK_ATTRIBUTES = ("source_file", "file_type", "product_category", "chunk_index", "stage_name")
COMMENT_ATTRIBUTES = ("comment_id", "comment_date", "article_id", "article_name")
COMMENT_DAY, COMMENT_DAYS = "2000-01-01", 700


def heading(text: str = "text") -> Column:
    return F.split_part(F.col(text), F.lit("\n"), F.lit(1))


def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def searched_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched_documents(spark, sf_dir).withColumn("text", heading())


def searched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table; a chunk's id is its file and place."""
    return D.chunk_table(spark, sf_dir).select(
        F.concat("source_file", F.lit("#"), F.col("chunk_index").cast("string")).alias("doc_id"),
        F.col("chunk_text").alias("text"), *CHUNK_ATTRIBUTES)


def searched_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(COMMENT_DAY).cast("date"), (F.col("comment_id") % COMMENT_DAYS).cast("int"))
    return (T.comments(spark, sf_dir, ("comment_id", "article_id", "comment_text"))
            .select(F.col("comment_id").alias("doc_id"), F.col("comment_text").alias("text"), "comment_id",
                    day.alias("comment_date"), "article_id"))


def comments_articles(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Attributes of the article; a comment without one is not searched."""
    articles = T.dim_article(spark, sf_dir).select("article_id", "article_name", P.role_set().alias("role_set"))
    return rows.join(articles, "article_id")


# Text, attributes, and the join that looks up those of other tables.
SEARCHED = {
    "documents": (searched_documents, ("lang", "source"), None),
    "headings": (searched_headings, ("lang", "source"), None),
    "chunks": (searched_chunks, CHUNK_ATTRIBUTES, None),
    "comments": (searched_comments, (*COMMENT_ATTRIBUTES, "role_set"), comments_articles),
}
_BUILT: dict[tuple[str, str, str], TI.TermIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, name: str) -> TI.TermIndex:
    """The session's index of a searched text; built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _BUILT:
        source, attributes, met = SEARCHED[name]
        look_up = met and functools.partial(met, spark, sf_dir)
        _BUILT[key] = TI.build(source(spark, sf_dir), "doc_id", "text", attributes, look_up=look_up)
    return _BUILT[key]


def _benchmark(spark: SparkSession, sf_dir: str) -> TI.Batch:
    """Every ``benchmark`` passage as a query."""
    return TI.batch(T.read(spark, sf_dir, "benchmark"), "item_id", "text")


def sql_bm25(text_expr: str, k: int, doc_filter: str | None = None, extra_cols: str = "",
             docs: str = "documents", out: str = "") -> str:
    """DuckDB form of a search over ``docs`` (doc_id, text, attributes) × ``benchmark``;
    ``out`` names attributes to return."""
    flt = f"WHERE {doc_filter}" if doc_filter else ""
    own = f"JOIN docs o ON o.doc_id = r.doc_id" if out else ""
    cols = "".join(f", o.{c}" for c in out.split(", ")) if out else ""
    return (
        f"WITH docs AS (SELECT * FROM {docs}), "
        f"d AS (SELECT doc_id, {X.sql_tokens(text_expr)} AS tok{extra_cols} FROM docs), "
        "dl AS (SELECT doc_id, len(tok) AS dl FROM d), "
        "st AS (SELECT COUNT(*) AS n_docs, AVG(dl) AS avgdl FROM dl), "
        "post AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM d) GROUP BY 1, 2), "
        f"q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({X.sql_tokens('text')}) AS term FROM benchmark)), "
        "df AS (SELECT term, COUNT(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term), "
        "w AS (SELECT q.query_id, q.term, ln(1.0 + (st.n_docs - df.df + 0.5) / (df.df + 0.5)) AS idf FROM q JOIN df ON q.term = df.term, st), "
        f"cand AS (SELECT * FROM d {flt}), "
        f"s AS (SELECT w.query_id, p.doc_id, SUM(w.idf * CAST(p.tf AS DOUBLE) * {BM25_K1 + 1.0} / "
        f"(CAST(p.tf AS DOUBLE) + {BM25_K1} * ({1.0 - BM25_B} + {BM25_B} * dl.dl / st.avgdl))) AS raw "
        "FROM post p JOIN w ON p.term = w.term JOIN dl ON dl.doc_id = p.doc_id, st "
        "WHERE p.doc_id IN (SELECT doc_id FROM cand) GROUP BY 1, 2), "
        "r AS (SELECT query_id, doc_id, ROUND(raw, 6) AS score, "
        "ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(raw, 6) DESC, doc_id) AS rank FROM s) "
        f"SELECT query_id, CAST(rank AS INTEGER) AS rank, r.doc_id, score{cols} FROM r {own} WHERE rank <= {k}")


# --- keys -------------------------------------------------------------------

@register("search_index_stats",
          f"WITH d AS (SELECT doc_id, {X.sql_tokens('text')} AS tok FROM documents), "
          "post AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM d) GROUP BY 1, 2) "
          "SELECT term, CAST(COUNT(*) AS BIGINT) AS df, CAST(SUM(tf) AS BIGINT) AS total_tf FROM post GROUP BY term")
def search_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, "documents").lexicon()


@register("search_topk", sql_bm25("text", TOP_K))
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TI.search(index_of(spark, sf_dir, "documents"), _benchmark(spark, sf_dir), TOP_K)


FILTER_LANG = "en"


@register("search_filtered", sql_bm25("text", TOP_K, doc_filter=f"lang = '{FILTER_LANG}'", extra_cols=", lang"))
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TI.search(index_of(spark, sf_dir, "documents"), _benchmark(spark, sf_dir), TOP_K, F.col("lang") == FILTER_LANG)


@register("search_results_json",
          f"WITH h AS ({sql_bm25('text', TOP_K)}) SELECT h.query_id, "
          "to_json(list({'rank': h.rank, 'doc_id': h.doc_id, 'source': d.source, 'lang': d.lang, 'score': h.score} "
          "ORDER BY h.rank))::VARCHAR AS results FROM h JOIN documents d ON h.doc_id = d.doc_id GROUP BY h.query_id")
def search_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, "documents")
    hits = TI.search(index, _benchmark(spark, sf_dir), TOP_K)
    return TI.results_json(TI.with_attributes(index, hits, ("source", "lang")), ("source", "lang"))


CHUNKS_FILE_TYPE = "TEXT"


@register("search_chunks", sql_bm25(
    "text", TOP_K, doc_filter=f"file_type = '{CHUNKS_FILE_TYPE}' AND chunk_index > 0", extra_cols=", file_type, chunk_index",
    docs=f"(SELECT source_file || '#' || chunk_index AS doc_id, chunk_text AS text, * FROM ({D.sql_chunk_table()}))",
    out=", ".join(CHUNK_ATTRIBUTES)))
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk search with the reference's five attributes, two of them as filters."""
    index = index_of(spark, sf_dir, "chunks")
    hits = TI.search(index, _benchmark(spark, sf_dir), TOP_K,
                     (F.col("file_type") == CHUNKS_FILE_TYPE) & (F.col("chunk_index") > 0))
    return TI.with_attributes(index, hits, CHUNK_ATTRIBUTES)


@register("search_comments", T.with_views(sql_bm25(
    "text", TOP_K, docs="(SELECT c.comment_id AS doc_id, c.comment_text AS text, c.comment_id, "
    f"CAST(DATE '{COMMENT_DAY}' + CAST(c.comment_id % {COMMENT_DAYS} AS INTEGER) AS DATE) AS comment_date, c.article_id, a.article_name "
    "FROM comments c JOIN dim_article a ON c.article_id = a.article_id)", out=", ".join(COMMENT_ATTRIBUTES)),
    "comments", "dim_article"))
def search_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback search with the reference's four attributes."""
    index = index_of(spark, sf_dir, "comments")
    hits = TI.search(index, _benchmark(spark, sf_dir), TOP_K)
    return TI.with_attributes(index, hits, COMMENT_ATTRIBUTES)


@register("search_comments_by_role", T.with_views(sql_bm25(
    "text", TOP_K, doc_filter=f"article_category IN ({', '.join(repr(c) for c in P.ROLE_GRANTS[P.ROLE_B])})",
    extra_cols=", article_category", docs="(SELECT c.comment_id AS doc_id, c.comment_text AS text, a.article_name, a.article_category "
    "FROM comments c JOIN dim_article a ON c.article_id = a.article_id)", out="article_name"), "comments", "dim_article"))
def search_comments_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback search as a granted role sees it: the role's bit in the postings' role set."""
    index = index_of(spark, sf_dir, "comments")
    hits = TI.search(index, _benchmark(spark, sf_dir), TOP_K, F.col("role_set").bitwiseAND(P.role_bit(P.ROLE_B)) != 0)
    return TI.with_attributes(index, hits, ("article_name",))


def _ranked_sql(name: str, text_expr: str) -> str:
    return f"{name} AS (SELECT * FROM ({sql_bm25(text_expr, 2**31 - 1)}))"


@register("search_fused",
          f"WITH {_ranked_sql('a', 'text')}, {_ranked_sql('b', TITLE_SQL)}, "
          f"u AS (SELECT query_id, doc_id, 1.0 / ({RRF_K} + rank) AS c FROM a UNION ALL "
          f"SELECT query_id, doc_id, 1.0 / ({RRF_K} + rank) FROM b), "
          "f AS (SELECT query_id, doc_id, ROUND(SUM(c), 6) AS rrf FROM u GROUP BY 1, 2), "
          "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM f) "
          f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, rrf FROM r WHERE rank <= {TOP_K}")
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two fields of a document: its whole text, and its heading (first line)."""
    indexes = [index_of(spark, sf_dir, name) for name in ("documents", "headings")]
    return TI.fused(indexes, _benchmark(spark, sf_dir), TOP_K)


# --- vectors ----------------------------------------------------------------

def _as_double(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def label_centroids(emb: DataFrame) -> DataFrame:
    """Query vectors: the mean vector of each label, ``(query_id, vec)``."""
    per_dim = (emb.select("label", F.posexplode(_as_double(F.col("embedding"))).alias("pos", "v"))
               .groupBy("label", "pos").agg(F.avg("v").alias("v")))
    return (per_dim.groupBy("label")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pv"))
            .select(F.col("label").alias("query_id"), F.transform("pv", lambda x: x["v"]).alias("vec")))


def _local_topk(query_ids, qmat, k: int):
    """mapInPandas body: score an Arrow batch of vectors against every query
    with one matrix product and keep each query's k best rows of the batch
    (order: rounded score desc, vec_id asc — the global order, so the union
    of local top-k lists contains the global top-k)."""
    import numpy as np
    import pandas as pd

    qids = np.asarray(query_ids)
    qnorm = np.sqrt((qmat * qmat).sum(axis=1))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            ids = pdf["vec_id"].to_numpy()
            dots = v @ qmat.T
            vnorm = np.sqrt((v * v).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.round(dots / (vnorm[:, None] * qnorm[None, :]), 6)
            out = []
            for j in range(len(qids)):
                col = scores[:, j]
                order = np.lexsort((ids, -col))[:k]
                out.append(pd.DataFrame({"query_id": qids[j], "vec_id": ids[order], "score": col[order]}))
            yield pd.concat(out, ignore_index=True)
    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Exact cosine top-k of ``vectors (vec_id, embedding)`` for each query
    ``(query_id, vec)``.

    The query set is the broadcast side: at most ``MAX_INLINE_QUERY_VECTORS``
    vectors per pass (checked; a larger set runs in several passes split by
    query-id hash), the way Spark ML ships cluster centres to tasks. Vectors
    are never paired with queries in a table: each task emits at most k rows
    per query, and ``row_number() <= k`` merges them.
    """
    import numpy as np

    spark = vectors.sparkSession
    n_q = queries.count()
    passes = max(1, math.ceil(n_q / MAX_INLINE_QUERY_VECTORS))
    out = None
    for i in range(passes):
        qs = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        rows = qs.select("query_id", "vec").collect()
        if not rows:
            continue
        qmat = spark.sparkContext.broadcast(np.array([r["vec"] for r in rows], dtype=np.float64))
        qids = [r["query_id"] for r in rows]
        qtype = queries.schema["query_id"].dataType.simpleString()

        def run(batches, qids=qids, qmat=qmat):
            return _local_topk(qids, qmat.value, k)(batches)

        local = vectors.select("vec_id", "embedding").mapInPandas(
            run, f"query_id {qtype}, vec_id bigint, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        part = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")


_SQL_CENTROIDS = (
    "c AS (SELECT label AS query_id, list(v ORDER BY pos) AS vec FROM ("
    "SELECT label, pos, AVG(v) AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, "
    "unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)")


def sql_vector_topk() -> str:
    return (f"WITH {_SQL_CENTROIDS}, s AS (SELECT c.query_id, e.vec_id, ROUND("
            "list_dot_product(CAST(e.embedding AS DOUBLE[]), c.vec) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), "
            "CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.vec, c.vec))), 6) AS score FROM embeddings e, c), "
            "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) "
            f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP_K}")


@register("vector_topk", sql_vector_topk())
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = T.read(spark, sf_dir, "embeddings")
    return vector_search(emb.select("vec_id", "embedding"), label_centroids(emb))


@register("vector_topk_lists", sql_vector_topk())
def vector_topk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same top-k from the inverted-list index: exact, by bounds, not by comparing all."""
    emb = T.read(spark, sf_dir, "embeddings")
    return VI.search(VI.build(emb), label_centroids(emb), TOP_K)[0]


@register("vector_lists_recall",
          f"WITH {_SQL_CENTROIDS} SELECT query_id, CAST({TOP_K} AS BIGINT) AS found, CAST({TOP_K} AS BIGINT) AS asked, "
          "true AS recall_reached FROM c")
def vector_lists_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: hits of the index among the exact top-k, and whether recall is 0.95 or more."""
    emb = T.read(spark, sf_dir, "embeddings")
    queries = label_centroids(emb)
    exact = vector_search(emb.select("vec_id", "embedding"), queries).select("query_id", "vec_id")
    hits = VI.search(VI.build(emb), queries, TOP_K)[0].select("query_id", "vec_id", F.lit(1).alias("hit"))
    return (exact.join(hits, ["query_id", "vec_id"], "left").groupBy("query_id")
            .agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("asked"))
            .withColumn("recall_reached", F.col("found") >= F.lit(0.95) * F.col("asked")))


def search_preview(index: TI.TermIndex, spark: SparkSession, request: str) -> DataFrame:
    """The reference's preview call: a JSON request ``{"query": ..., "columns":
    [...], "limit": k, "filter": {"col": value}}`` (parsed on the driver; it is
    a request, not data) → one row with the ``results`` JSON array. ``columns``
    and ``filter`` name attributes of the index."""
    import json as _json

    req = _json.loads(request)
    asked = TI.batch(spark.createDataFrame([(0, req["query"])], "item_id long, text string"), "item_id", "text")
    flt = None
    for col, val in (req.get("filter") or {}).items():
        cond = F.col(col) == F.lit(val)
        flt = cond if flt is None else flt & cond
    hits = TI.search(index, asked, int(req.get("limit", TOP_K)), flt)
    cols = tuple(req.get("columns") or ())
    return TI.results_json(TI.with_attributes(index, hits, cols) if cols else hits, cols).select("results")
