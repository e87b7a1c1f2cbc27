"""Document pipeline: inventory → parse → classify once per file → chunk →
one chunk table, plus the checks the reference runs on that table.

Sources are bound as two "stages" in one DataFrame (``stage_name`` is a
column, not a copy of the code per stage):

* ``documents`` — plain text files (``file_type = 'TEXT'``), stage = source;
* ``pages`` — raw HTML parsed to markdown (``file_type = 'PAGE'``), stage =
  URL host.

Parsing, classification input, keyword classes and all chunkers are JVM
expressions; classification happens before the chunk explode, so it runs once
per file. The learned classifier is ``pyspark.ml``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions import text as X
from quarry.plans.registry import register
from quarry.sources import tables as T

CHUNK_COLUMNS = ["source_file", "file_type", "product_category", "stage_name", "chunk_text", "chunk_index"]


# --- parse (T1) --------------------------------------------------------------

def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.read(spark, sf_dir, "pages")
    return pages.select("page_id", "url", X.html_title("html").alias("title"),
                        X.html_to_markdown("html").alias("markdown"))


register("parse_pages",
         f"SELECT page_id, {X.sql_html_title('html')} AS title, {X.sql_html_to_markdown('html')} AS markdown "
         "FROM pages")(lambda spark, sf_dir: parse_pages(spark, sf_dir).select("page_id", "title", "markdown"))


# --- files of both stages, classified once ------------------------------------

def staged_files(spark: SparkSession, sf_dir: str, with_text_only: bool = False) -> DataFrame:
    """(source_file, file_type, stage_name, doc_text) for documents and pages.

    ``with_text_only`` drops files without text on the raw columns, before
    parsing: the parsed text is NULL exactly when the raw text is, and a
    predicate on the parsed column would be pushed below the projection and
    run the whole parse twice.
    """
    raw_docs = T.read(spark, sf_dir, "documents")
    raw_pages = T.read(spark, sf_dir, "pages")
    if with_text_only:
        raw_docs = raw_docs.filter(F.col("text").isNotNull())
        raw_pages = raw_pages.filter(F.col("html").isNotNull())
    docs = raw_docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"),
        F.lit("TEXT").alias("file_type"),
        F.col("source").alias("stage_name"),
        F.col("text").alias("doc_text"))
    pages = raw_pages.select("page_id", "url", X.html_to_markdown("html").alias("markdown")).select(
        F.col("url").alias("source_file"),
        F.lit("PAGE").alias("file_type"),
        F.try_parse_url(F.col("url"), F.lit("HOST")).alias("stage_name"),
        F.col("markdown").alias("doc_text"))
    return docs.unionByName(pages)


# Keyword classes bound to the test data (the reference's own keywords do not
# occur in it): words of some documents, and a host prefix of some page names.
KEYWORDS = ("loser", "clown", "trash", "blog.")


def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with ``product_category`` from the keyword scorer on name + first
    500 characters; files without text are dropped (as the reference does)."""
    files = staged_files(spark, sf_dir, with_text_only=True)
    return files.withColumn(
        "product_category", X.keyword_class(X.classify_input("source_file", "doc_text"), KEYWORDS))


def chunk_table(spark: SparkSession, sf_dir: str, chunker: str = "recursive") -> DataFrame:
    """The chunk table (without ids): one row per non-empty chunk."""
    files = classified_files(spark, sf_dir)
    if chunker == "fixed":
        arr = X.fixed_chunks("doc_text")
    elif chunker == "lines":
        arr = X.line_chunks("doc_text")
    elif chunker == "recursive":
        arr = X.recursive_chunks("doc_text")
    else:
        raise ValueError(chunker)
    return (files.select("source_file", "file_type", "product_category", "stage_name",
                         F.posexplode(arr).alias("chunk_index", "chunk_text"))
            .filter(F.col("chunk_text").isNotNull() & (F.length("chunk_text") > 0))
            .select(*[F.col(c) if c != "chunk_index" else F.col(c).cast("bigint") for c in CHUNK_COLUMNS]))


def write_chunk_table(spark: SparkSession, sf_dir: str, path: str, chunker: str = "recursive") -> DataFrame:
    """Materialise the chunk table with dense ``chunk_id`` 1..N (append-safe
    full replace: written to ``path`` with overwrite)."""
    from quarry.operators.quality import with_dense_id
    df = with_dense_id(chunk_table(spark, sf_dir, chunker), "chunk_id")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# SQL form of the same table (both stages, recursive chunker).
def _sql_files() -> str:
    page_md = X.sql_html_to_markdown("html")
    return (
        "SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS source_file, 'TEXT' AS file_type, source AS stage_name, "
        "text AS doc_text FROM documents UNION ALL "
        f"SELECT url, 'PAGE', regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), {page_md} FROM pages")


def sql_chunk_table() -> str:
    cls = X.sql_keyword_class("(source_file || '. ' || left(doc_text, 500))", KEYWORDS)
    return (
        f"WITH files AS ({_sql_files()}), "
        f"cf AS (SELECT *, {cls} AS product_category, {X.sql_recursive_chunks('doc_text')} AS chunks "
        "FROM files WHERE doc_text IS NOT NULL) "
        "SELECT source_file, file_type, product_category, stage_name, chunks[i] AS chunk_text, "
        "CAST(i - 1 AS BIGINT) AS chunk_index FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM cf)")


register("docs_chunks", sql_chunk_table())(chunk_table)


# --- chunkers on documents (T2) ---------------------------------------------

def document_chunks(spark: SparkSession, sf_dir: str, chunker: str) -> DataFrame:
    d = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    if chunker == "fixed":
        arr = X.fixed_chunks("text")
    elif chunker == "lines":
        arr = X.line_chunks("text")
    else:
        arr = X.recursive_chunks("text")
    return (d.select("doc_id", F.posexplode(arr).alias("chunk_index", "chunk_text"))
            .filter(F.length("chunk_text") > 0)
            .select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_text"))


register("chunk_fixed",
         f"SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, "
         f"substring(text, k * {X.CHUNK_SIZE - X.CHUNK_OVERLAP} + 1, {X.CHUNK_SIZE}) AS chunk_text "
         f"FROM (SELECT *, unnest(range(0, {X.sql_fixed_chunk_count('text')} + 1)) AS k FROM documents) "
         f"WHERE length(substring(text, k * {X.CHUNK_SIZE - X.CHUNK_OVERLAP} + 1, {X.CHUNK_SIZE})) > 0"
         )(lambda spark, sf_dir: document_chunks(spark, sf_dir, "fixed"))

def _sql_line_chunks() -> str:
    """Line packing in DuckDB: the fold state is one string, finished chunks
    separated by chr(1) and the open chunk last."""
    n = X.CHUNK_SIZE
    return (
        "WITH p AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: "
        f"list_transform(range(0, greatest(CAST(ceil(length(l) / {n}.0) AS BIGINT), 1)), "
        f"lambda k: substring(l, k * {n} + 1, {n})))) AS pieces FROM documents), "
        "f AS (SELECT doc_id, string_split(list_reduce(pieces, lambda acc, x: CASE WHEN "
        f"length(string_split(acc, chr(1))[-1]) + 1 + length(x) <= {n} THEN acc || chr(10) || x "
        "ELSE acc || chr(1) || x END), chr(1)) AS chunks FROM p) "
        "SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, chunks[i] AS chunk_text "
        "FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM f) WHERE length(chunks[i]) > 0")


register("chunk_lines", _sql_line_chunks())(lambda spark, sf_dir: document_chunks(spark, sf_dir, "lines"))


@register("chunk_recursive",
          f"WITH f AS ({_sql_files()}), c AS (SELECT source_file, {X.sql_recursive_chunks('doc_text')} AS chunks "
          "FROM f WHERE doc_text IS NOT NULL) "
          "SELECT source_file, CAST(i - 1 AS BIGINT) AS chunk_index, chunks[i] AS chunk_text "
          "FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM c)")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive markdown splitting of documents and parsed pages."""
    d = T.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), F.col("text"))
    p = parse_pages(spark, sf_dir).select(F.col("url").alias("source_file"), F.col("markdown").alias("text"))
    both = d.unionByName(p)
    return (both.select("source_file", F.posexplode(X.recursive_chunks("text")).alias("chunk_index", "chunk_text"))
            .select("source_file", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_text"))


# --- dense ids (K5) -----------------------------------------------------------

@register("dense_ids",
          "WITH c AS (SELECT doc_id FROM (SELECT *, unnest(range(0, "
          f"{X.sql_fixed_chunk_count('text')} + 1)) AS k FROM documents) WHERE length(substring(text, k * "
          f"{X.CHUNK_SIZE - X.CHUNK_OVERLAP} + 1, {X.CHUNK_SIZE})) > 0) "
          "SELECT CAST(COUNT(*) AS BIGINT) AS chunk_count, CAST(1 AS BIGINT) AS min_id, "
          "CAST(COUNT(*) AS BIGINT) AS max_id, CAST(COUNT(*) AS BIGINT) AS distinct_ids FROM c")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.quality import with_dense_id
    ids = with_dense_id(document_chunks(spark, sf_dir, "fixed"), "chunk_id")
    return ids.agg(F.count(F.lit(1)).alias("chunk_count"), F.min("chunk_id").alias("min_id"),
                   F.max("chunk_id").alias("max_id"), F.count_distinct("chunk_id").alias("distinct_ids"))


# --- classification (T3, T5, T6) ---------------------------------------------

_SQL_CLASSIFY_INPUT = "(source || '. ' || left(text, 500))"

register("classify_input",
         "SELECT doc_id, source || '. ' || left(text, 500) AS classify_input FROM documents")(
    lambda spark, sf_dir: T.read(spark, sf_dir, "documents").select(
        "doc_id", X.classify_input("source", "text").alias("classify_input")))

register("classify_rules",
         f"SELECT doc_id, {X.sql_keyword_class(_SQL_CLASSIFY_INPUT, KEYWORDS)} "
         "AS expected_category FROM documents")(
    lambda spark, sf_dir: T.read(spark, sf_dir, "documents").select(
        "doc_id", X.keyword_class(X.classify_input("source", "text"), KEYWORDS).alias("expected_category")))


@register("classification_check",
          f"WITH t AS ({sql_chunk_table()}) "
          f"SELECT DISTINCT source_file, product_category, {X.sql_keyword_class('source_file', KEYWORDS)} AS expected_category, "
          f"CASE WHEN product_category = {X.sql_keyword_class('source_file', KEYWORDS)} THEN 'CORRECT' ELSE 'MISMATCH' END "
          "AS classification_result FROM t")
def classification_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file of the chunk table: assigned class vs. the keyword rule on the
    file name, ``CORRECT``/``MISMATCH``."""
    t = chunk_table(spark, sf_dir)
    expected = X.keyword_class("source_file", KEYWORDS)
    return (t.select("source_file", "product_category").distinct()
            .select("source_file", "product_category", expected.alias("expected_category"),
                    F.when(F.col("product_category") == expected, F.lit("CORRECT"))
                    .otherwise(F.lit("MISMATCH")).alias("classification_result"))
            .orderBy("source_file"))


def held_out(id_col: str) -> Column:
    """A quarter of the documents, by id hash, on which the classifier is not trained."""
    return F.pmod(F.xxhash64(id_col), F.lit(4)) == 0


def train_quality_model(spark: SparkSession, sf_dir: str, min_doc_freq: int = 0):
    """Learned scorer on ``labels.quality``: tokens → hashed TF → IDF →
    logistic regression (``pyspark.ml``, distributed fit)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = T.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = docs.filter(~held_out("doc_id")).join(labels, "doc_id")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tok", pattern=X.TOKEN_SPLIT, toLowercase=True),
        HashingTF(inputCol="tok", outputCol="tf", numFeatures=1 << 18),
        IDF(inputCol="tf", outputCol="features", minDocFreq=min_doc_freq),
        LogisticRegression(maxIter=30, regParam=0.01),
    ])
    return pipe.fit(train)


@register("classify_model")
def classify_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_quality_model(spark, sf_dir)
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    return model.transform(docs).select("doc_id", held_out("doc_id").alias("held_out"),
                                        F.col("prediction").cast("int").alias("predicted"))


# --- prompts (F14, T4) --------------------------------------------------------

register("prompt_rows",
         "SELECT page_id, replace('" + X.DESCRIBE_PROMPT.replace("'", "''") + "', '{0}', url) AS prompt FROM pages")(
    lambda spark, sf_dir: T.read(spark, sf_dir, "pages").select(
        "page_id", X.prompt(X.DESCRIBE_PROMPT, "url").alias("prompt")))


def describe_files(df: DataFrame, describe_batch, prompt_col: str = "prompt") -> DataFrame:
    """Run a caller-supplied batch function (list of prompts → list of texts)
    over ``prompt_col`` in Arrow batches; the model itself is not part of this
    library."""
    @F.pandas_udf(ST.StringType())
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(list(describe_batch(prompts.tolist())), index=prompts.index)

    return df.withColumn("description", run(F.col(prompt_col)))


def described_chunks(files: DataFrame, describe_batch) -> DataFrame:
    """Chunk rows of files that hold no text: one row per file of ``files`` (source_file,
    stage_name) with the model's description as chunk 0, classified by the file's name. Files without
    a name, and those that the model says nothing about, make no row."""
    own = files.filter(F.col("source_file").isNotNull()).select(
        "source_file", "stage_name", X.prompt(X.DESCRIBE_PROMPT, "source_file").alias("prompt"))
    described = describe_files(own, describe_batch).filter(F.length("description") > 0)
    return described.select(
        "source_file", F.lit("IMAGE").alias("file_type"), X.keyword_class("source_file", KEYWORDS).alias("product_category"),
        "stage_name", F.col("description").alias("chunk_text"), F.lit(0).cast("bigint").alias("chunk_index"),
    ).select(*CHUNK_COLUMNS)


def echo_model(prompts: list[str]) -> list[str]:
    """Stand-in for the caller's description model: it repeats what it was asked."""
    return ["Asked: " + p for p in prompts]


DESCRIBED_COLUMNS = ", ".join(CHUNK_COLUMNS)


@register("docs_chunks_described",
          f"SELECT {DESCRIBED_COLUMNS} FROM ({sql_chunk_table()}) UNION ALL SELECT {DESCRIBED_COLUMNS} FROM ("
          f"SELECT url AS source_file, 'IMAGE' AS file_type, {X.sql_keyword_class('url', KEYWORDS)} AS product_category, "
          "regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS stage_name, "
          "'Asked: ' || replace('" + X.DESCRIBE_PROMPT.replace("'", "''") + "', '{0}', url) AS chunk_text, "
          "CAST(0 AS BIGINT) AS chunk_index FROM pages WHERE url IS NOT NULL)")
def docs_chunks_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table with all branches: chunks of texts and pages, and a description row per page image
    (the data holds no images: every page stands for the image at its address)."""
    images = T.read(spark, sf_dir, "pages").select(
        F.col("url").alias("source_file"), F.try_parse_url(F.col("url"), F.lit("HOST")).alias("stage_name"))
    return chunk_table(spark, sf_dir).unionByName(described_chunks(images, echo_model))


@register("classification_confusion",
          f"WITH t AS ({sql_chunk_table()}) SELECT expected_category, product_category, CAST(COUNT(*) AS BIGINT) AS files, "
          "CAST(SUM(chunks) AS BIGINT) AS chunks FROM (SELECT source_file, product_category, "
          f"{X.sql_keyword_class('source_file', KEYWORDS)} AS expected_category, COUNT(*) AS chunks FROM t GROUP BY 1, 2, 3) "
          "GROUP BY 1, 2")
def classification_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and chunks by expected and assigned class: the off-diagonal rows are the mismatches."""
    files = chunk_table(spark, sf_dir).groupBy("source_file", "product_category").agg(F.count(F.lit(1)).alias("chunks"))
    return (files.withColumn("expected_category", X.keyword_class("source_file", KEYWORDS))
            .groupBy("expected_category", "product_category")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"))
            .orderBy("expected_category", "product_category"))


# --- checks on the chunk table (Q2, Q3, Q4) --------------------------------------

@register("chunk_counts_by_type",
          f"WITH t AS ({sql_chunk_table()}) SELECT file_type, product_category, CAST(COUNT(*) AS BIGINT) AS chunk_count, "
          "CAST(COUNT(DISTINCT source_file) AS BIGINT) AS file_count FROM t GROUP BY 1, 2")
def chunk_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunk_table(spark, sf_dir)
    return (t.groupBy("file_type", "product_category")
            .agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("source_file").alias("file_count"))
            .orderBy("file_type", "product_category"))


@register("chunks_per_file",
          f"WITH t AS ({sql_chunk_table()}) SELECT source_file, file_type, product_category, "
          "CAST(COUNT(*) AS BIGINT) AS chunks FROM t GROUP BY 1, 2, 3")
def chunks_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunk_table(spark, sf_dir)
    return (t.groupBy("source_file", "file_type", "product_category")
            .agg(F.count(F.lit(1)).alias("chunks")).orderBy("file_type", "source_file"))


@register("chunk_quality_nulls",
          f"WITH t AS ({sql_chunk_table()}) SELECT CAST(COUNT(*) FILTER (WHERE chunk_text IS NULL) AS BIGINT) AS null_chunk_text, "
          "CAST(COUNT(*) FILTER (WHERE product_category IS NULL) AS BIGINT) AS null_category, "
          "CAST(COUNT(*) FILTER (WHERE length(chunk_text) = 0) AS BIGINT) AS empty_chunk_text FROM t")
def chunk_quality_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunk_table(spark, sf_dir)
    return t.agg(F.count_if(F.col("chunk_text").isNull()).alias("null_chunk_text"),
                 F.count_if(F.col("product_category").isNull()).alias("null_category"),
                 F.count_if(F.length("chunk_text") == 0).alias("empty_chunk_text"))
