"""Outbox of summary messages: one outcome row per attempt, never a second message.

A message has an id made of its recipient, subject and body, so the same summary
is the same message whenever it is built again. ``deliver`` hands messages that no
earlier attempt has sent to a sink, in the tasks that hold them, and appends one
outcome row per message: sent, or failed with the key findings as fallback text. A
failing message fails neither its batch nor the job, and the next call tries it
again. A task that Spark runs twice (lost executor) may call the sink twice for one
message; the sink gets the id to tell.

Messages of equal id in one call are one message. Null recipients, subjects and
bodies count as empty; an empty table writes no outcome and is no error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from quarry.operators.analytics import summary_rows
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import tables as T

Sink = Callable[[str, str, str, str], None]       # message_id, recipient, subject, body; raises where it cannot send

# The texts that the caller gets back, and the length of a long body.
SENT_TEXT = "Email summary sent successfully to "
FAILED_TEXT = "Note: Email delivery unavailable in this environment. Key findings: "
LONG_WORDS = 500

INTRO, CLOSING = "Summary of sales by category:", "Figures cover all sales on record."
OUTCOME = "message_id string, recipient string, subject string, attempt int, status string, status_text string"


def messages(rows: DataFrame, recipient: str, subject: str = "subject", body: str = "body") -> DataFrame:
    """(message_id, recipient, subject, body, word_count, is_long): bodies between an intro and a closing line."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
             for c, n in ((recipient, "recipient"), (subject, "subject"), (body, "body"))]
    whole = rows.select(*parts).withColumn("body", F.concat(F.lit(INTRO + "\n"), "body", F.lit("\n" + CLOSING)))
    words = F.size(F.split("body", r"\s+"))
    return whole.select(F.sha2(F.concat_ws("\n", "recipient", "subject", "body"), 256).alias("message_id"), "*",
                        words.alias("word_count"), (words > LONG_WORDS).alias("is_long"))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt so far; no rows where nothing was ever delivered to ``path``."""
    try:
        return spark.read.schema(OUTCOME).parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTCOME)


def deliver(rows: DataFrame, path: str, sink: Sink) -> DataFrame:
    """Send what is not sent yet of ``rows`` (``messages``) and return all outcomes at ``path``."""
    spark = rows.sparkSession
    so_far = outcomes(spark, path).groupBy("message_id").agg(
        F.max("attempt").alias("tried"), F.max(F.col("status") == "sent").alias("is_sent"))
    due = (rows.select("message_id", "recipient", "subject", "body").dropDuplicates(["message_id"])
           .join(so_far, "message_id", "left").filter("not coalesce(is_sent, false)")
           .withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1).drop("tried", "is_sent"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                try:
                    sink(m["message_id"], m["recipient"], m["subject"], m["body"])
                    status, text = "sent", SENT_TEXT + m["recipient"]
                except Exception:                          # whatever the sink raises is an outcome
                    status, text = "failed", FAILED_TEXT + m["body"]
                out.append((m["message_id"], m["recipient"], m["subject"], m["attempt"], status, text))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in OUTCOME.split(", ")])

    due.mapInArrow(send, OUTCOME).write.mode("append").parquet(path)
    return outcomes(spark, path)


def no_mail_to(prefix: str) -> Sink:
    """A sink that is out of reach for recipients whose name begins with ``prefix``."""
    def sink(message_id: str, recipient: str, subject: str, body: str) -> None:
        if prefix and recipient.startswith(prefix):
            raise ConnectionError(recipient)
    return sink


@register("summary_outbox", T.with_views(
    "WITH r AS (SELECT dc.customer_region, da.article_category, "
    "CAST(SUM(fs.total_price) AS DECIMAL(38,2)) AS revenue, COUNT(DISTINCT fs.customer_id) AS buyers, "
    "CAST(SUM(fs.quantity_sold) AS BIGINT) AS units "
    "FROM fact_sales fs JOIN dim_article da ON fs.article_id = da.article_id "
    "JOIN dim_customer dc ON fs.customer_id = dc.customer_id GROUP BY 1, 2), "
    "b AS (SELECT customer_region AS recipient, 'Sales summary: ' || customer_region AS subject, "
    f"'{INTRO}' || chr(10) || string_agg('- ' || article_category || ': $' || "
    "format('{:,}', CAST(ROUND(revenue, 0) AS BIGINT)) || ' revenue, ' || buyers || ' customers, ' || units || ' units', "
    f"chr(10) ORDER BY revenue DESC, article_category) || chr(10) || '{CLOSING}' AS body FROM r GROUP BY 1), "
    "m AS (SELECT sha256(recipient || chr(10) || subject || chr(10) || body) AS message_id, *, "
    "recipient LIKE 'A%' AS refused FROM b) "
    "SELECT message_id, recipient, subject, CAST(1 AS INTEGER) AS attempt, "
    "CASE WHEN refused THEN 'failed' ELSE 'sent' END AS status, "
    f"CASE WHEN refused THEN '{FAILED_TEXT}' || body ELSE '{SENT_TEXT}' || recipient END AS status_text FROM m "
    f"UNION ALL SELECT message_id, recipient, subject, 2, 'sent', '{SENT_TEXT}' || recipient FROM m WHERE refused",
    "fact_sales", "dim_article", "dim_customer"))
def summary_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of three deliveries of the regional summaries: the mail of some regions is out of
    reach at first, then all goes through, then there is nothing left to send."""
    rows = messages(summary_rows(spark, sf_dir), "customer_region")
    path = scratch_path(spark, "outbox")
    for out_of_reach in ("A", "", ""):
        found = deliver(rows, path, no_mail_to(out_of_reach))
    return found
