"""Refresh of the search index (the reference's ``TARGET_LAG`` / directory
refresh) as Structured Streaming over a stream of changes.

A change is ``(op, seq, doc_id, text, *attributes)``: ``upsert`` adds a document or
replaces it, ``delete`` takes it out; of the changes of one document the one with the
largest ``seq`` counts, whenever it arrives. New files in an input folder are picked up
by a file-source stream, and each micro-batch writes one segment:

* ``changes/batch_id=<n>`` — ``(doc_id, seq, op)``, the newest change of every document
  in the batch; a delete is a tombstone;
* ``rows/batch_id=<n>`` — a row per upserted document with its tokens; only those are tokenised,
  and of changes that an earlier segment already holds (a file delivered again) none is.

Folders are overwritten, so a replayed batch (after the loss of an executor or
the driver) leaves no second copy; a file delivered again makes a segment of older or
equal ``seq``, which changes nothing. Readers take the newest change of every document
over all segments and the rows of that one segment. ``merge`` writes the live
documents as a new base and then names it in a log; segments up to it need
no longer be read.

``trigger(availableNow=True)`` processes what has arrived and stops (a
scheduled refresh); ``processingTime`` gives a standing refresh with a lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text as X
from quarry.operators import term_index as TI
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import tables as T

ATTRIBUTES = ("lang", "source")
NO_BASE = -1


def newest(changes: DataFrame, *columns: str) -> DataFrame:
    """The newest change of every document (by seq, then by segment)."""
    order = F.struct(*[c for c in ("seq", "batch_id") if c in changes.columns])
    kept = F.max_by(F.struct(*columns), order).alias("c")
    return changes.groupBy("doc_id").agg(kept).select("doc_id", "c.*")


class Segments:
    """Segments of one index under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: ST.StructType, attributes=ATTRIBUTES):
        self.spark, self.folder, self.attributes = spark, folder.rstrip("/"), tuple(attributes)
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        own = "".join(f", {a} {kinds[a]}" for a in self.attributes)
        self.row_schema = f"doc_id {kinds['doc_id']}, dl int{own}, words string, batch_id bigint"
        self.change_schema = f"doc_id {kinds['doc_id']}, seq bigint, op string, batch_id bigint"

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """One segment; the batch's older changes of a document are left out, and those no newer than
        what earlier segments hold. Ids and numbers alone decide that: texts are shuffled only where
        some changes of a batch count and others do not."""
        known = newest(self.changes().filter(F.col("batch_id") < batch_id), "seq").withColumnRenamed("seq", "known").alias("k")
        last = changes.groupBy("doc_id").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("times"))
        met = last.alias("l").join(known, F.col("l.doc_id").eqNullSafe(F.col("k.doc_id")), "left")
        met = TI.write_table(met.select("l.doc_id", "seq", "times", (F.col("known").isNull() | (F.col("seq") > F.col("known"))).alias("fresh")),
                             scratch_path(self.spark, "refresh-met"))
        n = met.agg(F.sum("times").alias("rows"), F.count_if("fresh").alias("fresh"), F.max("times").alias("times")).first()
        own = changes
        if n["fresh"] == 0:
            own = changes.filter(F.lit(False))
        elif n["fresh"] < n["rows"]:
            pick = met.filter("fresh").select(F.col("doc_id").alias("d"), F.col("seq").alias("s"))
            own = changes.join(pick, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("seq") == F.col("s")), "left_semi")
            if n["times"] > 1:
                own = TI.write_table(newest(own, "seq", "op", "text", *self.attributes), scratch_path(self.spark, "refresh-batch"))
        (TI.doc_rows(own.filter("op = 'upsert'"), "doc_id", "text", self.attributes)
         .write.mode("overwrite").parquet(f"{self.folder}/rows/batch_id={batch_id}"))
        own.select("doc_id", "seq", "op").write.mode("overwrite").parquet(f"{self.folder}/changes/batch_id={batch_id}")

    def open(self) -> None:
        """Log of bases, begun once, and the folders of segments."""
        for kind, schema in (("rows", self.row_schema), ("changes", self.change_schema)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{kind}/batch_id={NO_BASE}")
        (self.spark.createDataFrame([(NO_BASE, "")], "upto bigint, path string")
         .write.mode("ignore").parquet(f"{self.folder}/log"))

    def base(self) -> tuple[int, str]:
        log = self.spark.read.schema("upto bigint, path string").parquet(f"{self.folder}/log")
        row = log.orderBy(F.desc("upto")).first()
        return row["upto"], row["path"]

    def read(self, kind: str) -> DataFrame:
        """``rows`` or ``changes`` of the base and the segments after it."""
        schema = {"rows": self.row_schema, "changes": self.change_schema}[kind]
        upto, path = self.base()
        found = self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}").filter(F.col("batch_id") > upto)
        return found if upto == NO_BASE else found.unionByName(self.spark.read.schema(schema).parquet(f"{path}/{kind}"))

    def changes(self) -> DataFrame:
        return self.read("changes")

    def live_docs(self) -> tuple[DataFrame, DataFrame]:
        """(newest change per document, rows of the documents that are not deleted). Segments of which
        every document is live are taken as they are, those without any are not read; only rows of
        the others meet the changes."""
        state = TI.write_table(newest(self.changes(), "seq", "op", "batch_id"), scratch_path(self.spark, "refresh-state"))
        written = self.changes().filter("op = 'upsert'").groupBy("batch_id").agg(F.count(F.lit(1)).alias("written"))
        own = state.filter("op = 'upsert'").select("doc_id", "batch_id")
        counts = written.join(own.groupBy("batch_id").agg(F.count(F.lit(1)).alias("live")), "batch_id").collect()
        whole = [r["batch_id"] for r in counts if r["live"] == r["written"]]
        some = [r["batch_id"] for r in counts if r["live"] < r["written"]]
        rows = self.read("rows")
        found = rows.filter(F.col("batch_id").isin(whole))
        if some:
            found = found.unionByName(rows.filter(F.col("batch_id").isin(some))
                                      .join(own.filter(F.col("batch_id").isin(some)), ["doc_id", "batch_id"], "left_semi").select(*rows.columns))
        return state, found

    def live(self) -> tuple[DataFrame, DataFrame]:
        """(newest change per document, term rows of the documents that are not deleted)."""
        state, rows = self.live_docs()
        return state, TI.term_rows(rows, *self.attributes, "batch_id")

    def merge(self) -> None:
        """All segments into a new base. Tombstones stay: a late change of smaller seq must not bring
        a deleted document back."""
        state, rows = self.live_docs()
        upto = state.agg(F.max("batch_id")).first()[0]
        if upto is None or upto == self.base()[0]:
            return
        path = f"{self.folder}/base-{upto}"
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        state.write.mode("overwrite").parquet(f"{path}/changes")
        (self.spark.createDataFrame([(upto, path)], "upto bigint, path string")
         .write.mode("append").parquet(f"{self.folder}/log"))

    def index(self) -> TI.TermIndex:
        """The index of the live documents."""
        path = scratch_path(self.spark, "term-index")
        rows = TI.write_table(self.live_docs()[1].drop("batch_id"), f"{path}/rows")
        return TI.from_rows(rows, self.attributes, path)


def start_refresh(segments: Segments, input_dir: str, checkpoint_dir: str, schema: ST.StructType,
                  available_now: bool = True, lag: str = "1 day",
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = segments.spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    segments.open()
    w = (reader.parquet(input_dir).writeStream.foreachBatch(segments.write)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=lag)
    return w.start()


def changes_of(docs: DataFrame, op: str, seq: int) -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"), "doc_id", "text", *ATTRIBUTES)


def refreshed(spark: SparkSession, drops: list[DataFrame], merge_after: int | None = None) -> Segments:
    """Segments after each of ``drops`` arrived in one folder and a scheduled refresh ran."""
    input_dir, folder = scratch_path(spark, "refresh-input"), scratch_path(spark, "refresh-index")
    ckpt = scratch_path(spark, "refresh-checkpoint")
    segments = Segments(spark, folder, drops[0].schema)
    for n, drop in enumerate(drops):
        drop.write.mode("append").parquet(input_dir)
        start_refresh(segments, input_dir, ckpt, drop.schema).awaitTermination()
        if n == merge_after:
            segments.merge()
    return segments


def _stats_sql(where: str = "") -> str:
    return (f"WITH d AS (SELECT doc_id, {X.sql_tokens('text')} AS tok FROM documents{where}), "
            "post AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM d) GROUP BY 1, 2) "
            "SELECT term, CAST(COUNT(*) AS BIGINT) AS df, CAST(SUM(tf) AS BIGINT) AS total_tf FROM post GROUP BY term")


# Arrival order of the keys: English documents first, then all others; documents of one
# source are deleted later.
FIRST_ARRIVAL_LANG = "en"
DELETED_SOURCE = "src3"


@register("refresh_incremental", _stats_sql())
def refresh_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two drops; two scheduled refreshes consume them;
    the refreshed index's term statistics equal a batch build's."""
    docs = T.read(spark, sf_dir, "documents")
    first = F.col("lang").eqNullSafe(F.lit(FIRST_ARRIVAL_LANG))
    return refreshed(spark, [changes_of(docs.filter(first), "upsert", 1),
                             changes_of(docs.filter(~first), "upsert", 2)]).index().lexicon()


@register("refresh_changes", _stats_sql(f" WHERE source IS DISTINCT FROM '{DELETED_SOURCE}'"))
def refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates, deletes and a drop delivered again: the first drop holds every
    document's heading only, the second replaces it by the whole text, the third
    deletes one source; then the second drop arrives once more. Segments are merged half way."""
    docs = T.read(spark, sf_dir, "documents")
    whole = changes_of(docs, "upsert", 2)
    gone = docs.filter(F.col("source") == DELETED_SOURCE)
    drops = [changes_of(docs.withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1))), "upsert", 1), whole,
             changes_of(gone.withColumn("text", F.lit(None).cast("string")), "delete", 3), whole]
    return refreshed(spark, drops, merge_after=1).index().lexicon()
