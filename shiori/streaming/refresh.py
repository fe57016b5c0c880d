"""Incremental refresh of the corpus as a stream of line files (J3, H5-H13), and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiori.operators.corpus import tokens
from shiori.session import settle

LINES = "doc_id string, line_no int, text string, start_ms long, end_ms long, loaded_at timestamp"


BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def _merge(target: str):
    def step(batch: DataFrame, batch_id: int) -> None:
        """Adds the batch's lines to the log, by bucket of documents; the same batch written again
        after a failure overwrites its own folder. Lines without a key can't be named and are left out."""
        rows = batch.where("doc_id is not null and line_no is not null").withColumn("bucket", _bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/lines/batch={batch_id}")
        _recount(batch.sparkSession, target, batch_id, rows.select("doc_id", "bucket").distinct())

    return step


def _recount(spark: SparkSession, target: str, batch_id: int, touched: DataFrame) -> None:
    """Words of the touched documents, counted anew over all their lines so far; no other document is read
    but those in the same buckets of the log."""
    touched = settle(touched)
    buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    log = spark.read.schema(LINES + ", batch int, bucket int").parquet(f"{target}/lines").where(F.col("bucket").isin(buckets) & (F.col("batch") <= batch_id))
    mine = log.join(touched.select("doc_id"), "doc_id", "left_semi")
    # of a line delivered again the latest counts; one taken back comes again with a null text
    last = F.max_by("text", F.struct("loaded_at", "batch", "text")).alias("text")
    once = mine.groupBy("doc_id", "line_no").agg(last)
    counts = tokens(once).groupBy("doc_id", F.col("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    # a document that has no words left still replaces what it said before
    marks = touched.select("doc_id", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"))
    counts.unionByName(marks).withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/counts/batch={batch_id}")


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes in all line files that are new in `source`; run again later, it takes only newer ones."""
    lines = spark.readStream.schema(LINES).parquet(source)
    return lines.writeStream.foreachBatch(_merge(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget(spark: SparkSession, target: str, documents: DataFrame, batch_id: int) -> None:
    """H6: documents (doc_id) that went: a mark without words replaces what they said."""
    gone = documents.select("doc_id", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n")).distinct()
    gone.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/counts/batch={batch_id}")


def contributions(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, word, n): of each document what it said when it was last touched."""
    rows = spark.read.schema("doc_id string, word string, n long, batch int, bucket int").parquet(f"{target}/counts")
    last = rows.groupBy("bucket", "doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["bucket", "doc_id", "batch"]).where("word is not null").select("doc_id", "word", "n")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """J1, J2 (extension): events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
