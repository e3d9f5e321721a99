"""Operators over growing folders: each run takes what is new, then stops, and goes on from its checkpoint the next time.

Rows that pass one by one are appended; totals and counts by window are state, which the checkpoint keeps between runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.filters import min_length
from quern.operators.splits import hash_split
from quern.operators.tokens import byte_count


def new_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source string", files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def prepared(docs: DataFrame) -> DataFrame:
    """Long enough, split by hash, counted; the same rows as the batch operators give."""
    return hash_split(min_length(docs)).withColumn("tokens", byte_count(F.col("text")))


def write_new(docs: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = prepared) -> StreamingQuery:
    """Appends what is new to Parquet by split, exactly once, and ends."""
    return transform(docs).writeStream.format("parquet").partitionBy("split").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(events: DataFrame, time: str, key: str, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Rows by key and window; rows later than ``late`` are dropped by the watermark, which bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def totals(docs: DataFrame) -> DataFrame:
    """docs and tokens of each split over all documents so far."""
    return prepared(docs).groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


def keep_totals(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Brings the totals of all files so far up to date and ends; a batch that is run again writes the same rows in its place.

    The state has a row for each split, whatever the number of documents.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return totals(docs).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """split, docs, tokens as the last batch left them."""
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").select("split", "docs", "tokens")


def keep_counts(counts: DataFrame, key: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the windows of running_counts that can't change any more to Parquet (begin, key, n) and ends.

    Open windows stay in the state for the next run; the watermark drops those that are written.
    """
    rows = counts.select(F.col("window.start").alias("begin"), key, "n")
    return rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
