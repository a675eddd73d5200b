"""Incremental work: new documents as they arrive, and windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import fixed_length
from ..operators.quality import with_quality


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest_chunks(docs: DataFrame, target: str, checkpoint: str, **split):
    """Chunk every new document once and append to target; runs over what is there, then stops.

    Each micro-batch goes to a folder of its own number, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        with_quality(fixed_length(batch, **split)).withColumn("issues", F.array_join("issues", ",")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """event_type, start, n, total in tumbling windows; works on streams (append mode) and on tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
