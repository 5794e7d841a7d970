"""An extension: page files that arrive over time are put into a store document by document.

A micro-batch replaces the partitions of the documents in it, so a batch that is run again leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Store


def follow_jsonl(spark: SparkSession, folder: str, schema: str, store: Store, name: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Starts a query that takes new JSON-lines files of a folder, `files` in a batch; ends when all present are taken."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.where(F.col("doc_id").isNotNull())
        ids = [r[0] for r in batch.select("doc_id").distinct().collect()]
        if ids:
            store.replace_documents(name, batch, ids)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_over_time(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and doc_id of a stream with event times, late rows up to the watermark included."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "doc_id").agg(F.count("*").alias("n"))
