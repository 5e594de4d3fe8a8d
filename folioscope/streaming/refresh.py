"""Structured Streaming on top of the index: batches of page versions refresh it. Beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.index import Index
from folioscope.sources import tree


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each page (path, content, modified_at)."""
    newest = F.max_by(F.struct("content", "modified_at"), F.struct("modified_at", F.sha2("content", 256))).alias("v")
    return versions.groupBy("path").agg(newest).select("path", "v.*")


def refresh_stream(versions: DataFrame, store: str, index: Index, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of (path, content, modified_at) to the store of versions, then refresh the index.

    A batch that is run again writes the same folder, so the store holds each version once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("path", "content", "modified_at").write.mode("overwrite").parquet(f"{store}/batch={number}")
        pages = tree.pages(latest(spark.read.parquet(store).drop("batch")))
        index.refresh(pages)

    writer = versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
