"""Incremental indexing of a stream of documents.

Each micro-batch writes its documents' terms into a folder of its own, named by its number, so a batch that is run again replaces
itself. Statistics are summed over batches when an index is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fathom.sources.index import Index


class IndexSink:
    """``fields`` gives the full-text columns of the streamed documents; ids must be new."""

    def __init__(self, path: str, fields: dict[str, Column], key: str = "doc_id") -> None:
        self.path, self.fields, self.key = path, fields, key

    def write_batch(self, batch: DataFrame, number: int) -> None:
        index = Index.build(batch, self.fields, self.key)
        index.forward.write.mode("overwrite").parquet(f"{self.path}/forward/batch={number}")
        index.docs.write.mode("overwrite").parquet(f"{self.path}/docs/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def open(self, spark: SparkSession) -> Index:
        forward = spark.read.parquet(f"{self.path}/forward").drop("batch")
        return Index.over(spark.read.parquet(f"{self.path}/docs").drop("batch"), forward, list(self.fields))

    def compact(self, spark: SparkSession, path: str) -> Index:
        """The batches so far as a stored index, its postings sorted by term."""
        return self.open(spark).write(path)
