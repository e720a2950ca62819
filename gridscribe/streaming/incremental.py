"""Structured Streaming: table documents that arrive as files become passages, batch by batch.

A table is one document, so a micro-batch holds whole tables and windows never span batches. Each batch is written to a
folder named by its id, which makes a replayed batch replace itself instead of adding rows. What a batch writes on its way
goes with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from gridscribe.plans.staging import scratch
from gridscribe.plans.strategies import STRATEGIES, serialize
from gridscribe.sources.tables import TABLE, from_documents


def serialize_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, strategy: str = "schema", files_a_batch: int = 1000) -> StreamingQuery:
    """Start a query that serializes what is in source and ends (trigger available-now)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")

    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            serialize(from_documents(batch), strategy).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    tables = spark.readStream.schema(TABLE).option("maxFilesPerTrigger", files_a_batch).json(source)
    return tables.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
