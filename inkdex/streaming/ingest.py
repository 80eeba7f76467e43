"""Incremental ingestion through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkdex.plans.engine import Engine
from inkdex.runtime import file_system


def document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Documents from Parquet files as they arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_ingest(engine: Engine, docs: DataFrame, checkpoint: str) -> StreamingQuery:
    """Indexes every micro-batch; ``engine.flush()`` waits for what has arrived.

    A batch's number is committed with its documents in the engine's index, so a batch that is delivered twice counts
    once. Started again from the same checkpoint, on an engine with the same ``index_path`` (or one that recovered the
    documents from its store), it continues where it stopped. An engine that holds nothing of what the checkpoint has
    passed would miss those documents for good: that is an error.
    """
    name = checkpoint.rstrip("/")
    fs, passed = file_system(engine.spark, f"{name}/commits")
    if fs.exists(passed) and fs.listStatus(passed) and name not in engine.generations.manifest.streams and engine.options.storage is None:
        raise ValueError("this checkpoint has passed documents that the engine doesn't hold: give it the same index_path, a store, or a new checkpoint")

    def add(batch: DataFrame, number: int) -> None:
        engine.index(batch, stream=(name, number))

    query = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
    engine.streams.append(query)
    return query
