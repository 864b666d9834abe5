"""Streaming ingest: each micro-batch becomes one atomic batch of a store, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, query_name: str = "ingest", available_now: bool = True):
    """Start a query that writes stream (pos, key, kind, value) to store.

    The micro-batch's number is recorded in the commit, so a batch that is run again after a failure is skipped.
    No watermark: numbers, not event time, order versions.
    """
    writer = stream.writeStream.foreachBatch(lambda df, n: store.write(df, batch_id=(query_name, n)) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
