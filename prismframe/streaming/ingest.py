"""Bounded ingest of new files into a store: what has come since the last run, exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prismframe.operators.store import typed


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, fields: dict[str, str]) -> StreamingQuery:
    """Appends the rows of Parquet files that were not seen before, typed as a store's rows, then ends. _idx comes with the rows."""
    rows = spark.readStream.schema(schema).parquet(source)
    return typed(rows, fields).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
