"""Image files that arrive in a folder, decoded as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators import codec
from pixelloom.sources import streams


def decode_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Decodes all files that are there and have not been seen before into a Parquet table; ends when they are done."""
    decoded = codec.decode(streams.arriving(spark, source)).drop("content")
    return decoded.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
