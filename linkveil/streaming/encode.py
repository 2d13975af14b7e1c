"""Encoding as a stream: the encoder keeps no state, so it runs on readStream as it does on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkveil.operators.encoders import Encoding, encode


def encode_stream(stream: DataFrame, e: Encoding, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends every record's filter to Parquet at path, each once."""
    if e.harden == "markov":
        raise ValueError("Markov chains need all records at once")
    return encode(stream, e).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).format("parquet").start(path)
