"""Streaming: scores of a trained model for arriving rows, and a count sketch that is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Model
from ..operators.sketch import Hashing


def score_stream(stream: DataFrame, model: Model) -> DataFrame:
    """Stateless: the model's predictions as a streaming DataFrame; watermarks of the stream stay."""
    return model.predict(stream)


def sketch_stream(stream: DataFrame, transform: Hashing, key: str, value: str, time: str | None = None, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count sketch of (key, value) pairs: a linear sketch is a grouped sum, so a stream can carry it.

    With a time column there is one sketch for each window, rows later than the watermark being left out.
    """
    rows = stream.select(*([F.col(time).cast("timestamp").alias("time")] if time else []), transform.bucket(F.col(key)).alias("bucket"), (transform.value(F.col(key)) * F.col(value)).alias("v"))
    if time:
        rows = rows.withWatermark("time", late)
        return rows.groupBy(F.window("time", window), "bucket").agg(F.sum("v").alias("v"))
    return rows.groupBy("bucket").agg(F.sum("v").alias("v"))


def to_memory(stream: DataFrame, name: str, mode: str = "append"):
    """Run what has arrived into a table in memory and return the finished query."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
