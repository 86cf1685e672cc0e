"""Token and event counts over streams: an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def stream_type_counts(docs: DataFrame) -> DataFrame:
    """(type, freq) so far, of a stream of docs(text); update or complete mode."""
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("type")).groupBy("type").agg(F.count("*").alias("freq"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
