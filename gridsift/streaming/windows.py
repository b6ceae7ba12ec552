"""Streams of events: the same searches and aggregates over tables that grow. The batch and the streaming form share their plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SearchQuery
from ..operators.search import search_table


def windowed_counts(events: DataFrame, *, time: str, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, window_end, by, n over tumbling (or sliding) windows; on a stream, rows later than `late` are dropped."""
    source = events.withColumn("_time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        source = source.withWatermark("_time", late)
    window = F.window("_time", width, slide) if slide else F.window("_time", width)
    return source.groupBy(window, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")


def sessions(events: DataFrame, *, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """session_start, session_end, by, n: runs of events without a gap of that length."""
    source = events.withColumn("_time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        source = source.withWatermark("_time", late)
    return source.groupBy(F.session_window("_time", gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def search_stream(rows: DataFrame, query: SearchQuery) -> DataFrame:
    """A search of a stream: no state, each row is judged as it comes."""
    if query.limit is not None or query.context_lines:
        raise ValueError("limits and context need a table that is whole")
    return search_table(rows, query)
