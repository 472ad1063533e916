"""Degrees of a growing graph, over Structured Streaming. An extra of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.graph import both_ways


def streaming_degrees(edges: DataFrame, watermark: str | None = None, event_time: str = "ts") -> DataFrame:
    """(id, deg) over a stream of canonical edges (src, dst), each counted once; with ``watermark``, state older than that goes, and repeats later than that count again."""
    proper = edges.where("src < dst")
    if watermark:
        distinct = proper.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["src", "dst"])
    else:
        distinct = proper.dropDuplicates(["src", "dst"])
    return both_ways(distinct).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
