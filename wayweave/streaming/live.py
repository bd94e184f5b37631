"""Sightings as a stream: hot edges of tumbling or sliding windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def passages(events: DataFrame) -> DataFrame:
    """ts, edge_id, obj_id of an event stream or table."""
    return events.select("ts", F.get_json_object("props", "$.k").cast("long").alias("edge_id"), F.col("user_id").alias("obj_id"))


def windowed_sightings(rows: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Distinct (window, edge_id, obj_id); on a stream duplicates and late rows are bounded by the watermark."""
    if rows.isStreaming:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.select(w.alias("window"), "edge_id", "obj_id").dropDuplicates(["window", "edge_id", "obj_id"])


def edge_counts(rows: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, edge_id, n_objects by window; append mode on a stream."""
    out = windowed_sightings(rows, length, slide, late).groupBy("window", "edge_id").agg(F.count("*").alias("n_objects"))
    return out.select(F.col("window.start").alias("start"), "edge_id", "n_objects")
