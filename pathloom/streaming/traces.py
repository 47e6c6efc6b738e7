"""Pings as they arrive: per-window speeds per trip, late ones within the watermark counted, later ones left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_speeds(pings: DataFrame, trip: str, at: str, speed: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Number, mean and greatest speed of each trip and window. Works on a stream (state is kept until the watermark passes the window) and on a finished table alike."""
    w = F.window(F.col(at), window)
    base = pings.withWatermark(at, late) if pings.isStreaming else pings
    out = base.groupBy(F.col(trip), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(speed).alias("mean_speed"), F.max(speed).alias("max_speed"))
    return out.select(trip, F.col("w.start").alias("start"), "n", "mean_speed", "max_speed")


def sessions(pings: DataFrame, trip: str, at: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Recordings split where nothing arrives for a while: start, end and number of pings of each session."""
    base = pings.withWatermark(at, late) if pings.isStreaming else pings
    out = base.groupBy(F.col(trip), F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(trip, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
