"""Windows over streams of arrivals and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE = "20 minutes"


def live_volume_15min(arrivals: DataFrame) -> DataFrame:
    """Arrivals by route and quarter of an hour."""
    return arrivals.withWatermark("ts", STALE).groupBy("route_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("route_id", F.col("w.start").alias("start"), "n")


def session_trips(positions: DataFrame) -> DataFrame:
    """A vehicle's activity without a gap of 20 minutes."""
    return positions.withWatermark("ts", STALE).groupBy("vehicle_id", F.session_window("ts", STALE).alias("w")).agg(F.count("*").alias("probes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select("vehicle_id", "first_seen", "last_seen", "probes")
