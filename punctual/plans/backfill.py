"""A past day again, from its position files to stored observations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators import trips
from punctual.sources import schedule_files
from punctual.sources.day_store import DayStore


def backfill_day(spark: SparkSession, positions_path: str, service_date: str, shapes: DataFrame, stops: DataFrame, out: str, force: bool = False, today: dt.date | None = None) -> dict[str, int]:
    """Reads the positions of a date, rebuilds its trips and arrivals, and replaces the date in the DayStore of out; returns row counts.

    shapes: trip_id, shape_id, and segments of shape_segments() under `segments`' columns. stops: trip_id, stop_sequence, stop_id, route_id, stop_m, arrival_time.
    """
    day = F.lit(service_date).cast("date")
    fixes = trips.reconstruct_trips(schedule_files.read_positions_csv(spark, positions_path, service_date)).drop("first_seen", "last_seen")
    fixes = fixes.withColumns({"trip_key": F.col("trip_id"), "plat": F.col("lat"), "plon": F.col("lon")}).persist()
    try:
        segments = shapes.select("shape_id", "seg", "lat", "lon", "lat2", "lon2", "lat0", "length_m", "along_m").distinct()
        of_trip = shapes.select(F.col("trip_id").alias("trip_key"), "shape_id").distinct()
        planned = stops.select(F.col("trip_id").alias("trip_key"), "stop_sequence", "stop_id", "route_id", F.col("stop_m").cast("double").alias("stop_m"), F.unix_micros(c.scheduled_ts(day, F.col("arrival_time"))).alias("scheduled_us"))
        rows = trips.finalized(fixes.select("trip_key", "vehicle_id", "ts", "plat", "plon"), of_trip, segments, planned).withColumns({"service_date": day, "trip_id": F.col("trip_key"), "is_stale": F.lit(False)})  # of a day that is over
        placed = trips.project_probes(fixes, of_trip, segments, planned)
        return DayStore(spark, out).replace({"observations": trips.stored_observations(rows, F.current_timestamp()), "probes": trips.stored_probes(placed, F.current_timestamp())}, today, force)
    finally:
        fixes.unpersist()
