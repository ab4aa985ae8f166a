"""Date-partitioned tables and publication."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.columns import TZ, sanitize_key
from punctual.sources.files import read_text, swap_text


def append_finalized(rows: DataFrame, path: str) -> None:
    rows.sortWithinPartitions(*[x for x in ("route_id", "trip_id") if x in rows.columns]).write.mode("append").partitionBy("service_date").parquet(path)


def overwrite_service_dates(rows: DataFrame, path: str, today: dt.date | None = None, force: bool = False) -> None:
    """Replaces exactly the dates that rows has; running it again changes nothing.

    No rows is an error, and so is a date from today on, whose trips are still coming in, unless force says so.
    """
    last = rows.agg(F.max("service_date")).first()[0]
    if last is None:
        raise ValueError("refusing to replace a date with no rows")
    if not force and last >= (today or dt.datetime.now(ZoneInfo(TZ)).date()):
        raise ValueError(f"refusing to replace {last}, which is not over")
    rows.sortWithinPartitions("route_id", "trip_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(path)


def _index(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, f"{path}/index.json")
    return json.loads(text) if text else {"latest": None, "versions": {}}


def publish_rollup(rows: DataFrame, path: str, day: dt.date) -> bool:
    """Writes rows as a version of a date that never changes, then replaces the index, which names the version of each date and the latest date; says whether `latest` is now day.

    A date before the latest one is published without moving it; a date that is published again gets a new version. Readers of the index find a
    whole version at any time, also if this fails half way. The index has a line a date.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    version = f"archive/rollup_date={day}/version={uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    index = _index(spark, path)
    moved = index["latest"] is None or day.isoformat() >= index["latest"]
    versions = dict(sorted((index["versions"] | {day.isoformat(): version}).items(), reverse=True))
    swap_text(spark, f"{path}/index.json", json.dumps({"latest": day.isoformat() if moved else index["latest"], "versions": versions}, indent=0))
    return moved


def published_days(spark: SparkSession, path: str) -> list[str]:
    """Published dates, newest first."""
    return list(_index(spark, path)["versions"])


def read_published(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The rows of a published date, or of the latest."""
    index = _index(spark, path)
    version = index["versions"].get(day or index["latest"])
    if version is None:
        raise ValueError(f"nothing is published for {day or 'any date'}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def processed_routes(shapes: DataFrame, stops: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """A document for each route: its shapes, stops and trips, as maps by id; lists are in order. A route's timetable is one row.

    shapes: shape_id, seq, lat, lon, along_m. stops: stop_id, stop_name, lat, lon. trips: trip_id, route_id, shape_id, direction_id.
    stop_times: trip_id, stop_sequence, stop_id, stop_m, arrival_time.
    """
    line = lambda *x: F.sort_array(F.collect_list(F.struct(*x)))
    by_id = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value))))
    points = shapes.groupBy("shape_id").agg(line("seq", "lat", "lon", "along_m").alias("points"))
    a = trips.select("route_id", "shape_id").distinct().join(points, "shape_id").groupBy("route_id").agg(by_id("shape_id", F.col("points")).alias("shapes"))
    b = trips.join(stop_times, "trip_id").select("route_id", "stop_id").distinct().join(stops, "stop_id").groupBy("route_id").agg(by_id("stop_id", F.struct("stop_name", "lat", "lon")).alias("stops"))
    calls = stop_times.groupBy("trip_id").agg(line("stop_sequence", "stop_id", "stop_m", "arrival_time").alias("stop_times"))
    d = trips.join(calls, "trip_id").groupBy("route_id").agg(by_id("trip_id", F.struct("shape_id", "direction_id", "stop_times")).alias("trips"))
    return d.join(a, "route_id", "left").join(b, "route_id", "left")


def export_processed_routes(documents: DataFrame, path: str) -> None:
    """One JSON folder a route."""
    documents.withColumn("route_key", sanitize_key(F.col("route_id"))).write.mode("overwrite").partitionBy("route_key").json(path)


def write_per_route(rows: DataFrame, path: str) -> None:
    """One folder a route, its name made of letters, digits, _ and -."""
    rows.withColumn("route_key", sanitize_key(F.col("route_id"))).write.mode("overwrite").partitionBy("route_key").parquet(path)
