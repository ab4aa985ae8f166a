"""Schedule tables and vehicle positions from files."""

from __future__ import annotations

import csv
import hashlib
import io
import posixpath
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import dedup_observations
from punctual.sources.day_store import DayStore

#: Columns of the schedule tables, all read as text.
TABLES = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "shapes": ["shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"],
    "trips": ["trip_id", "route_id", "shape_id", "service_id", "direction_id"],
    "stop_times": ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "pickup_type"],
    "routes": ["route_id", "route_long_name", "route_color", "route_text_color"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}


def read_schedule_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a schedule folder as text columns; what a file lacks is ''. A byte order mark in its header is dropped."""
    own = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(f"{path}/{name}.txt")
    own = own.toDF(*[x.lstrip("﻿").strip() for x in own.columns])
    return own.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) if x in own.columns else F.lit("").alias(x) for x in TABLES[name]])


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))


def read_archives(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of many dated schedule archives (zip files that path matches): archive, then the table's columns as text, '' where an archive lacks them.

    Archives are read in parallel, each in one task, its rows in batches.
    """
    wanted = TABLES[name]

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive = posixpath.basename(where)
                with zipfile.ZipFile(io.BytesIO(content)) as members:
                    if f"{name}.txt" not in members.namelist():
                        continue
                    with members.open(f"{name}.txt") as raw:
                        rows = []
                        for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), skipinitialspace=True):
                            rows.append((archive, *[(row.get(x) or "").strip() for x in wanted]))
                            if len(rows) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["archive", *wanted])
                                rows = []
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["archive", *wanted])

    return _archives(spark, path).mapInArrow(run, ", ".join(f"{x} string" for x in ("archive", *wanted)))


def read_archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, sha256 of every member of many archives."""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as members:
                    rows = [(posixpath.basename(where), x, hashlib.sha256(members.read(x)).hexdigest()) for x in members.namelist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["archive", "member", "sha256"])

    return _archives(spark, path).mapInArrow(run, "archive string, member string, sha256 string")


_VEHICLE = "vehicle struct<id: string>, trip struct<trip_id: string, route_id: string, start_date: string>, position struct<latitude: double, longitude: double, bearing: double, speed: double>, timestamp bigint"


_SNAPSHOT = f"id string, vehicle struct<{_VEHICLE.replace(' struct', ': struct').replace('timestamp bigint', 'timestamp: bigint')}>"


def _vehicle_rows(entities: DataFrame) -> DataFrame:
    """Rows of snapshot entities, with seen, the instant of their file: the unix second that it is named by, or else its time. Defective entities have no vehicle_id."""
    v = "vehicle"
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{9,})\.json", 1).try_cast("bigint")
    seen = F.coalesce(F.timestamp_seconds(named), F.col("_metadata.file_modification_time"))
    usable = F.col(f"{v}.vehicle.id").isNotNull() & F.col(f"{v}.position.latitude").isNotNull() & F.col(f"{v}.position.longitude").isNotNull() & F.col(f"{v}.trip.start_date").isNotNull()
    zero = lambda x: F.nullif(F.col(x), F.lit(0.0))
    return entities.select(F.when(usable, F.col(f"{v}.vehicle.id")).alias("vehicle_id"), F.col(f"{v}.trip.trip_id").alias("trip_id"), F.col(f"{v}.trip.route_id").alias("route_id"), c.parse_service_date(F.col(f"{v}.trip.start_date")).alias("service_date"), F.coalesce(F.timestamp_seconds(F.col(f"{v}.timestamp")), seen).alias("ts"), F.col(f"{v}.position.latitude").alias("lat"), F.col(f"{v}.position.longitude").alias("lon"), zero(f"{v}.position.bearing").alias("bearing"), zero(f"{v}.position.speed").alias("speed"), seen.alias("seen"))


def read_positions_json(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle rows of snapshot files, each an array of entities. Those without vehicle, position or start date are left out; without an instant of their own they get the file's."""
    return _vehicle_rows(spark.read.schema(_SNAPSHOT).json(path, multiLine=True)).where("vehicle_id is not null")


def positions_stream(spark: SparkSession, path: str, files: int = 10, name: str = "positions") -> DataFrame:
    """Vehicle rows of snapshot files as they land in a folder, `files` of them at a time, as read_positions_json() reads them.

    Each batch observes under `name` how many entities came and how many of them were defective.
    """
    own = _vehicle_rows(spark.readStream.schema(_SNAPSHOT).option("maxFilesPerTrigger", files).option("multiLine", True).json(path))
    return own.observe(name, F.count("*").alias("entities"), F.count_if(F.col("vehicle_id").isNull()).alias("defective")).where("vehicle_id is not null")


def read_positions_csv(spark: SparkSession, path: str, service_date: str, tz: str = c.TZ) -> DataFrame:
    """Vehicle rows of one service date from snapshot files named by unix second, from 3 o'clock local time to 6 o'clock the day after.

    Only files of these hours are read. Rows of other dates, without ids, or with an unusable place or time are left out. A missing column is an error.
    """
    day = F.lit(service_date).cast("date")
    start, end = F.unix_seconds(c.midnight(day, tz)) + 3 * 3600, F.unix_seconds(c.midnight(F.date_add(day, 1), tz)) + 6 * 3600
    taken = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.csv", 1).try_cast("bigint")
    own = spark.read.option("header", True).csv(path).where(taken.between(start, end))
    missing = {"vehicle_id", "trip_id", "route_id", "start_date", "lat", "lon", "timestamp"}.difference(own.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    number = lambda x: F.col(x).try_cast("double") if x in own.columns else F.lit(None).cast("double")
    rows = own.select("vehicle_id", "trip_id", "route_id", c.parse_service_date(F.col("start_date")).alias("service_date"), F.timestamp_seconds(F.col("timestamp").try_cast("bigint")).alias("ts"), number("lat").alias("lat"), number("lon").alias("lon"), c.zero_to_null(number("bearing")).alias("bearing"), c.zero_to_null(number("speed")).alias("speed"))
    named = lambda x: F.coalesce(F.trim(F.col(x)), F.lit("")) != ""
    placed = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("ts").isNotNull()
    return rows.where(named("vehicle_id") & named("trip_id") & placed & (F.col("service_date") == day))


def obs_for_range(spark: SparkSession, source: str | DayStore, first: Column | str, last: Column | str) -> DataFrame:
    """Stored observations of a range of service dates, one row for each trip and stop; only the range's partitions are read. source: a folder, or a DayStore with dates as text."""
    if isinstance(source, DayStore):
        return dedup_observations(source.read("observations", first, last), ["vehicle_id"])
    rows = spark.read.parquet(source).where(F.col("service_date").between(first, last))
    return dedup_observations(rows) if "ingested_at" in rows.columns else rows
