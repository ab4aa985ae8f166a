"""Observations and probes by service date, each date's versions named by a manifest.

Rows are written to folders service_date=.../version=... that nobody reads yet; then the date's manifest, a file of a
few lines, is replaced. So both tables of a date change at once, an error before that leaves the old day in both, and a batch
that is written again takes its own folders' place. Readers take the folders that manifests name, and no others.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.columns import TZ
from punctual.sources.files import children, delete, read_text, swap_text

OBSERVATIONS = "service_date date, route_id string, trip_id string, vehicle_id string, stop_sequence long, stop_id string, scheduled_arrival timestamp, actual_arrival timestamp, delay_seconds long, leg_distance_m double, leg_duration_s double, leg_avg_speed_mps double, is_stale boolean, ingested_at timestamp"
PROBES = "service_date date, route_id string, trip_id string, vehicle_id string, observed_at timestamp, lat double, lon double, bearing_deg double, reported_speed_mps double, dist_along_route_m double, nearest_stop_seq long, ingested_at timestamp"
TABLES = {"observations": OBSERVATIONS, "probes": PROBES}
#: The folder of rows without a usable service date.
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class DayStore:
    """One writer a date at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables or TABLES

    def _manifest(self, day: str) -> str:
        return f"{self.path}/manifest/{day}.json"

    def versions(self, day: str) -> list[str]:
        text = read_text(self.spark, self._manifest(day))
        return json.loads(text)["versions"] if text else []

    def days(self, first: str | None = None, last: str | None = None) -> list[str]:
        """Dates with a manifest, in order; without bounds also rows without a date."""
        found = [x.removesuffix(".json") for x in children(self.spark, f"{self.path}/manifest") if x.endswith(".json")]
        return [x for x in found if (first is None or first <= x) and (last is None or x <= last) and (x != _NO_DATE or first is None and last is None)]

    def _stage(self, frames: dict[str, DataFrame], version: str) -> list[str]:
        """Writes every table, in order of route and trip within a date, and returns the dates that any has."""
        days = set()
        for name, schema in self.tables.items():
            columns = [x.split()[0] for x in schema.split(", ")]
            own = frames[name].select(*columns).repartition("service_date", F.pmod(F.xxhash64("route_id"), F.lit(8))).sortWithinPartitions("service_date", "route_id", "trip_id")
            own.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date", "version").parquet(f"{self.path}/{name}")
        for name in self.tables:
            days |= {x.removeprefix("service_date=") for x in children(self.spark, f"{self.path}/{name}") if x.startswith("service_date=") and f"version={version}" in children(self.spark, f"{self.path}/{name}/{x}")}
        return sorted(days)

    def add(self, frames: dict[str, DataFrame], version: str) -> list[str]:
        """Adds rows under a version's name; adding the same version again changes nothing but its rows. Returns the dates."""
        days = self._stage(frames, version)
        for day in days:
            known = self.versions(day)
            if version not in known:
                swap_text(self.spark, self._manifest(day), json.dumps({"service_date": day, "versions": [*known, version]}))
        return days

    def replace(self, frames: dict[str, DataFrame], today: dt.date | None = None, force: bool = False) -> dict[str, int]:
        """Replaces exactly the dates that frames have, in all tables; returns row counts.

        A table without rows is an error, and so is a date from today on, whose trips are still coming in, unless force says so.
        """
        frames = {name: frames[name] for name in self.tables}
        last = {name: f.agg(F.count("*"), F.max("service_date")).first() for name, f in frames.items()}
        counts = {name: n for name, (n, _) in last.items()}
        if not all(counts.values()):
            raise ValueError(f"refusing to replace a date with no rows: {counts}")
        latest = max((d for _, d in last.values() if d is not None), default=None)
        if not force and latest is not None and latest >= (today or dt.datetime.now(ZoneInfo(TZ)).date()):
            raise ValueError(f"refusing to replace {latest}, which is not over")
        version = f"day-{uuid.uuid4().hex}"
        for day in self._stage(frames, version):
            swap_text(self.spark, self._manifest(day), json.dumps({"service_date": day, "versions": [version]}))
        return counts

    def read(self, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """Rows of the named versions of a range of dates; only these folders are listed and read."""
        schema = self.tables[table]
        base = f"{self.path}/{table}"
        named = [f"{base}/service_date={day}/version={v}" for day in self.days(first, last) for v in self.versions(day)]
        there = {day: set(children(self.spark, f"{base}/service_date={day}")) for day in self.days(first, last)}
        paths = [x for x in named if x.rpartition("/")[2] in there[x.split("/service_date=")[-1].split("/")[0]]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, version string").option("basePath", base).parquet(*paths).drop("version")

    def compact(self, day: str) -> None:
        """Makes one version of a date's many."""
        if len(self.versions(day)) > 1:
            self.replace({name: self.read(name, day, day) for name in self.tables}, force=True)

    def clean(self, day: str) -> int:
        """Deletes a date's folders that its manifest doesn't name, once nobody reads them; returns how many."""
        keep, gone = {f"version={v}" for v in self.versions(day)}, 0
        for name in self.tables:
            for x in children(self.spark, f"{self.path}/{name}/service_date={day}"):
                if x.startswith("version=") and x not in keep:
                    delete(self.spark, f"{self.path}/{name}/service_date={day}/{x}")
                    gone += 1
        return gone
