"""Queries that run as streams over events, to their end, each with its SQL.

What is still open when the stream ends is left out by both: windows and trips that the watermark, 20 minutes behind the last event, has not passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators import trips
from punctual.plans import fixtures as fx
from punctual.plans.more_queries import alone
from punctual.plans.storage import new_folder
from punctual.sources.files import children
from punctual.streaming import live, tracking

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENTS = "WITH ev AS (SELECT user_id AS u, user_id::VARCHAR AS vehicle_id, (epoch_us(ts) // 60)::BIGINT AS us FROM events), wm AS (SELECT max(us) - 1200000000 AS w FROM ev)"
#: Trips of a vehicle: the hours of its (60 times as fast) events.
_TRIPS = _EVENTS + """, tr AS (SELECT vehicle_id, vehicle_id || '-' || (us // 3600000000) AS trip_id, min(us) AS first_us, max(us) AS last_us, count(DISTINCT us) AS probes FROM ev GROUP BY 1, 2),
ls AS (SELECT *, lead(first_us) OVER (PARTITION BY vehicle_id ORDER BY first_us) AS next_us FROM tr)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vehicle_id, u, ts of a stream of events."""
    schema = fx.table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    single = children(spark, path) == ["events.parquet"]  # a table of one file: a stream reads folders
    own = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if single else "*.parquet").parquet(sf_dir if single else path)
    return own.select(F.col("user_id").cast("string").alias("vehicle_id"), F.col("user_id").alias("u"), F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long")).alias("ts"))


def _finished(stream: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of a stream that is run to its end, and its checkpoint."""
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, name)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    if run.exception():
        raise run.exception()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows"), f"{path}/checkpoint"


def _ended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Ended trips of events as positions of trips that nobody planned."""
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    nothing = {"lat": F.lit(fx.LAT), "lon": F.lit(-122.0), "bearing": F.lit(None).cast("double"), "speed": F.lit(None).cast("double")}
    own = _events(spark, sf_dir).select("vehicle_id", F.concat_ws("-", "vehicle_id", hour).alias("trip_id"), F.lit("1").alias("route_id"), F.col("ts").cast("date").alias("service_date"), "ts", F.col("ts").alias("seen")).withColumns(nothing)
    known = spark.createDataFrame([], "trip_id string, shape_id string")
    stops = spark.createDataFrame([], "trip_id string, stop_sequence int, stop_m double")
    return _finished(tracking.ended_trips(tracking.with_plan(tracking.cleaned(own), known, trips.shape_segments(fx.street(spark)), stops)), "ended-trips")


@alone(_TRIPS + " SELECT vehicle_id, trip_id, first_us, last_us, probes, CASE WHEN next_us IS NOT NULL THEN 'preempted' ELSE 'stale' END AS reason FROM ls, wm WHERE next_us IS NOT NULL OR last_us + 1200000000 <= w")
def live_trips(spark, sf_dir):
    found = tracking.stateful_trips(_ended(spark, sf_dir)[0])
    return found.select("vehicle_id", "trip_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "probes", "reason")


@alone(_TRIPS + " SELECT count(*) AS vehicles_in_flight, count(*) FILTER (last_us < (SELECT max(us) FROM ev) - 1200000000) AS stuck_trips, 0::BIGINT AS ended_marks FROM ls, wm WHERE next_us IS NULL AND last_us + 1200000000 > w")
def live_gauges(spark, sf_dir):
    """Gauges of the state at the stream's end, 20 minutes before which no trip should have been seen last."""
    _, checkpoint = _ended(spark, sf_dir)
    now = F.max((F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long"))
    return tracking.live_gauges(spark, checkpoint, fx.table(spark, sf_dir, "events").agg(now).first()[0])


@alone(_EVENTS + f" SELECT (array[{', '.join(repr(x) for x in fx.ROUTES)}])[(u % 12 + 1)::INT] AS route_id, us // 900000000 AS quarter, count(*) AS n FROM ev, wm WHERE (us // 900000000 + 1) * 900000000 <= w GROUP BY 1, 2")
def live_volume_15min(spark, sf_dir):
    route = F.element_at(F.array(*map(F.lit, fx.ROUTES)), (F.col("u") % 12 + 1).cast("int"))
    rows, _ = _finished(live.live_volume_15min(_events(spark, sf_dir).select(route.alias("route_id"), "ts")), "volume")
    return rows.select("route_id", F.floor(F.unix_micros("start") / 900_000_000).alias("quarter"), "n")


@alone(_EVENTS + """, nw AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY us) AS k FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY vehicle_id ORDER BY us) >= 1200000000 THEN 1 ELSE 0 END AS fresh FROM ev)),
ss AS (SELECT vehicle_id, min(us) AS first_us, max(us) AS last_us, count(*) AS probes FROM nw GROUP BY vehicle_id, k) SELECT ss.* FROM ss, wm WHERE last_us + 1200000000 <= w""")
def live_sessions(spark, sf_dir):
    rows, _ = _finished(live.session_trips(_events(spark, sf_dir).select("vehicle_id", "ts")), "sessions")
    return rows.select("vehicle_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "probes")
