"""Transit tables derived from the given tables, for Spark and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators import observations, trips
from punctual.plans.storage import stored_table
from punctual.sources.files import listing

ROUTES = ["1", "6", "12", "51A", "72", "99", "600", "F", "NL", "800", "701", "1T"]
STOP_M, LAT, STOPS = 352, 37.8, 7
TIES = ["l_partkey", "l_suppkey", "l_extendedprice"]
#: The study's periods, laid into the 28 days of the derived tables.
PERIODS = [("Baseline", "2026-05-17", "2026-05-30"), ("Summer", "2026-05-31", "2026-06-06"), ("Post-shift", "2026-06-07", "2026-06-13")]
HOLIDAYS = ["2026-05-25"]
#: Versions of the schedule, by first and last day.
FEEDS = [("F1", "2026-05-17", "2026-05-30"), ("F2", "2026-05-31", "2026-06-13")]
M_PER_LON = 111_194.92664455873 * math.cos(math.radians(LAT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trips(orders: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2026-05-17").cast("date"), F.pmod(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")), F.lit(28)))
    route = F.element_at(F.array(*map(F.lit, ROUTES)), (F.col("o_custkey") % 12 + 1).cast("int"))
    route = F.when(route.isin("99", "NL") & (F.col("o_orderkey") % 10 != 0), "6").otherwise(route)
    return orders.select("o_orderkey", day.alias("service_date"), route.alias("route_id"), (F.col("o_orderkey") % 2).alias("direction_id"), F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_custkey").cast("string").alias("vehicle_id"))


def _scheduled(key: str, seq: str):
    return c.plus_seconds(c.midnight(F.col("service_date")), 18_000 + F.col(key) * 7919 % 72_000 + (F.col(seq) - 1) * 300)


def scheduled_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(table(spark, sf_dir, "orders")).drop("o_orderkey", "vehicle_id")


#: Bytes of orders to a task of plan(), about two million stops.
_PLAN_BYTES = 4_000_000


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned stops. Trips are dealt to tasks before each becomes its stops, so that windows by trip and joins on trips move no stops."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(size for _, size, _ in listing(spark, f"{sf_dir}/orders.parquet")) // _PLAN_BYTES)
    own = _trips(table(spark, sf_dir, "orders")).repartition(tasks, "service_date", "trip_id").withColumn("stop_sequence", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(STOPS).cast("long"))))
    pickup = F.when((F.col("stop_sequence") == 4) & (F.col("o_orderkey") % 5 == 0), 1).otherwise(0)
    return own.withColumns({"stop_id": F.concat(F.lit("S"), F.col("stop_sequence")), "scheduled_arrival": _scheduled("o_orderkey", "stop_sequence"), "pickup_type": pickup}).drop("o_orderkey", "vehicle_id")


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as they came. What a row alone tells is worked out before the join, which is on the trip's id, so that its shuffle also serves windows by trip."""
    delay = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")), F.floor("l_extendedprice").cast("long") % 1200 - 200)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_linenumber").cast("long").alias("stop_sequence"), delay.alias("delay_seconds"), (F.col("l_discount") >= 0.095).alias("is_stale"), F.col("l_shipdate").alias("ingested_at"), *TIES)
    own = lines.repartition("trip_id").join(_trips(table(spark, sf_dir, "orders")), "trip_id")
    own = own.withColumns({"stop_id": F.concat(F.lit("S"), F.col("stop_sequence")), "scheduled_arrival": _scheduled("o_orderkey", "stop_sequence")})
    own = own.withColumn("actual_arrival", c.plus_seconds(F.col("scheduled_arrival"), F.col("delay_seconds")))
    return own.select("service_date", "route_id", "direction_id", "trip_id", "vehicle_id", "stop_sequence", "stop_id", "scheduled_arrival", "actual_arrival", "delay_seconds", "is_stale", "ingested_at", *TIES)


def derived_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated observations with legs. The join's shuffle serves both windows."""
    own = observations.dedup_observations(raw_observations(spark, sf_dir), TIES).drop(*TIES, "ingested_at")
    return observations.with_legs(own, F.col("stop_sequence") * STOP_M)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored observations. Tasks write their part of each date as they stand: a shuffle by date would move every row once more and, to sample its ranges, derive them twice."""
    return stored_table(spark, sf_dir, "observations", ["orders", "lineitem"], lambda: derived_observations(spark, sf_dir))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes from events, time 60 times as fast; a vehicle's sessions are its trips, 1.5 m/s on from the user's offset, on a street that runs east."""
    ts = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long"))
    own = trips.sessions(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("vehicle_id"), ts.alias("ts"), F.col("user_id").alias("u")))
    own = own.withColumn("trip_key", F.concat_ws("-", "vehicle_id", "session"))
    start = F.min(F.unix_micros("ts")).over(Window.partitionBy("trip_key"))
    return own.withColumn("dist_m", F.col("u") % 40 + 1.5 * ((F.unix_micros("ts") - start) / 1e6)).select("trip_key", "vehicle_id", "ts", "dist_m", "u")


def stored_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored probes: by the date on which their trip began, within it in order of trips, so that a trip's fixes lie in few row groups."""
    own = probes(spark, sf_dir).withColumn("service_date", F.min("ts").over(Window.partitionBy("trip_key")).cast("date"))
    return stored_table(spark, sf_dir, "probes", ["events"], lambda: own.repartitionByRange("service_date", "trip_key"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probes() as GPS fixes, some metres off the street."""
    return probes(spark, sf_dir).select("trip_key", "vehicle_id", "ts", (LAT + F.col("u") % 7 * 1e-4).alias("plat"), (F.lit(-122.0) + F.col("dist_m") / M_PER_LON).alias("plon"), "u")


def street(spark: SparkSession) -> DataFrame:
    """The shape EW: a point at each of 42 stops along the street, from west to east."""
    return spark.range(42).select(F.lit("EW").alias("shape_id"), F.col("id").alias("seq"), F.lit(LAT).alias("lat"), (F.lit(-122.0) + F.col("id") * STOP_M / M_PER_LON).alias("lon"))


def probe_trips(probes: DataFrame) -> DataFrame:
    """trip_key, shape_id; the trips of one vehicle in five have no known shape."""
    return probes.where("u % 5 <> 0").select("trip_key", F.lit("EW").alias("shape_id")).distinct()


def probe_plan(probes: DataFrame, stops: int = 10) -> DataFrame:
    """Planned stops of the trips with a shape: 200 seconds from one to the next, from the trip's first fix on."""
    own = probes.where("u % 5 <> 0").groupBy("trip_key").agg(F.min(F.unix_micros("ts")).alias("t0")).withColumn("stop_sequence", F.explode(F.sequence(F.lit(1), F.lit(stops))))
    return own.select("trip_key", "stop_sequence", (F.col("stop_sequence") * float(STOP_M)).alias("stop_m"), (F.col("t0") + F.col("stop_sequence") * 200_000_000).alias("scheduled_us"))


def stop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k")).distinct()
    name = F.when(F.col("k") <= 6, F.concat(F.lit("Broadway & "), F.col("k"), F.lit("th St"))).otherwise("College Av & Main (far side)")
    return own.select(F.concat(F.lit("S"), "k").alias("stop_id"), name.alias("stop_name"), (37.79 + 0.004 * F.col("k")).alias("lat"))


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "S3", "S4", "third crossing"), (1, "S4", "S5", "fourth crossing")], "direction_id long, from_stop string, to_stop string, target_label string")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of the timetable in both versions of the schedule: feed, trip_id, route, direction, service and shape."""
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("t")).distinct().withColumn("feed", F.explode(F.array(*[F.lit(f[0]) for f in FEEDS]))).where("feed = 'F1' or t % 5 <> 0")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("t") % n + 1).cast("int"))
    return own.select("feed", "t", F.concat(F.lit("T"), "t").alias("trip_id"), pick(ROUTES, 12).alias("route_id"), (F.col("t") % 2).alias("direction_id"), pick(["WKDY", "SAT", "SUN"], 3).alias("service_id"), F.concat(F.lit("H"), F.floor(F.col("t") / 12) % 4).alias("shape_id"))


def stop_times(templates: DataFrame) -> DataFrame:
    """Trips of three in seven end a stop early."""
    own = templates.withColumn("stop_sequence", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(STOPS).cast("long")))).where("stop_sequence < 7 or t % 7 > 2")
    return own.select("feed", "trip_id", "stop_sequence", F.concat(F.lit("S"), "stop_sequence").alias("stop_id"), (18_000 + F.col("t") * 7919 % 72_000 + (F.col("stop_sequence") - 1) * 300).alias("scheduled_s"))


def calendar(templates: DataFrame) -> DataFrame:
    own = templates.select("feed", "service_id").distinct()
    days = {"WKDY": range(1, 6), "SAT": [6], "SUN": [0]}
    flag = lambda k: F.when(F.col("service_id").isin([s for s, on in days.items() if k in on]), 1).otherwise(0)
    return own.withColumns({**{d: flag(k) for k, d in enumerate(["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"])}, "start_date": F.lit("2026-05-17").cast("date"), "end_date": F.lit("2026-06-13").cast("date")})


def calendar_exceptions(templates: DataFrame) -> DataFrame:
    """On the holiday weekday service is removed and Sunday service added."""
    own = templates.where("service_id in ('WKDY', 'SUN')").select("feed", "service_id").distinct()
    return own.withColumns({"service_date": F.lit(HOLIDAYS[0]).cast("date"), "exception_type": F.when(F.col("service_id") == "WKDY", 2).otherwise(1)})


def feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEEDS, "feed string, first_day string, last_day string").withColumns({x: F.col(x).cast("date") for x in ("first_day", "last_day")})


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive (a month), member, sha256: schedule files change twice a year, fare files with the month's orders."""
    own = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("archive"), (F.col("o_orderkey") % 5).alias("k"))
    member = F.element_at(F.array(*[F.lit(f"{x}.txt") for x in ("stops", "trips", "stop_times", "fare_rules", "fare_attributes")]), (F.col("k") + 1).cast("int"))
    month = F.substring("archive", 5, 2).cast("int")
    counted = own.groupBy("archive", "k").agg(F.count("*").alias("n")).withColumn("member", member)
    content = F.when(F.col("k") < 3, F.concat(F.substring("archive", 1, 4), F.lit("/"), F.floor((month - 1) / 6))).otherwise(F.concat(F.lit("fares "), F.floor(F.col("n") % 4 / 3)))
    return counted.select("archive", "member", F.sha2(content, 256).alias("sha256"))


def feed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, is_current, archived, service_date, services: the current version has none on weekends."""
    own = _trips(table(spark, sf_dir, "orders")).withColumn("f", F.col("o_orderkey") % 4)
    runs = F.count_if((F.col("vehicle_id").cast("long") % 3 == 0) & ((F.col("f") < 3) | ~F.dayofweek("service_date").isin(1, 7)))
    return own.groupBy("f", "service_date").agg(runs.alias("services")).select(F.concat(F.lit("V"), "f").alias("feed"), (F.col("f") == 3).alias("is_current"), F.col("f").alias("archived"), "service_date", "services")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, fetched_at (an hour), vehicle_id, route_id of events; one vehicle in seven names no route."""
    own = table(spark, sf_dir, "events")
    route = F.when(F.col("user_id") % 7 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, ROUTES)), (F.col("user_id") % 12 + 1).cast("int")))
    return own.select(F.concat(F.lit("feed"), F.col("user_id") % 3).alias("feed"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("fetched_at"), F.col("user_id").cast("string").alias("vehicle_id"), route.alias("route_id"))


def probe_stops(probes: DataFrame) -> DataFrame:
    own = probes.select("trip_key").distinct().withColumn("stop_sequence", F.explode(F.sequence(F.lit(1), F.lit(40))))
    return own.withColumn("stop_m", F.col("stop_sequence") * float(STOP_M))


_ROUTE = f"(array[{', '.join(repr(r) for r in ROUTES)}])[(o_custkey % 12 + 1)::INT]"
SQL = f"""WITH trips0 AS (SELECT o_orderkey, date '2026-05-17' + (((date_diff('day', date '1995-01-01', o_orderdate::DATE) % 28) + 28) % 28)::INT AS service_date, {_ROUTE} AS r, o_orderkey % 2 AS direction_id, o_orderkey::VARCHAR AS trip_id, o_custkey::VARCHAR AS vehicle_id FROM orders),
trips AS (SELECT * EXCLUDE (r), CASE WHEN r IN ('99', 'NL') AND o_orderkey % 10 <> 0 THEN '6' ELSE r END AS route_id FROM trips0),
plan AS (SELECT service_date, route_id, direction_id, trip_id, s::BIGINT AS stop_sequence, 'S' || s AS stop_id, epoch(service_date::TIMESTAMP)::BIGINT + 25200 + 18000 + o_orderkey * 7919 % 72000 + (s - 1) * 300 AS sched_s, CASE WHEN s = 4 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS pickup_type FROM trips, unnest(range(1, {STOPS + 1})) AS u(s)),
raw AS (SELECT service_date, route_id, direction_id, trip_id, vehicle_id, l_linenumber::BIGINT AS stop_sequence, 'S' || l_linenumber AS stop_id, epoch(service_date::TIMESTAMP)::BIGINT + 25200 + 18000 + l_orderkey * 7919 % 72000 + (l_linenumber - 1) * 300 AS sched_s,
  CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') THEN floor(l_extendedprice)::BIGINT % 1200 - 200 END AS delay_seconds, l_discount >= 0.095 AS is_stale, l_shipdate AS ingested_at, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN trips ON l_orderkey = o_orderkey),
dedup AS (SELECT *, sched_s + delay_seconds AS act_s FROM raw QUALIFY row_number() OVER (PARTITION BY service_date, trip_id, stop_sequence ORDER BY delay_seconds IS NULL, ingested_at DESC, l_partkey, l_suppkey, l_extendedprice) = 1),
leg0 AS (SELECT *, CASE WHEN act_s IS NOT NULL THEN last_value(CASE WHEN act_s IS NOT NULL THEN {{'m': stop_sequence, 't': act_s}} END IGNORE NULLS) OVER (PARTITION BY service_date, trip_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prev FROM dedup),
obs AS (SELECT *, CASE WHEN (stop_sequence - prev.m) > 0 AND act_s - prev.t > 0 THEN ((stop_sequence - prev.m) * {STOP_M})::DOUBLE / (act_s - prev.t)::DOUBLE END AS v, ((act_s - 25200) // 3600) % 24 AS hour, dayofweek(service_date) + 1 AS dow,
  CASE WHEN dayofweek(service_date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type, service_date - dayofweek(service_date)::INT AS week_start,
  CASE WHEN route_id IN ('701', '702', '703') THEN 'Early Bird' WHEN route_id IN ('800', '801', '802', '805', '840', '851') THEN 'All Nighter' WHEN regexp_full_match(route_id, '[0-9]+') AND try_cast(route_id AS BIGINT) BETWEEN 600 AND 699 THEN 'School' WHEN route_id IN ('E', 'F', 'FS', 'G', 'J', 'L', 'NL', 'NX', 'NX3', 'O', 'P', 'U', 'V', 'W') THEN 'Transbay' ELSE 'Local / other' END AS route_group FROM leg0),
arr AS (SELECT * FROM obs WHERE act_s IS NOT NULL), fresh AS (SELECT * FROM arr WHERE NOT is_stale)
"""
SQL_PERIOD = "CASE " + " ".join(f"WHEN service_date BETWEEN date '{a}' AND date '{b}' THEN '{name}'" for name, a, b in PERIODS) + " END"
