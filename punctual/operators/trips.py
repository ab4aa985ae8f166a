"""From GPS fixes to trips, and from trips to arrivals at stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c

STALE_S, TOLERANCE_M = 20 * 60, 150.0


def reconstruct_trips(positions: DataFrame) -> DataFrame:
    """Fixes (vehicle_id, trip_id, ts, ...) without repeats of an instant, with the trip's first and last instant, and route and service date as of its first fix."""
    key = ["vehicle_id", "trip_id"]
    rest = [x for x in positions.columns if x not in (*key, "ts")]
    # one shuffle: both windows are within a vehicle's trip
    own = positions.repartition(*key).withColumn("_n", F.row_number().over(Window.partitionBy(*key, "ts").orderBy(*rest))).where("_n = 1").drop("_n")
    trip = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {x: F.first(x).over(trip) for x in ("route_id", "service_date") if x in positions.columns}
    return own.withColumns({"first_seen": F.first("ts").over(trip), "last_seen": F.last("ts").over(trip), **first})


def sessions(positions: DataFrame, gap_s: int = STALE_S) -> DataFrame:
    """positions with session: a vehicle's fixes without a gap of more than gap_s seconds, numbered from 0.

    Fixes are ordered within a vehicle's day; the last fix before the day and the sessions begun before it come from one row a
    day, so that no task sorts a vehicle's whole history.
    """
    day, us = F.col("ts").cast("date"), F.unix_micros("ts")
    own = positions.withColumn("_day", day)
    days = own.groupBy("vehicle_id", "_day").agg(F.max(us).alias("_last"))
    ends = days.withColumn("_carried", F.lag("_last").over(Window.partitionBy("vehicle_id").orderBy("_day"))).drop("_last")
    w = Window.partitionBy("vehicle_id", "_day").orderBy("ts")
    before = F.coalesce(F.lag(us).over(w), F.col("_carried"))
    new = F.when(((us - before) / 1_000_000).cast("long") > gap_s, 1).otherwise(0)
    marked = own.join(ends, ["vehicle_id", "_day"]).withColumn("_new", new).withColumn("_within", F.sum("_new").over(w))
    upto = marked.groupBy("vehicle_id", "_day").agg(F.sum("_new").alias("_begun")).withColumn("_ahead", F.coalesce(F.sum("_begun").over(Window.partitionBy("vehicle_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(upto.select("vehicle_id", "_day", "_ahead"), ["vehicle_id", "_day"]).withColumn("session", F.col("_within") + F.col("_ahead")).drop("_day", "_carried", "_new", "_within", "_ahead")


def shape_segments(points: DataFrame) -> DataFrame:
    """shape_id, seg, ends and distance along the shape of each segment, from points (shape_id, seq, lat, lon)."""
    w = Window.partitionBy("shape_id").orderBy("seq")
    own = points.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w), "seg": F.row_number().over(w), "lat0": F.first("lat").over(w)})
    own = own.where("lat2 is not null").withColumn("length_m", c.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("along_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0))).select("shape_id", "seg", "lat", "lon", "lat2", "lon2", "lat0", "length_m", "along_m")


#: Metres a degree of a great circle; width of a cell in degrees; metres around a segment in which cells list it.
M_PER_DEGREE, CELL, REACH_M = 111_194.92664455873, 0.001, 60.0


def nearest_on(segments: Column, lat: Column, lon: Column) -> Column:
    """off2 (squared distance), seg and dist_m (along the shape) of the nearest of an array of segments, the first of equals; null if there are none."""

    def of(s: Column) -> Column:
        east = F.cos(F.radians(s["lat0"]))
        x = lambda a, b: ((a - s["lon"]) * east * M_PER_DEGREE, (b - s["lat"]) * M_PER_DEGREE)
        (px, py), (sx, sy) = x(lon, lat), x(s["lon2"], s["lat2"])
        squared = sx * sx + sy * sy
        t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * sx + py * sy) / squared))).otherwise(0.0)
        off2 = (px - t * sx) * (px - t * sx) + (py - t * sy) * (py - t * sy)
        return F.struct(off2.alias("off2"), s["seg"].alias("seg"), (s["along_m"] + t * s["length_m"]).alias("dist_m"))

    return F.array_min(F.transform(segments, of))


_SEGMENT = ("seg", "lat", "lon", "lat2", "lon2", "lat0", "length_m", "along_m")


def cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL)


def segment_index(segments: DataFrame) -> DataFrame:
    """shape_id, _cell_y, _cell_x, _near: for each cell of a grid the segments within REACH_M of any of its points (and a few more).

    A segment is listed row by row of the grid, along its own course there, so that a long one does not fill its bounding box.
    """
    reach = (REACH_M + 1) / M_PER_DEGREE
    across = reach / F.cos(F.radians("lat0"))
    south, north = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    rows = segments.withColumn("_cell_y", F.explode(F.sequence(cell(south - reach), cell(north + reach))))
    # the part of the segment that is within reach of this row
    low, high = F.greatest(F.col("_cell_y") * CELL - reach, south), F.least((F.col("_cell_y") + 1) * CELL + reach, north)
    slope = (F.col("lon2") - F.col("lon")) / F.nullif(F.col("lat2") - F.col("lat"), F.lit(0.0))
    at = lambda y: F.col("lon") + (y - F.col("lat")) * slope
    west, east = F.least(F.coalesce(at(low), F.col("lon")), F.coalesce(at(high), F.col("lon2"))), F.greatest(F.coalesce(at(low), F.col("lon")), F.coalesce(at(high), F.col("lon2")))
    cells = rows.withColumn("_cell_x", F.explode(F.sequence(cell(west - across), cell(east + across))))
    return cells.groupBy("shape_id", "_cell_y", "_cell_x").agg(F.collect_list(F.struct(*_SEGMENT)).alias("_near"))


def place_points(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (shape_id, plat, plon, ...) with dist_m along their shape and off_m from it, by the nearest segment (the first of equals).

    A point meets the segments that its cell lists, as one row; if none of them is within REACH_M, the whole shape, again as one row. So rows
    are never multiplied, and the shuffle of a large index is by shape and cell. A shape of fewer than two points, or none, gives 0 and 0.
    """
    mark = "_at"
    own = points.withColumns({"_cell_y": cell(F.col("plat")), "_cell_x": cell(F.col("plon"))})
    own = own.join(segment_index(segments), ["shape_id", "_cell_y", "_cell_x"], "left").withColumn(mark, nearest_on(F.col("_near"), F.col("plat"), F.col("plon"))).drop("_near", "_cell_y", "_cell_x")
    far = F.col(f"{mark}.off2").isNull() | (F.col(f"{mark}.off2") > REACH_M * REACH_M)
    whole = segments.groupBy(F.struct("shape_id", F.lit(0).cast("long").alias("_")).alias("_shape")).agg(F.collect_list(F.struct(*_SEGMENT)).alias("_all"))
    # points that are placed go to keys that no shape has, spread by place
    own = own.withColumn("_shape", F.when(far, F.struct("shape_id", F.lit(0).cast("long").alias("_"))).otherwise(F.struct("shape_id", (F.abs(F.xxhash64("plat", "plon") % 1000) + 1).alias("_"))))
    own = own.join(whole, "_shape", "left").withColumn(mark, F.when(F.col("_all").isNull(), F.col(mark)).otherwise(nearest_on(F.col("_all"), F.col("plat"), F.col("plon"))))
    return own.withColumns({"dist_m": F.coalesce(F.col(f"{mark}.dist_m"), F.lit(0.0)), "off_m": F.coalesce(F.sqrt(f"{mark}.off2"), F.lit(0.0))}).drop(mark, "_all", "_shape")


def project_points(points: DataFrame, segments: DataFrame, key: str = "point_id") -> DataFrame:
    """key, shape_id, dist_m and off_m of points (key, shape_id, plat, plon), a row each, as place_points() finds them."""
    return place_points(points.select(key, "shape_id", "plat", "plon"), segments).select(key, "shape_id", "dist_m", "off_m")


def detect_arrivals(probes: DataFrame, stops: DataFrame) -> DataFrame:
    """trip_key, stop_sequence, arrived_us: when a trip passed each stop, if a fix from before it was seen.

    probes: trip_key, ts, dist_m. stops: trip_key, stop_sequence, stop_m. The first fix at or past the stop and the one before it
    are interpolated in whole microseconds. A fix meets only stops between the furthest fix before it and itself, so a stop
    comes out of the join once.
    """
    w = Window.partitionBy("trip_key").orderBy("ts")
    us = F.unix_micros("ts")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    own = probes.select("trip_key", us.alias("us"), "dist_m", F.lag("dist_m").over(w).alias("d0"), F.lag(us).over(w).alias("us0"), F.max("dist_m").over(earlier).alias("furthest"))
    own = own.where("d0 is not null and dist_m > furthest")
    crossed = own.join(stops, "trip_key").where((F.col("stop_m") > F.col("furthest")) & (F.col("stop_m") <= F.col("dist_m")))
    at = F.col("us0") + F.floor((F.col("us") - F.col("us0")) * ((F.col("stop_m") - F.col("d0")) / (F.col("dist_m") - F.col("d0"))))
    return crossed.select("trip_key", "stop_sequence", at.cast("long").alias("arrived_us"))


def furthest_fix(probes: DataFrame) -> DataFrame:
    """trip_key, far_m, far_us: how far a trip was seen to come, and when first."""
    far = F.max_by(F.struct("dist_m", F.unix_micros("ts").alias("us")), F.struct("dist_m", -F.unix_micros("ts")))
    return probes.groupBy("trip_key").agg(far.alias("far")).select("trip_key", F.col("far.dist_m").alias("far_m"), F.col("far.us").alias("far_us"))


def trailing_stops(furthest: DataFrame, stops: DataFrame, arrivals: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """Arrivals for the last stops of a trip that lie within tolerance of its furthest fix (trip_key, far_m, far_us), at that fix's instant.

    From the last stop back, up to the first that has an arrival or is out of tolerance.
    """
    own = stops.join(furthest, "trip_key").join(arrivals.select("trip_key", "stop_sequence", F.lit(True).alias("known")), ["trip_key", "stop_sequence"], "left")
    ok = F.when(F.col("known").isNull() & (F.abs(F.col("stop_m") - F.col("far_m")) <= tolerance_m), 1).otherwise(0)
    back = Window.partitionBy("trip_key").orderBy(F.desc("stop_sequence"))
    return own.withColumn("run", F.min(ok).over(back)).where("run = 1").select("trip_key", "stop_sequence", F.col("far_us").alias("arrived_us"))


def trailing_fallback(probes: DataFrame, stops: DataFrame, arrivals: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """trailing_stops() of the trips of probes."""
    return trailing_stops(furthest_fix(probes), stops, arrivals, tolerance_m)


def project_stops(stops: DataFrame, segments: DataFrame) -> DataFrame:
    """stops (shape_id, stop_id, plat, plon, ...) with stop_m along their shape; each shape and stop is projected once, however many trips have them."""
    once = stops.select("shape_id", "stop_id", "plat", "plon").dropDuplicates(["shape_id", "stop_id"])
    found = project_points(once, segments, "stop_id").select("shape_id", "stop_id", F.col("dist_m").alias("stop_m"))
    return stops.join(found, ["shape_id", "stop_id"])


def stops_of_trip(stops: DataFrame, key: str = "trip_key") -> DataFrame:
    """key, stops: a trip's stops in order, as one row."""
    return stops.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("stop_sequence"), F.col("stop_m").cast("double").alias("stop_m")))).alias("stops"))


def nearest_in(stops: Column, dist_m: Column) -> Column:
    """Sequence of the stop that is nearest along the shape, the first of equals."""
    return F.array_min(F.transform(stops, lambda s: F.struct(F.abs(s["stop_m"] - dist_m).alias("gap"), s["stop_m"].alias("stop_m"), s["stop_sequence"].alias("stop_sequence"))))["stop_sequence"]


def nearest_stop(fixes: DataFrame, stops: DataFrame, key: str = "point_id") -> DataFrame:
    """key, nearest_stop_seq of fixes (key, trip_key, dist_m) whose trip has stops."""
    near = fixes.select(key, "trip_key", "dist_m").join(stops_of_trip(stops), "trip_key")
    return near.select(key, nearest_in(F.col("stops"), F.col("dist_m")).alias("nearest_stop_seq"))


def project_probes(fixes: DataFrame, trips: DataFrame, segments: DataFrame, stops: DataFrame) -> DataFrame:
    """fixes (trip_key, plat, plon, ...) with dist_m and nearest_stop_seq, null for trips that have no known shape; a row each.

    trips: trip_key, shape_id. stops: trip_key, stop_sequence, stop_m.
    """
    known = segments.select("shape_id").distinct().join(trips, "shape_id").select("trip_key", "shape_id")
    own = place_points(fixes.join(known, "trip_key", "left"), segments).drop("off_m")
    own = own.withColumn("dist_m", F.when(F.col("shape_id").isNotNull(), F.col("dist_m"))).drop("shape_id")
    return own.join(stops_of_trip(stops), "trip_key", "left").withColumn("nearest_stop_seq", nearest_in(F.col("stops"), F.col("dist_m"))).drop("stops")


def observation_rows(stops: DataFrame, arrivals: DataFrame) -> DataFrame:
    """A row for each planned stop of the trips in arrivals' table: arrival, delay and the leg since the last stop with an arrival.

    stops: trip_key, stop_sequence, stop_m, scheduled_us. arrivals: trip_key, stop_sequence, arrived_us. Trips that the plan doesn't know give no rows.
    """
    own = stops.join(arrivals, ["trip_key", "stop_sequence"], "left")
    before = Window.partitionBy("trip_key").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("arrived_us").isNotNull(), F.struct("stop_m", "arrived_us")), ignorenulls=True).over(before)
    own = own.withColumn("_last", F.when(F.col("arrived_us").isNotNull(), last))
    d, s = F.col("stop_m") - F.col("_last.stop_m"), (F.col("arrived_us") - F.col("_last.arrived_us")) / 1_000_000
    ok = (d > 0) & (s > 0)
    delay = ((F.col("arrived_us") - F.col("scheduled_us")) / 1_000_000).cast("long")
    return own.withColumns({"delay_seconds": delay, "leg_distance_m": F.when(ok, d), "leg_duration_s": F.when(ok, s), "leg_avg_speed_mps": F.when(ok, d / s)}).drop("_last")


def probe_rows(fixes: DataFrame, ingested_at: Column) -> DataFrame:
    """Fixes as they are stored: a bearing, speed or nearest stop of 0 is not known."""
    return fixes.withColumns({"bearing_deg": c.zero_to_null(F.col("bearing_deg")), "reported_speed_mps": c.zero_to_null(F.col("reported_speed_mps")), "nearest_stop_seq": F.nullif("nearest_stop_seq", F.lit(0)), "ingested_at": ingested_at})


def stored_observations(rows: DataFrame, ingested_at: Column) -> DataFrame:
    """Rows of observation_rows() (with service_date, route_id, trip_id, vehicle_id, is_stale) in the columns in which they are stored."""
    at = lambda x: F.timestamp_micros(F.col(x))
    return rows.select("service_date", "route_id", "trip_id", "vehicle_id", F.col("stop_sequence").cast("long").alias("stop_sequence"), "stop_id", at("scheduled_us").alias("scheduled_arrival"), at("arrived_us").alias("actual_arrival"), "delay_seconds", "leg_distance_m", "leg_duration_s", "leg_avg_speed_mps", "is_stale", ingested_at.alias("ingested_at"))


def stored_probes(placed: DataFrame, ingested_at: Column) -> DataFrame:
    """Fixes (service_date, route_id, trip_id, vehicle_id, ts, lat, lon, bearing, speed, dist_m, nearest_stop_seq) in the columns in which they are stored."""
    own = placed.select("service_date", "route_id", "trip_id", "vehicle_id", F.col("ts").alias("observed_at"), "lat", "lon", F.col("bearing").alias("bearing_deg"), F.col("speed").alias("reported_speed_mps"), F.col("dist_m").alias("dist_along_route_m"), F.col("nearest_stop_seq").cast("long").alias("nearest_stop_seq"))
    return probe_rows(own, ingested_at)


def trip_end_reason(seen: DataFrame, last_stops: DataFrame, stale_s: int = STALE_S) -> DataFrame:
    """seen (vehicle_id, trip_key, first_us, last_us) with reason and is_stale.

    completed: the last stop has an arrival (last_stops: trip_key). Else preempted, if the vehicle's next trip begins within
    stale_s of the last fix, else stale.
    """
    after = F.lead("first_us").over(Window.partitionBy("vehicle_id").orderBy("first_us", "trip_key"))
    own = seen.withColumn("_next", after).join(last_stops.select("trip_key", F.lit(True).alias("_done")).distinct(), "trip_key", "left")
    reason = F.when(F.col("_done"), "completed").when(F.col("_next") - F.col("last_us") <= stale_s * 1_000_000, "preempted").otherwise("stale")
    return own.withColumn("reason", reason).withColumn("is_stale", F.col("reason") == "stale").drop("_next", "_done")


def finalized(fixes: DataFrame, trips: DataFrame, segments: DataFrame, stops: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """Observation rows from fixes (trip_key, vehicle_id, ts, plat, plon): projected, crossings found, last stops filled in, with the trip's end: only an arrival that was seen at the last stop completes a trip.

    trips: trip_key, shape_id. stops: trip_key, stop_sequence, stop_m, scheduled_us.
    """
    placed = project_probes(fixes, trips, segments, stops).where("dist_m is not null").select("trip_key", "vehicle_id", "ts", "dist_m")
    found = detect_arrivals(placed, stops)
    arrivals = found.unionByName(trailing_fallback(placed, stops, found, tolerance_m))
    seen = placed.groupBy("vehicle_id", "trip_key").agg(F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    last = stops.groupBy("trip_key").agg(F.max("stop_sequence").alias("stop_sequence")).join(found, ["trip_key", "stop_sequence"], "left_semi")
    ended = trip_end_reason(seen, last).select("trip_key", "vehicle_id", "is_stale")
    return observation_rows(stops.join(seen.select("trip_key").distinct(), "trip_key", "left_semi"), arrivals).join(ended, "trip_key")


def replay_trip(probes: DataFrame, service_date: Column, trip: Column) -> DataFrame:
    """The stored fixes of one trip in time order. Both conditions are on bare columns: only the date's partition is read, and of it the row groups that may hold the trip."""
    return probes.where((F.col("service_date") == service_date) & (F.col("trip_key") == trip)).orderBy("ts")
