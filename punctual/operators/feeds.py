"""Versions of a schedule, which of them holds on a date, and schedules expanded to days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.schedule import active_services

# fixed values: how far a version differs from the one before
INITIAL, IDENTICAL, FARES, SCHEDULE = "Initial archived snapshot", "Identical snapshot", "Fare tables only", "Schedule and route files"
FARE_FILES = ["fare_attributes.txt", "fare_rules.txt"]


def archive_hashes(members: DataFrame) -> DataFrame:
    """archive, content_sha256 of members (archive, member, sha256): the digest of names and digests in order of names."""
    named = F.array_sort(F.collect_list(F.struct("member", "sha256")))
    return members.groupBy("archive").agg(F.sha2(F.array_join(F.transform(named, lambda x: F.concat(x["member"], F.lit(":"), x["sha256"])), ""), 256).alias("content_sha256"))


def feed_versions(archives: DataFrame, force: Column | None = None) -> DataFrame:
    """archives (archive, content_sha256, ...) whose content differs from that of the archive before, or that force says to keep; the first one always counts."""
    before = F.lag("content_sha256").over(Window.orderBy("archive"))  # a row an archive
    return archives.withColumn("_before", before).where((F.col("_before").isNull() | (F.col("_before") != F.col("content_sha256"))) | (F.lit(False) if force is None else F.coalesce(force, F.lit(False)))).drop("_before")


def changed_members(members: DataFrame) -> DataFrame:
    """archive, member of what an archive added, dropped or changed against the one before it."""
    names = members.select("archive").distinct()
    pairs = names.withColumn("before", F.lag("archive").over(Window.orderBy("archive"))).where("before is not null")  # a row an archive
    new = members.join(pairs, "archive").select("archive", "member", F.col("sha256").alias("new"))
    old = members.withColumnRenamed("archive", "before").join(pairs, "before").select("archive", "member", F.col("sha256").alias("old"))
    return new.join(old, ["archive", "member"], "full").where(~F.col("new").eqNullSafe(F.col("old"))).select("archive", "member")


def feed_change_timeline(members: DataFrame) -> DataFrame:
    """archive, content_sha256, changed (members) and change_scope of each archive."""
    changed = changed_members(members).groupBy("archive").agg(F.count("*").alias("changed"), F.bool_and(F.col("member").isin(FARE_FILES)).alias("fares"))
    first = members.agg(F.min("archive").alias("first"))
    own = archive_hashes(members).join(changed, "archive", "left").crossJoin(first)  # one row
    scope = F.when(F.col("archive") == F.col("first"), INITIAL).when(F.col("changed").isNull(), IDENTICAL).when(F.col("fares"), FARES).otherwise(SCHEDULE)
    return own.select("archive", "content_sha256", F.coalesce("changed", F.lit(0)).alias("changed"), scope.alias("change_scope"))


def resolve_feed_for_date(dates: DataFrame, coverage: DataFrame, strict: bool = False) -> DataFrame:
    """service_date, feed: the current feed if it has active services on the date, else the newest archive that has; null, or an error if strict, if none has.

    coverage: feed, is_current, archived (order), service_date, services (how many are active).
    """
    order = Window.partitionBy("service_date").orderBy(F.desc("is_current"), F.desc("archived"))
    best = coverage.where("services > 0").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("service_date", "feed")
    out = dates.join(best, "service_date", "left")
    return out.withColumn("feed", F.coalesce("feed", F.raise_error(F.concat(F.lit("no feed for "), F.col("service_date"))))) if strict else out


def schedule_expand(dates: DataFrame, feeds: DataFrame, calendar: DataFrame, exceptions: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Every planned stop of every day: dates x active trips x stop times x stops, from the feed that covers the date, with scheduled hour, day type and band.

    feeds: feed, first_day, last_day. calendar, exceptions, trips, stop_times and stops have a column feed.
    """
    own = dates.join(F.broadcast(feeds), F.col("service_date").between(F.col("first_day"), F.col("last_day"))).select("service_date", "feed")  # a row a feed
    active = active_services(dates, calendar.withColumn("service_id", F.struct("feed", "service_id")), exceptions.withColumn("service_id", F.struct("feed", "service_id")))
    active = active.select("service_date", F.col("service_id.feed").alias("feed"), F.col("service_id.service_id").alias("service_id")).join(own, ["service_date", "feed"], "left_semi")
    running = active.join(trips, ["feed", "service_id"])
    out = running.join(stop_times, ["feed", "trip_id"]).join(stops, ["feed", "stop_id"])
    hour = F.floor(F.col("scheduled_s") / 3600) % 24
    return out.withColumns({"hour": hour.cast("int"), "day_type": c.day_type3(F.col("service_date")), "time_band": c.time_band(hour)})


def route_colors(routes: DataFrame, base: DataFrame) -> DataFrame:
    """base (with route_id) with color and text_color in upper case; white on nothing known, black for text."""
    shown = lambda x, other: F.when(F.coalesce(F.trim(F.col(x)), F.lit("")) == "", other).otherwise(F.upper(F.trim(F.col(x))))
    own = routes.dropDuplicates(["route_id"]).select("route_id", shown("route_color", "FFFFFF").alias("color"), shown("route_text_color", "000000").alias("text_color"))
    return base.join(own, "route_id", "left").fillna({"color": "FFFFFF", "text_color": "000000"})


def latest_snapshots(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """The rows of the n newest snapshots of each feed, ranked from the newest on. snapshots: feed, fetched_at, ..."""
    when = snapshots.select("feed", "fetched_at").distinct()
    newest = when.withColumn("rank", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("fetched_at")))).where(F.col("rank") <= n)
    return snapshots.join(newest, ["feed", "fetched_at"])


def active_route_ids(snapshots: DataFrame) -> DataFrame:
    """Routes that the newest snapshot of any feed names."""
    return latest_snapshots(snapshots).where("route_id is not null and route_id <> ''").select("route_id").distinct()


def dominant_shapes(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """By route and direction: the shape that most trips have, and of its trips one with the most stops; of equals the first by name.

    trips: trip_id, route_id, direction_id, shape_id. stop_times: trip_id, ...
    """
    line = ["route_id", "direction_id"]
    shapes = trips.groupBy(*line, "shape_id").agg(F.count("*").alias("trips"))
    best = shapes.withColumn("_n", F.row_number().over(Window.partitionBy(*line).orderBy(F.desc("trips"), "shape_id"))).where("_n = 1").drop("_n")
    length = stop_times.groupBy("trip_id").agg(F.count("*").alias("stops"))
    longest = trips.join(best, [*line, "shape_id"]).join(length, "trip_id").groupBy(*line, "shape_id", "trips").agg(F.min(F.struct((-F.col("stops")).alias("s"), "trip_id")).alias("x"))
    return longest.select(*line, "shape_id", "trips", F.col("x.trip_id").alias("trip_id"), (-F.col("x.s")).alias("stops"))


def slice_shape(segments: DataFrame, legs: DataFrame) -> DataFrame:
    """legs (leg_id, shape_id, from_m, to_m) with `points`, an array of (lon, lat) of the shape between the two distances, its ends interpolated.

    Null where less than two points come out, as of a leg of no length or beyond the shape.
    """
    own = legs.where("to_m > from_m").join(segments, "shape_id").where((F.col("along_m") + F.col("length_m") >= F.col("from_m")) & (F.col("along_m") <= F.col("to_m")))
    part = lambda m: F.when(F.col("length_m") > 0, (m - F.col("along_m")) / F.col("length_m")).otherwise(0.0)
    at = lambda t: F.struct((F.col("lon") + (F.col("lon2") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("lat2") - F.col("lat")) * t).alias("lat"))
    start, end = F.greatest(F.lit(0.0), part(F.col("from_m"))), F.least(F.lit(1.0), part(F.col("to_m")))
    cut = own.select("leg_id", "seg", at(start).alias("a"), at(end).alias("b"))
    each = cut.groupBy("leg_id").agg(F.sort_array(F.collect_list(F.struct("seg", "a", "b"))).alias("s"))
    points = F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda x: x["b"]))
    return legs.join(each.select("leg_id", points.alias("points")), "leg_id", "left")


def route_segment_features(shapes: DataFrame, stop_positions: DataFrame, segments: DataFrame, speeds: DataFrame) -> DataFrame:
    """The legs of each line's representative trip with their geometry and speed summary.

    shapes: dominant_shapes(). stop_positions: trip_id, stop_sequence, stop_id, stop_m. speeds: segment_speed().
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    own = shapes.join(stop_positions, "trip_id").withColumns({"from_stop": F.lag("stop_id").over(w), "from_m": F.lag("stop_m").over(w)}).where("from_stop is not null")
    legs = own.select("route_id", "direction_id", "shape_id", "stop_sequence", "from_stop", F.col("stop_id").alias("to_stop"), "from_m", F.col("stop_m").alias("to_m")).withColumn("leg_id", F.concat_ws("/", "route_id", "direction_id", "stop_sequence"))
    return slice_shape(segments, legs).join(speeds, ["route_id", "direction_id", "from_stop", "to_stop"], "left")
