"""Study of one corridor: how long its segments take, against free running, and how complete the record is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c

SEGMENT = ["direction_id", "segment_id"]
BANDED = [*SEGMENT, "day_type", "time_band"]
EARLY_LABEL, SHARE_LABEL = "weekday 5-7 a.m. median", "15th percentile"


def _at(x: str, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def with_bands(segs: DataFrame, holidays: list[str] | None = None) -> DataFrame:
    """segments() with segment_id, hour, band and day type; hour and band are of the arrival at the upstream stop."""
    hour = c.local_hour(F.col("actual_arrival"))
    return segs.withColumns({"segment_id": F.concat_ws("-", "from_stop", "to_stop"), "hour": hour, "time_band": c.time_band(hour), "day_type": c.day_type3(F.col("service_date"), holidays)})


def corridor_filter(segs: DataFrame, stops: DataFrame, street: str, least_lat: float, targets: DataFrame) -> DataFrame:
    """Segments both ends of which have the street in their name and lie at least_lat or farther north, with the label of target segments.

    stops: stop_id, stop_name, lat. targets: direction_id, from_stop, to_stop, target_label.
    """
    inside = stops.where(F.col("stop_name").contains(street) & (F.col("lat") >= least_lat))
    end = lambda k: F.broadcast(inside.select(F.col("stop_id").alias(f"{k}_stop"), c.short_stop_name(F.col("stop_name")).alias(f"{k}_name")))  # noqa: E731  # stops of one street
    own = segs.join(end("from"), "from_stop").join(end("to"), "to_stop").join(F.broadcast(targets), ["direction_id", "from_stop", "to_stop"], "left")  # a handful
    return own.withColumns({"segment_label": F.concat_ws(" > ", "from_name", "to_name"), "is_target": F.col("target_label").isNotNull()})


def segment_baseline(valid: DataFrame, least: int = 20) -> DataFrame:
    """Free running time of each segment: the median of weekdays from 5 to 7 o'clock if there are `least` runs, else the 15th percentile of all; with label and number of runs."""
    early = F.when((F.col("day_type") == "Weekday") & F.col("hour").isin(5, 6), F.col("runtime_s"))
    own = valid.groupBy(*SEGMENT).agg(F.count(early).alias("early_n"), F.count("*").alias("n"), F.percentile(early, F.lit(0.5)).alias("early_s"), _at("runtime_s", 0.15).alias("share_s"))
    is_early = F.col("early_n") >= least
    pick = lambda x, y: F.when(is_early, x).otherwise(y)
    return own.select(*SEGMENT, pick(F.col("early_s"), F.col("share_s")).alias("baseline_s"), pick(F.lit(EARLY_LABEL), F.lit(SHARE_LABEL)).alias("baseline_method"), pick(F.col("early_n"), F.col("n")).alias("baseline_n"))


def segment_summary(valid: DataFrame) -> DataFrame:
    """By direction, segment, day type and band: runs, quantiles (linear) of the time they take, speed, and the median against free running and the schedule."""
    r3 = lambda x: c.rounded(x, 3)
    own = valid.groupBy(*BANDED).agg(
        F.count("*").alias("n"), F.count_distinct("service_date").alias("service_days"), r3(_at("distance_m", 0.5)).alias("distance_m"), _at("scheduled_s", 0.5).alias("scheduled_s"), _at("runtime_s", 0.5).alias("median_s"),
        *[r3(_at("runtime_s", p / 100)).alias(f"p{p}_s") for p in (25, 75, 90, 95)], F.max("runtime_s").alias("max_s"), r3(_at("speed_mph", 0.5)).alias("median_mph"),
    )
    out = own.join(segment_baseline(valid), SEGMENT)
    over = lambda x: r3(F.try_divide(100.0 * (F.col("median_s") - F.col(x)), F.col(x)))
    return out.withColumns({"slowdown_pct": over("baseline_s"), "overrun_pct": over("scheduled_s")})


def draw(rep: Column, k: Column, n: Column) -> Column:
    """Which of n values the k-th draw of resample rep takes: a multiplicative hash, the same in any engine."""
    mixed = (rep * 7919 + k * 104_729 + 12_345) * 2_654_435_761 % 4_294_967_296
    return F.floor(mixed / 128).cast("long") % n


def bootstrap_median_ci(valid: DataFrame, keys: list[str], reps: int = 2000, least_days: int = 5) -> DataFrame:
    """keys, days, low_s and high_s: the 95 % interval of the median of daily medians, from resamples of the days; null with fewer than least_days days."""
    daily = valid.groupBy(*keys, "service_date").agg(_at("runtime_s", 0.5).alias("m"))
    days = daily.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("service_date", "m"))), lambda x: x["m"]).alias("m"))  # a value a day
    n = F.size("m").cast("long")
    each = days.where(n >= least_days).withColumns({"rep": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))), "n": n})
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.get("m", draw(F.col("rep"), k, F.col("n")).cast("int")))
    ordered = F.array_sort(drawn)
    middle = (F.get(ordered, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.col("n") / 2).cast("int"))) / 2
    ends = each.select(*keys, middle.alias("x")).groupBy(*keys).agg(c.rounded(_at("x", 0.025), 3).alias("low_s"), c.rounded(_at("x", 0.975), 3).alias("high_s"))
    return days.select(*keys, F.size("m").cast("long").alias("days")).join(ends, keys, "left")


def coverage_daily(merged: DataFrame, holidays: list[str] | None = None) -> DataFrame:
    """By date: trips and stops scheduled and observed, from schedule_obs_merge()."""
    trips = merged.groupBy("service_date", "trip_id").agg(F.count("*").alias("stops"), F.count("actual_arrival").alias("arrivals"))
    own = trips.groupBy("service_date").agg(F.count("*").alias("scheduled_trips"), F.count_if(F.col("arrivals") > 0).alias("observed_trips"), F.sum("stops").alias("scheduled_stops"), F.sum("arrivals").alias("observed_arrivals"))
    share = lambda x, y: c.rounded(100.0 * F.col(x) / F.col(y), 3)
    return own.withColumns({"trips_pct": share("observed_trips", "scheduled_trips"), "stops_pct": share("observed_arrivals", "scheduled_stops"), "day_type": c.day_type3(F.col("service_date"), holidays)})


def study_audit(merged: DataFrame, raw: DataFrame, obs: DataFrame, unscheduled: DataFrame) -> DataFrame:
    """One row: rows and trips of the schedule and the record, and what repeats or matches nothing."""
    a = merged.agg(F.count("*").alias("scheduled_rows"), F.count_distinct("service_date", "trip_id").alias("scheduled_trips"), F.count_distinct(F.when(F.col("trip_observed"), F.struct("service_date", "trip_id"))).alias("observed_trips"), F.count_distinct("service_date").alias("service_days"))
    b, d, e = raw.agg(F.count("*").alias("raw_rows")), obs.agg(F.count("*").alias("rows"), F.count("actual_arrival").alias("arrivals")), unscheduled.agg(F.count("*").alias("unscheduled_trips"))
    out = a.crossJoin(b).crossJoin(d).crossJoin(e)  # one row each
    return out.withColumn("duplicate_pct", c.rounded(F.try_divide(100.0 * (F.col("raw_rows") - F.col("rows")), F.col("raw_rows")), 3))


def hourly_segment_matrix(valid: DataFrame, first: int = 5, last: int = 23) -> DataFrame:
    """Median weekday time of each segment by hour, a column each."""
    own = valid.where((F.col("day_type") == "Weekday") & F.col("hour").between(first, last))
    return own.groupBy(*SEGMENT).pivot("hour", list(range(first, last + 1))).agg(_at("runtime_s", 0.5)).select(*SEGMENT, *[F.col(str(h)).alias(f"h{h}_s") for h in range(first, last + 1)])


def target_hourly(valid: DataFrame) -> DataFrame:
    """Weekday median and 90th percentile of target segments by hour, 5 to 23."""
    own = valid.where((F.col("day_type") == "Weekday") & F.col("is_target") & F.col("hour").between(5, 23))
    return own.groupBy("direction_id", "segment_label", "hour").agg(F.count("*").alias("n"), _at("runtime_s", 0.5).alias("median_s"), c.rounded(_at("runtime_s", 0.9), 3).alias("p90_s"))


def weekend_runtime(valid: DataFrame) -> DataFrame:
    """Median by direction, day type and daytime band."""
    return valid.where(F.col("time_band").isin("AM peak", "Midday", "PM peak", "Evening")).groupBy("direction_id", "day_type", "time_band").agg(F.count("*").alias("n"), _at("runtime_s", 0.5).alias("median_s"))


def hotspots(summary: DataFrame, least: int = 30) -> DataFrame:
    """Weekday afternoon-peak segments with enough runs, by how much slower than free running they are."""
    return summary.where((F.col("day_type") == "Weekday") & (F.col("time_band") == "PM peak") & (F.col("n") >= least)).orderBy(F.desc("slowdown_pct"), *SEGMENT)


def segment_order(valid: DataFrame) -> DataFrame:
    """Segments of each direction in order of their median stop sequence."""
    own = valid.groupBy(*SEGMENT).agg(_at("stop_sequence", 0.5).alias("sequence"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("direction_id").orderBy("sequence", "segment_id")))


def corridor_stops(valid: DataFrame, stops: DataFrame, direction: int) -> DataFrame:
    """Stops of one direction from south to north: where its segments begin, and where the last one ends."""
    own = valid.where(F.col("direction_id") == direction)
    ends = own.agg(F.max_by("to_stop", F.struct("stop_sequence", "service_date", "trip_id")).alias("stop_id"))
    named = own.select(F.col("from_stop").alias("stop_id")).union(ends).distinct().join(stops, "stop_id")
    return named.select("stop_id", c.short_stop_name(F.col("stop_name")).alias("name"), "lat").orderBy("lat", "stop_id")


def traffic_vs_spacing(valid: DataFrame, screen: DataFrame, gaps: DataFrame) -> DataFrame:
    """By direction and weekday hour: median slowdown against each segment's 15th percentile, unevenness of headways, and runs missing at the screenline."""
    own = valid.where((F.col("day_type") == "Weekday") & F.col("hour").between(5, 23))
    free = own.groupBy(*SEGMENT).agg(_at("runtime_s", 0.15).alias("free_s"))
    traffic = own.join(free, SEGMENT).withColumn("x", 100.0 * (F.col("runtime_s") - F.col("free_s")) / F.col("free_s")).groupBy("direction_id", "hour").agg(c.rounded(_at("x", 0.5), 3).alias("slowdown_pct"))
    n, s, q = F.count("*"), F.sum("headway_s").cast("double"), F.sum(F.col("headway_s") * F.col("headway_s")).cast("double")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))) / (s / n))
    spacing = gaps.where(F.col("day_type") == "Weekday").groupBy("direction_id", "hour").agg(c.rounded(spread, 3).alias("headway_cv"))
    due = screen.where(~F.dayofweek("service_date").isin(1, 7)).groupBy("direction_id", c.local_hour(F.col("scheduled_arrival")).alias("hour")).agg(F.count("*").alias("scheduled"), F.count("actual_arrival").alias("observed"))
    due = due.withColumn("missing_pct", c.rounded(100.0 * (F.col("scheduled") - F.col("observed")) / F.col("scheduled"), 3))
    return traffic.join(spacing, ["direction_id", "hour"]).join(due, ["direction_id", "hour"])


def feed_comparison(valid: DataFrame, screen: DataFrame, feed: Column) -> DataFrame:
    """Weekday target segments by schedule version, direction and band: time taken, beside delivery at the screenline. feed: a column of service_date."""
    run = valid.where((F.col("day_type") == "Weekday") & F.col("is_target")).withColumn("feed", feed)
    a = run.groupBy("feed", "direction_id", "target_label", "time_band").agg(F.count("*").alias("n"), _at("runtime_s", 0.5).alias("median_s"), c.rounded(_at("runtime_s", 0.9), 3).alias("p90_s"))
    due = screen.where(~F.dayofweek("service_date").isin(1, 7)).withColumns({"feed": feed, "time_band": c.time_band(c.local_hour(F.col("scheduled_arrival")))})
    b = due.groupBy("feed", "direction_id", "time_band").agg(F.count("*").alias("scheduled"), F.count("actual_arrival").alias("observed"))
    return a.join(b, ["feed", "direction_id", "time_band"], "left").withColumn("observed_pct", c.rounded(100.0 * F.col("observed") / F.col("scheduled"), 3))


def day_type_summary(merged: DataFrame, screen: DataFrame, gaps: DataFrame, holidays: list[str] | None = None) -> DataFrame:
    """By day type: trips scheduled and observed, evening delivery at the screenline, evening gaps."""
    day = c.day_type3(F.col("service_date"), holidays).alias("day_type")
    trips = merged.groupBy(day, "service_date", "trip_id").agg(F.count("actual_arrival").alias("k"))
    a = trips.groupBy("day_type").agg(F.count_distinct("service_date").alias("service_days"), F.count("*").alias("scheduled_trips"), F.count_if(F.col("k") > 0).alias("observed_trips"))
    evening = screen.where(c.time_band(c.local_hour(F.col("scheduled_arrival"))) == "Evening").groupBy(day).agg(F.count("*").alias("evening_scheduled"), F.count("actual_arrival").alias("evening_observed"))
    late = gaps.where(F.col("time_band") == "Evening").groupBy("day_type").agg(F.count("*").alias("evening_gaps"), _at("headway_s", 0.5).alias("median_gap_s"), c.rounded(_at("headway_s", 0.9), 3).alias("p90_gap_s"), F.max("headway_s").alias("max_gap_s"))
    share = lambda x, y: c.rounded(100.0 * F.col(x) / F.col(y), 3)
    return a.join(evening, "day_type").join(late, "day_type").withColumns({"trips_pct": share("observed_trips", "scheduled_trips"), "evening_pct": share("evening_observed", "evening_scheduled")})


def findings_summary(corridor: DataFrame, valid: DataFrame, screen: DataFrame, gaps: DataFrame) -> DataFrame:
    """Headline numbers of the study as rows (finding, value)."""
    a = corridor.agg(F.count("*").alias("corridor_legs"))
    b = valid.agg(F.count("*").alias("valid_legs"), F.percentile(F.when((F.col("day_type") == "Weekday") & F.col("is_target") & (F.col("time_band") == "PM peak"), F.col("runtime_s")), F.lit(0.5)).alias("weekday_pm_peak_target_median_s"))
    evening = F.when(~F.dayofweek("service_date").isin(1, 7) & (c.time_band(c.local_hour(F.col("scheduled_arrival"))) == "Evening"), True)
    d = screen.agg(F.count(evening).alias("weekday_evening_scheduled"), F.count(F.when(evening & F.col("actual_arrival").isNotNull(), 1)).alias("weekday_evening_observed"))
    e = gaps.agg(F.max("headway_s").alias("max_gap_s"), F.max(F.when(F.col("time_band") == "Evening", F.col("headway_s"))).alias("max_evening_gap_s"))
    one = a.crossJoin(b).crossJoin(d).crossJoin(e)  # one row each
    one = one.withColumn("invalid_legs", F.col("corridor_legs") - F.col("valid_legs"))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(x).cast("double") for x in one.columns]))).alias("finding", "value"))
