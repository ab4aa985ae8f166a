"""Observations: one row per trip and stop as finalized, and what is counted from them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c

KEY = ["service_date", "trip_id", "stop_sequence"]


def dedup_observations(raw: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """One row for each key: arrivals first, then the newest; ties decide what is still equal."""
    order = [F.col("actual_arrival").isNull(), F.desc("ingested_at"), *[F.col(t) for t in ties or ["vehicle_id"]]]
    return raw.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_n = 1").drop("_n")


def finalization_copies(raw: DataFrame) -> DataFrame:
    return raw.withColumn("copies", F.count("*").over(Window.partitionBy(*KEY)))


def arrived(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("actual_arrival").isNotNull())


def fresh(obs: DataFrame) -> DataFrame:
    return arrived(obs).where(~F.col("is_stale"))


def in_rider_window(delay: Column) -> Column:
    return delay.between(-60, 420)


def with_legs(obs: DataFrame, position_m: Column) -> DataFrame:
    """Distance, duration and speed since the previous stop at which the trip arrived; null unless both are positive."""
    before = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("actual_arrival").isNotNull(), F.struct(position_m.alias("m"), F.col("actual_arrival").alias("t"))), ignorenulls=True).over(before)
    out = obs.withColumn("_last", F.when(F.col("actual_arrival").isNotNull(), last))
    d, s = (position_m - F.col("_last.m")).cast("double"), c.seconds_between(F.col("_last.t"), F.col("actual_arrival")).cast("double")
    ok = (d > 0) & (s > 0)
    return out.withColumns({"leg_distance_m": F.when(ok, d), "leg_duration_s": F.when(ok, s), "leg_avg_speed_mps": F.when(ok, d / s)}).drop("_last")


def _punctuality() -> list[Column]:
    d = F.col("delay_seconds")
    bands = {"on_time_pct": d.between(0, 180), "within_5_pct": d.between(0, 300), "within_7_pct": d.between(0, 420), "early_pct": d < 0, "late_pct": d > 180, "very_late_pct": d > 420}
    return [F.coalesce(c.rounded(c.share(x), 1), F.lit(0.0)).alias(k) for k, x in bands.items()]


def _speed() -> Column:
    return c.rounded(F.avg(F.when(F.col("leg_avg_speed_mps").between(0, 35), F.col("leg_avg_speed_mps"))) * 2.2369, 1).alias("avg_speed_mph")


def _beside(stats: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """stats with the columns of counts, of as many rows: one for each value of `by`, nulls included."""
    if not by:
        return counts.crossJoin(stats)  # one row each
    own = counts.withColumnsRenamed({x: f"_{x}" for x in by})
    return stats.join(own, reduce(and_, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in by])).drop(*[f"_{x}" for x in by])


def system_stats(obs: DataFrame) -> DataFrame:
    """One row. Trips count with any arrival, stale ones too; all else goes by fresh arrivals."""
    own = _system(fresh(obs))
    every = arrived(obs).agg(F.count_distinct("service_date", "trip_id").alias("trips"))
    return every.crossJoin(own)  # one row each


def period_stats(obs: DataFrame, *by: str) -> DataFrame:
    """The columns of system_stats() for each value of `by` (a day, a week, a period)."""
    every = arrived(obs).groupBy(*by).agg(F.count_distinct("service_date", "trip_id").alias("trips"))
    return every.join(_system(fresh(obs), *by), [*by])


def _system(own: DataFrame, *by: str) -> DataFrame:
    """Vehicles are counted on their own: beside quantiles, each vehicle would have a state of these."""
    stats = own.groupBy(*by).agg(F.count("*").alias("observations"), *_punctuality(), c.percentiles("delay_seconds", (0.5, 0.95)).alias("_q"), _speed())
    out = _spread_out(_beside(stats, own.groupBy(*by).agg(F.count_distinct("vehicle_id").alias("vehicles")), [*by]), (50, 95))
    return out.select(*by, "observations", "vehicles", *[x for x in out.columns if x not in (*by, "observations", "vehicles")])


def _spread_out(stats: DataFrame, ps: tuple[int, ...]) -> DataFrame:
    """The array `_q` of percentiles as columns."""
    return stats.select("*", *[F.get("_q", F.lit(k)).alias(f"p{p}_delay_s") for k, p in enumerate(ps)]).drop("_q")


def route_stats(obs: DataFrame) -> DataFrame:
    """Trips are counted on their own: beside quantiles, each trip would have a state of these."""
    ps, key, own = (5, 25, 50, 75, 95), ["service_date", "route_id"], fresh(obs)
    stats = own.groupBy(*key).agg(F.count("*").alias("observations"), *_punctuality(), c.percentiles("delay_seconds", tuple(p / 100 for p in ps)).alias("_q"), _speed())
    out = _spread_out(_beside(stats, own.groupBy(*key).agg(F.count_distinct("trip_id").alias("trips")), key), ps)
    return out.select(*key, "trips", *[x for x in out.columns if x not in (*key, "trips")])


def busiest_first(stats: DataFrame) -> DataFrame:
    """Routes with their place in the day's report: by trips, then observations, then id."""
    order = Window.partitionBy("service_date").orderBy(F.desc("trips"), F.desc("observations"), "route_id")
    return stats.withColumn("place", F.row_number().over(order))


def delay_minute_histogram(obs: DataFrame) -> DataFrame:
    return fresh(obs).groupBy(c.delay_minute(F.col("delay_seconds")).alias("minute")).agg(F.count("*").alias("n"))


def volume_15min(obs: DataFrame) -> DataFrame:
    bucket = c.quarter_hour(F.col("service_date"), F.col("actual_arrival"))
    return fresh(obs).groupBy("service_date", "route_id", bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("bucket").between(0, 95))


def volume_top_n(volume: DataFrame, limited: DataFrame, n: int = 10) -> DataFrame:
    """Volume of the n busiest routes of each day, limited ones left out, the rest as Other if there is any: all 96 quarters of an hour of each."""
    open_ = volume.join(limited.select("service_date", "route_id"), ["service_date", "route_id"], "left_anti")
    totals = open_.groupBy("service_date", "route_id").agg(F.sum("n").alias("total"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("service_date").orderBy(F.desc("total"), "route_id")))
    shown = ranked.select("service_date", "route_id", F.when(F.col("rank") <= n, F.col("route_id")).otherwise("Other").alias("series"))
    named = open_.join(shown, ["service_date", "route_id"]).groupBy("service_date", F.col("series").alias("route_id"), "bucket").agg(F.sum("n").alias("n"))
    spine = shown.select("service_date", F.col("series").alias("route_id")).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(95))))
    return spine.join(named, ["service_date", "route_id", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def delay_heatmap(obs: DataFrame, least: int = 10) -> DataFrame:
    """Day of week by local hour, dense; quantiles of cells with fewer than `least` rows are null."""
    own = fresh(obs).groupBy(F.dayofweek("service_date").alias("dow"), c.local_hour(F.col("actual_arrival")).alias("hour")).agg(F.count("*").alias("n"), c.percentile("delay_seconds", 0.5).alias("p50"), c.percentile("delay_seconds", 0.95).alias("p95"))
    spine = obs.sparkSession.range(168).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    shown = lambda x: F.when(F.col("n") >= least, F.col(x)).alias(f"{x}_delay_s")
    return spine.join(own, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"), shown("p50"), shown("p95"))


def route_delay_by_hour(obs: DataFrame, least: int = 10) -> DataFrame:
    return fresh(obs).groupBy("route_id", c.local_hour(F.col("actual_arrival")).alias("hour")).agg(F.count("*").alias("n"), c.percentile("delay_seconds", 0.5).alias("p50_delay_s"), c.percentile("delay_seconds", 0.95).alias("p95_delay_s")).where(F.col("n") >= least)


def route_overall_delay(obs: DataFrame, least: int = 10) -> DataFrame:
    return fresh(obs).groupBy("route_id").agg(F.count("*").alias("n"), c.percentile("delay_seconds", 0.5).alias("p50_delay_s")).where(F.col("n") >= least)


def route_stop_week(obs: DataFrame) -> DataFrame:
    return fresh(obs).groupBy(c.week_start(F.col("service_date")).alias("week_start"), "route_id", "stop_id").agg(F.count("*").alias("n"), c.percentile("delay_seconds", 0.5).alias("p50_delay_s"), c.percentile("delay_seconds", 0.95).alias("p95_delay_s"), c.rounded(F.stddev_samp("delay_seconds"), 1).alias("stddev_delay_s"))


def trip_progress(obs: DataFrame) -> DataFrame:
    return arrived(obs).groupBy("service_date", "trip_id").agg(F.max("stop_sequence").alias("last_sequence"))


def audit_daily(raw: DataFrame, deduped: DataFrame) -> DataFrame:
    has = F.col("actual_arrival").isNotNull()
    a = raw.groupBy("service_date").agg(F.count("*").alias("raw_rows"))
    b = deduped.groupBy("service_date").agg(F.count("*").alias("rows"), F.count_distinct("route_id").alias("routes"), F.count_distinct(F.when(has, F.col("trip_id"))).alias("trips"), F.count_distinct(F.when(has, F.col("vehicle_id"))).alias("vehicles"), F.count_if(has).alias("arrivals"), F.count_if(has & ~F.col("is_stale")).alias("fresh_arrivals"))
    return a.join(b, "service_date").withColumns({"duplicates": F.col("raw_rows") - F.col("rows"), "duplicate_pct": c.rounded(100.0 * (F.col("raw_rows") - F.col("rows")) / F.col("raw_rows"), 1)})


#: What the study counts of stop rows, in order.
_DELIVERY = ["service_days", "scheduled_stop_rows", "observed_trips", "arrivals", "delivered", "on_time", "early", "late", "very_late"]


def _delivery(*quantiles: int) -> list[Column]:
    """What the study counts of stop rows, observed or not, but days and trips."""
    d, has = F.col("delay_seconds"), F.col("actual_arrival").isNotNull()
    bands = {"delivered": d.between(-60, 420), "on_time": d.between(0, 180), "early": d < 0, "late": d > 180, "very_late": d > 420}
    return [
        F.count("*").alias("scheduled_stop_rows"), F.count_if(has).alias("arrivals"),
        *[F.count_if(has & x).alias(k) for k, x in bands.items()], c.percentiles("CASE WHEN actual_arrival IS NOT NULL THEN delay_seconds END", tuple(p / 100 for p in quantiles)).alias("_q"),
    ]


def _days_and_trips(obs: DataFrame, *by: str) -> DataFrame:
    """Days and observed trips of stop rows, each pair once, with `by`; what _days_and_trips_counted() counts."""
    return obs.select(*by, "service_date", F.when(F.col("actual_arrival").isNotNull(), F.col("trip_id")).alias("_trip"), F.col("actual_arrival").isNotNull().alias("_has")).distinct()


def _days_and_trips_counted() -> list[Column]:
    return [F.count_distinct("service_date").alias("service_days"), F.count_distinct(F.when(F.col("_has"), F.struct("service_date", "_trip"))).alias("observed_trips")]


def exclude_dates(rows: DataFrame, dates: list[str]) -> DataFrame:
    """Rows of days other than those named; days that were only partly recorded distort shares."""
    return rows.where(~F.col("service_date").cast("string").isin(dates)) if dates else rows


def period_route_rollup(obs: DataFrame, periods: Column) -> DataFrame:
    """Group and route by study period, as two grains of one pass, over stop rows with and without an arrival."""
    own = obs.withColumns({"period": periods, "route_group": c.route_group(F.col("route_id"))}).where("period is not null")
    grain, by = F.when(F.grouping("route_id") == 1, "group").otherwise("route").alias("grain"), ["period", "route_group", "route_id"]
    sets = lambda rows: rows.groupingSets([by[:2], by], *by)
    counts = sets(_days_and_trips(own, *by)).agg(grain, *_days_and_trips_counted())
    out = _spread_out(_beside(sets(own).agg(grain, *_delivery(5, 50, 95)), counts, [*by, "grain"]), (5, 50, 95))
    return out.select(*by, "grain", *_DELIVERY, *[f"p{p}_delay_s" for p in (5, 50, 95)])


def weekly_group_rollup(obs: DataFrame) -> DataFrame:
    own, by = obs.withColumns({"week_start": c.week_start(F.col("service_date")), "route_group": c.route_group(F.col("route_id"))}), ["week_start", "route_group"]
    counts = _days_and_trips(own, *by).groupBy(*by).agg(*_days_and_trips_counted())
    out = _spread_out(_beside(own.groupBy(*by).agg(*_delivery(50, 95)), counts, by), (50, 95))
    return out.select(*by, *_DELIVERY, "p50_delay_s", "p95_delay_s")


def route_on_time_rate(obs: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    recent = arrived(obs).where((F.col("service_date") <= last_day) & (F.col("service_date") > F.date_sub(last_day, days)))
    return recent.groupBy("route_id").agg(c.rounded(c.share(F.col("delay_seconds") <= 60), 3).alias("on_time_pct"), c.percentile("delay_seconds", 0.95).alias("p95_delay_s"))


def segments(rows: DataFrame, position_m: Column) -> DataFrame:
    """Runs from each stop row of a trip to the next one, if that is the next in sequence: distance, scheduled and actual time, speed.

    rows have all planned stops; the times are null where either arrival is.
    """
    w = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence")
    own = rows.withColumn("_m", position_m.cast("double"))
    own = own.withColumn("next", F.lead(F.struct("stop_sequence", "stop_id", "scheduled_arrival", "actual_arrival", "_m")).over(w)).where(F.col("next.stop_sequence") == F.col("stop_sequence") + 1)
    run = c.seconds_between(F.col("actual_arrival"), F.col("next.actual_arrival"))
    own = own.withColumns({"to_stop": F.col("next.stop_id"), "distance_m": F.col("next._m") - F.col("_m"), "scheduled_s": c.seconds_between(F.col("scheduled_arrival"), F.col("next.scheduled_arrival")), "runtime_s": run})
    return own.withColumn("speed_mph", F.try_divide(F.col("distance_m"), F.col("runtime_s")) * 2.236936).withColumnRenamed("stop_id", "from_stop").drop("next", "_m")


def runtime_valid(segs: DataFrame) -> DataFrame:
    return segs.where(F.col("runtime_s").between(10, 1800) & (F.col("distance_m") > 0))
