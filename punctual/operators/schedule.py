"""What was planned, and how much of it ran."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import arrived, in_rider_window, trip_progress

DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
TRIP = ["service_date", "trip_id"]


def join_in_trip(left: DataFrame, right: DataFrame, *within: str) -> DataFrame:
    """left with the columns of those rows of right that have the same trip and values of `within`, nulls where there are none.

    The trip alone is the join's key: `within` is compared behind it, as two bounds, since Spark would deal rows by an equality too, and so take them away from the rest of their trip.
    """
    own = right.withColumnsRenamed({x: f"_{x}" for x in (*TRIP, *within)})
    same = [F.col(x) == F.col(f"_{x}") for x in TRIP] + [F.col(x).between(F.col(f"_{x}"), F.col(f"_{x}")) for x in within]
    return left.join(own, reduce(and_, same), "left").drop(*[f"_{x}" for x in (*TRIP, *within)])


def active_services(dates: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_date, service_id: calendar ranges by weekday, with exceptions of type 1 added and of type 2 removed."""
    flags = F.array(*[F.col(d) for d in DAYS])
    regular = F.broadcast(dates).join(calendar, F.col("service_date").between(F.col("start_date"), F.col("end_date"))).where(F.element_at(flags, F.dayofweek("service_date")) == 1).select("service_date", "service_id")
    on = exceptions.where("exception_type = 1").join(F.broadcast(dates), "service_date", "left_semi").select("service_date", "service_id")
    off = exceptions.where("exception_type = 2").select("service_date", "service_id")
    return regular.join(off, ["service_date", "service_id"], "left_anti").unionByName(on).distinct()


def scheduled_trips(services: DataFrame, trips: DataFrame) -> DataFrame:
    return services.join(trips, "service_id").select("service_date", "trip_id", "route_id", "direction_id").distinct()


def stop_plan(plan: DataFrame) -> DataFrame:
    """plan with position, stops, scored (neither first nor last, boarding allowed) and the last boarding sequence of its trip."""
    trip = Window.partitionBy(*TRIP)
    boards = F.coalesce(F.col("pickup_type"), F.lit(0)) != 1
    out = plan.withColumns({"position": F.row_number().over(trip.orderBy("stop_sequence")), "stops": F.count("*").over(trip), "last_boarding": F.max(F.when(boards, F.col("stop_sequence"))).over(trip)})
    return out.withColumn("scored", (F.col("position") > 1) & (F.col("position") < F.col("stops")) & boards)


def scheduled_runs(plan: DataFrame) -> DataFrame:
    """The first scheduled instant of each trip, by departure where a stop has no arrival time; trips without any time are left out."""
    at = F.coalesce("scheduled_arrival", "scheduled_departure") if "scheduled_departure" in plan.columns else F.col("scheduled_arrival")
    return plan.groupBy("service_date", "route_id", "direction_id", "trip_id").agg(F.min(at).alias("starts")).where("starts is not null")


def route_stop_delivery(plan: DataFrame, obs: DataFrame) -> DataFrame:
    """Scored stops, and those served in the riders' window, by day and route."""
    served = arrived(obs).where(in_rider_window(F.col("delay_seconds"))).select("service_date", "trip_id", "stop_sequence", F.lit(1).alias("served"))
    own = join_in_trip(stop_plan(plan).where("scored"), served, "stop_sequence")
    return own.groupBy("service_date", "route_id").agg(F.count("*").alias("scored"), F.count("served").alias("delivered")).withColumn("delivered_pct", c.rounded(100.0 * F.col("delivered") / F.col("scored"), 1))


def week_stop_delivery(daily: DataFrame) -> DataFrame:
    """route_stop_delivery() by week: the ratio of the sums over the days that it has."""
    own = daily.groupBy(c.week_start(F.col("service_date")).alias("week_start"), "route_id").agg(F.count("*").alias("days"), F.sum("scored").alias("scored"), F.sum("delivered").alias("delivered"))
    return own.withColumn("delivered_pct", c.rounded(100.0 * F.col("delivered") / F.col("scored"), 1))


def scheduled_runs_per_day(daily: DataFrame) -> DataFrame:
    """Mean scheduled runs of each route over the days of daily_service_delivered() on which it has any."""
    return daily.where("scheduled > 0").groupBy("route_id").agg(F.count("*").alias("days"), c.rounded(F.avg("scheduled"), 1).alias("runs_per_day"))


def ran_trips(trips: DataFrame, obs: DataFrame) -> DataFrame:
    return trips.join(arrived(obs).select(*TRIP).distinct(), TRIP, "left_semi")


def dropped_trips(trips: DataFrame, obs: DataFrame) -> DataFrame:
    return trips.join(arrived(obs).select(*TRIP).distinct(), TRIP, "left_anti")


def dropped_sample(dropped: DataFrame, n: int = 20) -> DataFrame:
    """The first n dropped trips of each day by id, for the day's report."""
    rank = F.row_number().over(Window.partitionBy("service_date").orderBy("trip_id"))
    return dropped.select("service_date", "trip_id", rank.alias("rank")).where(F.col("rank") <= n).drop("rank")


def daily_service_delivered(trips: DataFrame, obs: DataFrame) -> DataFrame:
    seen = arrived(obs).select(*TRIP, F.lit(1).alias("ran")).distinct()
    return trips.join(seen, TRIP, "left").groupBy("service_date", "route_id").agg(F.count("*").alias("scheduled"), F.count("ran").alias("ran")).withColumn("delivered_pct", c.rounded(100.0 * F.col("ran") / F.col("scheduled"), 1))


def week_days(daily: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """daily on all seven days of each week and key: the values of days without a row are null."""
    own = daily.withColumn("week_start", c.week_start(F.col("service_date")))
    spine = own.select("week_start", *keys).distinct().withColumn("service_date", F.explode(F.sequence("week_start", F.date_add("week_start", 6))))
    return spine.join(own.select("service_date", *keys, *values), ["service_date", *keys], "left")


def gap_windows(runs: DataFrame, obs: DataFrame) -> DataFrame:
    """Scheduled runs that, like the run before them in their direction, were not observed, by day and route."""
    seen = arrived(obs).select(*TRIP, F.lit(True).alias("seen")).distinct()
    w = Window.partitionBy("service_date", "route_id", "direction_id").orderBy("starts", "trip_id")
    own = runs.join(seen, TRIP, "left").withColumn("seen", F.coalesce("seen", F.lit(False))).withColumn("before", F.lag("seen").over(w))
    return own.groupBy("service_date", "route_id").agg(F.count_if(~F.col("seen") & ~F.col("before")).alias("gap_windows"))


def trips_not_completed(plan: DataFrame, obs: DataFrame) -> DataFrame:
    """Trips that arrived somewhere but not at their last boarding stop, with the share of positions reached and its bucket. One pass over the plan."""
    last = trip_progress(obs)
    own = stop_plan(plan).select(*TRIP, "route_id", "stop_sequence", "position", "last_boarding").join(last, TRIP)
    at = lambda x: F.max(F.when(F.col("stop_sequence") == F.col(x), F.col("position")))
    ends = own.where("last_sequence < last_boarding").groupBy(*TRIP, "route_id", "last_sequence").agg(at("last_sequence").alias("position"), at("last_boarding").alias("of"))
    out = ends.where("position is not null").withColumn("pct", 100.0 * F.col("position") / F.col("of"))
    return out.select("service_date", "route_id", "trip_id", "last_sequence", "pct", c.rounded(F.col("pct"), 1).alias("completed_pct"), F.least((F.col("pct") / 10).cast("int"), F.lit(9)).alias("bucket"))


def completion_distribution(cut_short: DataFrame) -> DataFrame:
    """By day: trips cut short, quantiles of how far they came, and how many came to each tenth."""
    shares = {f"p{p}_pct": p / 100 for p in (5, 25, 50, 75, 95)}
    each = _counted(cut_short, ["service_date"], ["pct", "bucket"])
    tenths = [F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("_n"))), F.lit(0)).alias(f"bucket_{k}") for k in range(10)]
    return each.groupBy("service_date").agg(F.sum("_n").alias("trips"), *tenths, *[c.rounded(_at_share("pct", p), 1).alias(x) for x, p in shares.items()])


def distortion(plan: DataFrame, obs: DataFrame) -> DataFrame:
    """Delay over the scheduled headway it eats into, in percent: from the run before if late, to the run after if early."""
    w = Window.partitionBy("service_date", "route_id", "stop_id").orderBy("scheduled_arrival")
    instants = plan.groupBy("service_date", "route_id", "stop_id", "scheduled_arrival").agg(F.count("*").alias("at_once"))
    near = instants.withColumns({"before": c.seconds_between(F.lag("scheduled_arrival").over(w), F.col("scheduled_arrival")), "after": F.when(F.col("at_once") > 1, 0).otherwise(c.seconds_between(F.col("scheduled_arrival"), F.lead("scheduled_arrival").over(w)))})
    own = arrived(obs).where(~F.col("is_stale") & (F.col("delay_seconds") != 0)).join(near, ["service_date", "route_id", "stop_id", "scheduled_arrival"])
    headway = F.when(F.col("delay_seconds") > 0, F.col("before")).otherwise(F.col("after"))
    return own.where(headway > 0).select("service_date", "route_id", "trip_id", "stop_sequence", (100.0 * F.col("delay_seconds") / headway).alias("percent"))


def distortion_histogram(distorted: DataFrame) -> DataFrame:
    return distorted.groupBy("route_id", c.distortion_bucket(F.col("percent")).alias("bucket")).agg(F.count("*").alias("n"))


def _counted(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each distinct row of keys and values with its count `_n`, the group's rows up to it `_upto` and all of them `_all`."""
    counts = rows.groupBy(*keys, *values).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    return counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(*values)), "_all": F.sum("_n").over(w)})


def _at_share(value: str, p: float) -> Column:
    """Of a group of _counted(), the value at index min(int(n p), n - 1)."""
    index = F.least((F.col("_all") * p).cast("long"), F.col("_all") - 1)
    return F.max(F.when((F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index), F.col(value)))


def floor_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, and for each named share p the value at index min(int(n p), n - 1) of the sorted group. Equal values are counted before they move, so a group is as large as its distinct values."""
    return _counted(rows, keys, [value]).groupBy(*keys).agg(*[_at_share(value, p).alias(name) for name, p in shares.items()])


def floor_percentile(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """floor_percentiles() at one share, as a column named as the value is."""
    return floor_percentiles(rows, keys, value, {value: p})


def completion_rollup(obs: DataFrame, periods: Column) -> DataFrame:
    """By route group, once by study period and once by week: trips that ran, reached their last stop, fell short, and came less than 80 % of the way."""
    trips = obs.groupBy("service_date", "route_id", "trip_id").agg(F.max("stop_sequence").alias("final"), F.max(F.when(F.col("actual_arrival").isNotNull(), F.col("stop_sequence"))).alias("last"))
    own = trips.where("last is not null and final > 0").select(periods.alias("period"), c.week_start(F.col("service_date")).alias("week_start"), c.route_group(F.col("route_id")).alias("route_group"), "last", "final", (100.0 * F.col("last") / F.col("final")).alias("pct"))
    sets = own.groupingSets([["period", "route_group"], ["week_start", "route_group"]], "period", "week_start", "route_group")
    counts = {"reached": "last >= final", "incomplete": "last < final", "below_80": "pct < 80"}
    return sets.agg(F.when(F.grouping("period") == 1, "week").otherwise("period").alias("grain"), F.count("*").alias("ran"), *[F.count_if(F.expr(x)).alias(k) for k, x in counts.items()], *[c.rounded(c.percentile("pct", p / 100, "double"), 3).alias(f"p{p}_pct") for p in (5, 50)])


def route_week_grid(daily: DataFrame, gaps: DataFrame, delays: DataFrame) -> DataFrame:
    """By week and route, worst median delay first: delivery on the seven days, runs per active day, limited, and gap windows if every active day has them.

    daily: daily_service_delivered(), gaps: gap_windows(), delays: week_start, route_id, p50_delay_s.
    """
    joined = daily.join(gaps, ["service_date", "route_id"], "left").withColumn("week_start", c.week_start(F.col("service_date")))
    of_day = [F.max(F.when(F.dayofweek("service_date") == k + 1, F.col("delivered_pct"))).alias(f"{d[:3]}_pct") for k, d in enumerate(DAYS)]
    active = F.count_if(F.expr("scheduled > 0"))
    own = joined.groupBy("week_start", "route_id").agg(F.sum("scheduled").alias("scheduled"), F.sum("ran").alias("ran"), active.alias("active_days"), *of_day, F.when(F.count("gap_windows") == active, F.sum("gap_windows")).alias("gap_windows"))
    per_day = c.rounded(F.col("scheduled") / F.col("active_days"), 1)
    out = own.withColumns({"runs_per_day": per_day, "limited": c.is_limited(F.col("route_id"), per_day)}).join(delays, ["week_start", "route_id"], "left")
    return out.orderBy("week_start", F.desc_nulls_last("p50_delay_s"), "route_id")


def routes_full(stats: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Route-day statistics with rows for routes that were scheduled but not observed at all: their counts are 0."""
    out = stats.join(scheduled, ["service_date", "route_id"], "full")
    return out.fillna(0, ["observations", "trips", "scheduled", "ran"])


def weekly_compliance(trips: DataFrame, stops: DataFrame, short: DataFrame) -> DataFrame:
    """By week, sums over days and the ratios of sums. trips: scheduled and ran, stops: scored and delivered, by day and route; short: trips_not_completed()."""
    week = c.week_start(F.col("service_date")).alias("week_start")
    a = trips.groupBy(week).agg(F.sum("scheduled").alias("scheduled"), F.sum("ran").alias("ran"))
    b = stops.groupBy(week).agg(F.sum("scored").alias("scored"), F.sum("delivered").alias("delivered"))
    d = short.groupBy(week).agg(F.count("*").alias("not_completed"))
    own = a.join(b, "week_start", "left").join(d, "week_start", "left").fillna(0, ["scored", "delivered", "not_completed"]).withColumn("dropped", F.col("scheduled") - F.col("ran"))
    share = lambda x, y: c.rounded(F.try_divide(100.0 * F.col(x), F.col(y)), 1)
    return own.withColumns({"trips_pct": share("ran", "scheduled"), "stops_pct": share("delivered", "scored")})


def compliance_ratios(weekly: DataFrame) -> DataFrame:
    """Dropped trips as a share of scheduled ones, trips cut short as a share of those that ran."""
    share = lambda x, y: c.rounded(F.try_divide(100.0 * F.col(x), F.col(y)), 1)
    return weekly.select("week_start", share("dropped", "scheduled").alias("dropped_pct"), share("not_completed", "ran").alias("not_completed_pct"))


def unscheduled_trips(trips: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed trips that no schedule has."""
    return obs.select(*TRIP, "route_id").distinct().join(trips, TRIP, "left_anti")


def schedule_obs_merge(plan: DataFrame, obs: DataFrame) -> DataFrame:
    """Each planned stop with its observation, if any, and whether its trip was observed anywhere. A key that either side repeats is an error."""
    key = ["stop_sequence", "stop_id"]

    def once(df: DataFrame) -> DataFrame:
        """df, an error if a trip has a stop again. By trip, as it is joined."""
        before = F.lag(F.struct(*key)).over(Window.partitionBy(*TRIP).orderBy(*key))
        own = df.withColumn("_again", before.eqNullSafe(F.struct(*key)))
        return own.where(F.when(F.col("_again"), F.raise_error(F.lit("a planned stop or its observation is repeated"))).otherwise(True)).drop("_again")

    seen = once(obs.select(*TRIP, *key, "vehicle_id", "actual_arrival", "delay_seconds", "is_stale"))
    own = join_in_trip(once(plan), seen, *key)
    return own.withColumn("trip_observed", F.count("actual_arrival").over(Window.partitionBy(*TRIP)) > 0)
