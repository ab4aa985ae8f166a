"""Headways, and how long riders wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import arrived, fresh


def headways_lead(obs: DataFrame) -> DataFrame:
    """Minutes from each arrival to the next at its stop, 30 s to 90 min, with hour and day type of the first."""
    w = Window.partitionBy("route_id", "stop_id", "service_date").orderBy("actual_arrival", "trip_id")
    own = fresh(obs).withColumn("s", c.seconds_between(F.col("actual_arrival"), F.lead("actual_arrival").over(w))).where(F.col("s").between(30, 5400))
    return own.select("service_date", "route_id", "stop_id", "actual_arrival", c.local_hour(F.col("actual_arrival")).alias("hour"), c.day_type(F.col("service_date")).alias("day_type"), (F.col("s") / 60).alias("headway_min"))


def headways_lag(obs: DataFrame) -> DataFrame:
    """Seconds since the arrival before, stale rows too, 60 s to two hours."""
    w = Window.partitionBy("service_date", "route_id", "stop_id").orderBy("actual_arrival", "trip_id")
    own = arrived(obs).withColumn("headway_s", c.seconds_between(F.lag("actual_arrival").over(w), F.col("actual_arrival"))).where(F.col("headway_s").between(60, 7200))
    return own.select("service_date", "route_id", "stop_id", "trip_id", "headway_s")


GRAINS = {"period_group": ["period", "route_group"], "week_group": ["week_start", "route_group"], "period_route": ["period", "route_group", "route_id"]}
GRAIN_KEYS = ["grain", "period", "week_start", "route_group", "route_id"]


def headway_bins(headways: DataFrame, periods: Column) -> DataFrame:
    """Counts by headway to the nearest minute, at three grains: period and group, week and group, period and route. Keys that a grain lacks are null."""
    minute = (60 * F.floor(F.col("headway_s") / 60 + 0.5)).cast("long")
    own = headways.select(periods.alias("period"), c.week_start(F.col("service_date")).alias("week_start"), c.route_group(F.col("route_id")).alias("route_group"), "route_id", minute.alias("bin_s"))
    sets = own.groupingSets([[*keys, "bin_s"] for keys in GRAINS.values()], "period", "week_start", "route_group", "route_id", "bin_s")
    grain = F.when(F.grouping("period") == 1, "week_group").when(F.grouping("route_id") == 1, "period_group").otherwise("period_route")
    return sets.agg(grain.alias("grain"), F.count("*").alias("n"))


def weighted_headways(bins: DataFrame) -> DataFrame:
    """Of headway bins: n, mean wait of a rider, the first bins that hold half and nine tenths of the headways, and the shortest whole seconds within which half and nine tenths of riders wait.

    Of riders who come at random, sum(n min(w, h)) / sum(n h) wait no longer than w; between two bins that is linear in w.
    """
    w = Window.partitionBy(*GRAIN_KEYS)
    n, h = F.col("n"), F.col("bin_s")
    own = bins.withColumns({"cum": F.sum("n").over(w.orderBy("bin_s")), "all": F.sum("n").over(w), "mass": F.sum(n * h).over(w), "below": F.sum(n * h).over(w.orderBy("bin_s"))})
    own = own.withColumns({"before": F.coalesce(F.lag("bin_s").over(w.orderBy("bin_s")), F.lit(0)), "longer": F.col("all") - F.col("cum") + n})
    first = lambda p: F.min(F.when(F.col("cum") >= p * F.col("all"), F.col("bin_s")))

    def wait(p: float) -> Column:
        # up to bin_s the waiting mass is below + (all - cum) * bin_s; in the piece before it, (below - n h) + longer * w
        need = F.ceil((p * F.col("mass") - (F.col("below") - n * h)) / F.col("longer")).cast("long")
        return F.min(F.when(F.col("below") + (F.col("all") - F.col("cum")) * h >= p * F.col("mass"), F.struct("bin_s", F.least(F.lit(7200), F.greatest(need, F.lit(0))).alias("w"))))["w"]

    mean = F.sum(n * h * h) / (2 * F.sum(n * h))
    return own.groupBy(*GRAIN_KEYS).agg(F.sum("n").alias("n"), first(0.5).alias("p50_headway_s"), first(0.9).alias("p90_headway_s"), c.rounded(mean, 1).alias("mean_wait_s"), wait(0.5).alias("p50_wait_s"), wait(0.9).alias("p90_wait_s"))


def wait_by_group(distribution: DataFrame, least: int = 500) -> DataFrame:
    """Mean wait of riders by route group, a column for each period, where a group has `least` headways in it."""
    own = distribution.where((F.col("grain") == "period_group") & (F.col("n") >= least))
    return own.groupBy("route_group").agg(*[F.max(F.when(F.col("period") == p, F.col("mean_wait_s"))).alias(f"{p.lower().replace('-', '_')}_wait_s") for p, _, _ in c.PERIODS])


def wait_summary(headways: DataFrame) -> DataFrame:
    h = F.col("headway_min")
    return headways.groupBy("route_id", "day_type").agg(F.count("*").alias("n"), c.rounded(F.avg(h), 3).alias("mean_headway"), c.rounded(c.percentile("headway_min", 0.5, "double"), 3).alias("p50_headway"), c.rounded(F.sum(h * h) / (2 * F.sum(h)), 3).alias("mean_wait"))


def wait_histogram(headways: DataFrame) -> DataFrame:
    """By route, day type and minute b: minutes of waiting time in [b, b + 1), and their share of all to 3 places."""
    own = headways.select("route_id", "day_type", "headway_min", F.explode(F.sequence(F.lit(0), F.least(F.floor("headway_min"), F.lit(89)).cast("int"))).alias("bin"))
    mass = own.groupBy("route_id", "day_type", "bin").agg(F.sum(F.greatest(F.lit(0.0), F.least(F.col("bin") + 1, F.col("headway_min")) - F.col("bin"))).alias("mass")).where("mass > 0")
    total = F.sum("mass").over(Window.partitionBy("route_id", "day_type"))
    return mass.select("route_id", "day_type", "bin", c.rounded(F.col("mass"), 3).alias("mass"), c.rounded(F.col("mass") / total, 3).alias("density"))


def wait_quantiles(density: DataFrame, keys: list[str], ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Minutes within which p percent wait, from densities to 3 places: linear in the crossing minute, 89 if they never sum up to p."""
    w = Window.partitionBy(*keys).orderBy("bin")
    # densities are whole thousandths, so their sums are exact
    own = density.withColumn("k", F.round(F.col("density") * 1000).cast("long")).withColumn("cum", F.sum("k").over(w))
    at = lambda p: F.coalesce(F.min(F.when(F.col("cum") >= p * 10, F.struct("bin", (F.col("bin") + F.try_divide(p * 10 - (F.col("cum") - F.col("k")), F.col("k"))).alias("x"))))["x"], F.lit(89.0))
    return own.groupBy(*keys).agg(*[c.rounded(at(p), 1).alias(f"p{p}_min") for p in ps])


def wait_histogram_hourly(headways: DataFrame, least: int = 5) -> DataFrame:
    """wait_histogram() by local hour of the gap's first arrival; hours with fewer than `least` gaps are left out here, but count in wait_histogram()."""
    own = headways.groupBy("route_id", "day_type", "hour").agg(F.count("*").alias("gaps")).where(F.col("gaps") >= least)
    bins = F.explode(F.sequence(F.lit(0), F.least(F.floor("headway_min"), F.lit(89)).cast("int")))
    keys = ["route_id", "day_type", "hour"]
    mass = headways.join(own.select(*keys), keys).select(*keys, F.round(F.col("headway_min") * 60).cast("long").alias("s"), bins.alias("bin"))
    each = mass.groupBy(*keys, "bin").agg(F.sum(F.greatest(F.lit(0), F.least((F.col("bin") + 1) * 60, F.col("s")) - F.col("bin") * 60)).alias("mass_s")).where("mass_s > 0")
    total = F.sum("mass_s").over(Window.partitionBy(*keys))
    return each.select(*keys, "bin", "mass_s", c.rounded(F.col("mass_s") / total, 3).alias("density"))


def expected_wait_by_hour(headways: DataFrame) -> DataFrame:
    """Each gap is cut at local hours; area of waiting over covered seconds, by route, day type and hour."""
    end = c.plus_seconds(F.col("actual_arrival"), F.floor(F.col("headway_min") * 60 + 0.5))
    a, b = F.unix_micros("actual_arrival") / 1e6, F.unix_micros(end) / 1e6
    hours = F.sequence(F.floor(a / 3600), F.floor((b - 1e-6) / 3600))
    own = headways.select("route_id", "day_type", a.alias("a"), b.alias("b"), F.explode(hours).alias("h"))
    lo, hi = F.greatest(F.col("a"), F.col("h") * 3600), F.least(F.col("b"), (F.col("h") + 1) * 3600)
    cut = own.select("route_id", "day_type", c.local_hour(F.timestamp_seconds(F.col("h") * 3600)).alias("hour"), (hi - lo).alias("s"), ((F.col("b") - lo) * (F.col("b") - lo) - (F.col("b") - hi) * (F.col("b") - hi)).alias("area2"))
    return cut.groupBy("route_id", "day_type", "hour").agg(F.count("*").alias("n"), F.sum("s").alias("covered_s"), c.rounded(F.sum("area2") / 2 / F.sum("s") / 60, 3).alias("expected_wait_min"))


def worst_gaps(headways: DataFrame, n: int = 25) -> DataFrame:
    return headways.orderBy(F.desc("headway_s"), "service_date", "route_id", "stop_id", "trip_id").limit(n)


def scheduled_headways(plan: DataFrame) -> DataFrame:
    """Minutes between scheduled passages of a stop, 30 s to 90 min, in the columns of headways_lead."""
    w = Window.partitionBy("route_id", "stop_id", "service_date").orderBy("scheduled_arrival", "trip_id")
    at = F.col("scheduled_arrival")
    own = plan.withColumn("s", c.seconds_between(at, F.lead("scheduled_arrival").over(w))).where(F.col("s").between(30, 5400))
    return own.select("service_date", "route_id", "stop_id", at.alias("actual_arrival"), c.local_hour(at).alias("hour"), c.day_type(F.col("service_date")).alias("day_type"), (F.col("s") / 60).alias("headway_min"))


def observed_vs_scheduled_wait(observed: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Expected waits side by side for all 24 hours of each observed route and day type; the difference only where both are there."""
    key = ["route_id", "day_type", "hour"]
    spine = observed.select("route_id", "day_type").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    side = lambda df, name: df.select(*key, F.col("n").alias(f"{name}_n"), c.rounded(F.col("expected_wait_min"), 1).alias(f"{name}_min"))
    own = spine.join(side(observed, "observed"), key, "left").join(side(scheduled, "scheduled"), key, "left")
    return own.withColumn("difference_min", c.rounded(F.col("observed_min") - F.col("scheduled_min"), 1)).fillna(0, ["observed_n", "scheduled_n"])
