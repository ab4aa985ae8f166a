"""Service past one stop of each direction: what was due, what came, and the spacing of what came."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import arrived
from punctual.operators.schedule import join_in_trip

LINE = ["route_id", "direction_id"]
# fixed values: what became of a scheduled run
HERE, ELSEWHERE, NOWHERE = "Observed at screenline", "Observed elsewhere only", "No route observation"


def screenline(plan: DataFrame, obs: DataFrame, stops: dict[int, str]) -> DataFrame:
    """Scheduled passages of the stop that `stops` names for each direction, with their order, spacing, arrival and status."""
    here = F.lit(False)
    for direction, stop in stops.items():
        here = here | ((F.col("direction_id") == direction) & (F.col("stop_id") == stop))
    came = arrived(obs)
    at = came.select("service_date", "trip_id", "stop_sequence", "actual_arrival")
    anywhere = came.select("service_date", "trip_id", F.lit(True).alias("anywhere")).distinct()
    w = Window.partitionBy("service_date", *LINE).orderBy("scheduled_arrival", "trip_id")
    own = join_in_trip(plan.where(here), at, "stop_sequence").join(anywhere, ["service_date", "trip_id"], "left")
    status = F.when(F.col("actual_arrival").isNotNull(), HERE).when(F.col("anywhere"), ELSEWHERE).otherwise(NOWHERE)
    spacing = c.seconds_between(F.lag("scheduled_arrival").over(w), F.col("scheduled_arrival")) / 60
    return own.select("service_date", *LINE, "trip_id", "scheduled_arrival", "actual_arrival", (F.row_number().over(w) - 1).cast("long").alias("schedule_index"), spacing.alias("scheduled_headway_min"), status.alias("status"))


def intervals(screen: DataFrame, holidays: list[str] | None = None) -> DataFrame:
    """Seconds and minutes between arrivals in a row, 1 to 180 minutes, the scheduled slots missed between them, the median spacing scheduled in that band, and the ratio to it."""
    day = c.day_type3(F.col("service_date"), holidays).alias("day_type")
    w = Window.partitionBy("service_date", *LINE).orderBy("actual_arrival", "trip_id")
    came = screen.where(F.col("actual_arrival").isNotNull()).select("*", day, c.time_band(c.local_hour(F.col("actual_arrival"))).alias("time_band"), c.local_hour(F.col("actual_arrival")).alias("hour"))
    gap = c.seconds_between(F.lag("actual_arrival").over(w), F.col("actual_arrival"))
    own = came.select("service_date", *LINE, "trip_id", "day_type", "time_band", "hour", gap.alias("headway_s"), (gap / 60).alias("headway_min"), (F.col("schedule_index") - F.lag("schedule_index").over(w) - 1).alias("missed_slots")).where(F.col("headway_s").between(60, 10_800))
    due = screen.where(F.col("scheduled_headway_min").between(1, 180)).select(*LINE, day, c.time_band(c.local_hour(F.col("scheduled_arrival"))).alias("time_band"), F.round(F.col("scheduled_headway_min") * 60).alias("s"))
    usual = due.groupBy(*LINE, "day_type", "time_band").agg(F.percentile("s", F.lit(0.5)).alias("usual_s"))
    return own.join(usual, [*LINE, "day_type", "time_band"], "left").withColumns({"usual_min": F.col("usual_s") / 60, "usual_ratio": F.try_divide("headway_s", "usual_s")})


def headway_summary(gaps: DataFrame) -> DataFrame:
    """By line, day type and band: quantiles (linear) of the gaps, their unevenness, riders' mean wait, bunching and gaps against the usual spacing.

    Sums are of whole seconds, so that they do not depend on the order of rows.
    """
    h, usual, n = F.col("headway_s"), F.col("usual_s"), F.count("*")
    s, q = F.sum(h).cast("double"), F.sum(h * h).cast("double")
    # a quantile of whole seconds has two decimals at most, so hundredths are whole numbers in any engine
    at = lambda p: c.rounded(F.floor(F.percentile("headway_s", F.lit(p)) * 100 + 0.5) / 6000, 3)
    part = lambda x: c.rounded(100.0 * F.count_if(F.coalesce(x, F.lit(False))) / n, 3)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))) / (s / n))
    return gaps.groupBy(*LINE, "day_type", "time_band").agg(
        n.alias("n"), F.count_distinct("service_date").alias("service_days"), c.rounded(F.max(usual) / 60, 3).alias("usual_min"),
        *[at(p).alias(f"{name}_min") for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))],
        c.rounded(F.max(h) / 60, 3).alias("max_min"), c.rounded(s / n / 60, 3).alias("mean_min"), c.rounded(spread, 3).alias("cv"), c.rounded(q / (2 * s) / 60, 3).alias("mean_wait_min"),
        part(h < 0.5 * usual).alias("bunching_pct"), part(h > 1.5 * usual).alias("gap_1_5x_pct"), part(h > 2 * usual).alias("gap_2x_pct"), part(F.col("missed_slots") > 0).alias("missed_pct"),
    )


def headway_survival(gaps: DataFrame) -> DataFrame:
    """By line and day type, for each gap that occurred: how many percent of the gaps are longer. Gaps are whole seconds, so a group has 10,741 rows at most."""
    keys = [*LINE, "day_type"]
    own = gaps.groupBy(*keys, "headway_min").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy(*keys).orderBy("headway_min"), Window.partitionBy(*keys)
    return own.withColumn("longer_pct", c.rounded(100.0 * (F.sum("n").over(every) - F.sum("n").over(upto)) / F.sum("n").over(every), 3))


def gap_calendar(screen: DataFrame, gaps: DataFrame, band: str = "Evening") -> DataFrame:
    """The longest gap of the band for each line and each date from the line's first to its last; null where there was none."""
    dates = screen.groupBy(*LINE).agg(F.min("service_date").alias("a"), F.max("service_date").alias("b")).select(*LINE, F.explode(F.sequence("a", "b")).alias("service_date"))
    longest = gaps.where(F.col("time_band") == band).groupBy("service_date", *LINE).agg(c.rounded(F.max("headway_min"), 3).alias("max_min"))
    return dates.join(longest, ["service_date", *LINE], "left")


def boxplot_stats(gaps: DataFrame) -> DataFrame:
    """By line, day type and band: quartiles (linear) of the gaps, and the outermost gaps within 1.5 interquartile ranges of them."""
    keys = [*LINE, "day_type", "time_band"]
    own = gaps.withColumn("s", F.round(F.col("headway_min") * 60))  # quartiles of whole seconds are exact
    box = own.groupBy(*keys).agg(*[F.percentile("s", F.lit(x)).alias(q) for q, x in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inner = own.join(box, keys).where(F.col("s").between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inner.groupBy(*keys, "q1", "median", "q3").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return ends.select(*keys, *[c.rounded(F.col(x) / 60, 3).alias(f"{x}_min") for x in ("low", "q1", "median", "q3", "high")])


def status_share(screen: DataFrame, *by: str) -> DataFrame:
    """Runs by line (and `by`) and status, with the status's share."""
    keys = [*LINE, *by]
    return screen.groupBy(*keys, "status").agg(F.count("*").alias("n")).withColumn("share_pct", c.rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 1))


def prior_same_weekday(daily: DataFrame, value: str, weeks: int = 2) -> DataFrame:
    """Each day's value beside that of the same weekday 1 to `weeks` weeks before, where that day is there. One row a day in daily."""
    back = daily.select(F.explode(F.array(*[F.struct(F.date_add("service_date", 7 * w).alias("service_date"), F.lit(w).alias("weeks_ago"), F.col(value).alias("before")) for w in range(1, weeks + 1)])).alias("x")).select("x.*")
    return daily.select("service_date", value).join(back, "service_date")
