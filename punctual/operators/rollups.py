"""Comparisons of study periods, from daily and period tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import columns as c

PERIOD_NAMES = [name for name, _, _ in c.PERIODS]


def _suffix(period: str) -> str:
    return period.lower().replace("-", "_")


def _percent(x: str, y: str) -> Column:
    return c.rounded(F.try_divide(100.0 * F.col(x), F.col(y)), 3)


def schedule_days(daily: DataFrame, gaps: DataFrame, periods: Column) -> DataFrame:
    """Delivery of each route and day of a study period, with its gap windows and how many were possible; both are null where gaps are not known."""
    own = daily.join(gaps, ["service_date", "route_id"], "left").withColumns({"period": periods, "week_start": c.week_start(F.col("service_date")), "route_group": c.route_group(F.col("route_id"))})
    possible = F.when(F.col("gap_windows").isNotNull(), F.greatest(F.col("scheduled") - 1, F.lit(0)))
    return own.where("period is not null").withColumn("possible_windows", possible)


def schedule_rollup(days: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over days and their ratios, by any of the keys of schedule_days(). A sum of nulls alone is null."""
    own = days.groupBy(*keys).agg(F.count_distinct("service_date").alias("service_days"), *[F.sum(x).alias(x) for x in ("scheduled", "ran", "gap_windows", "possible_windows")])
    return own.withColumns({"delivered_pct": _percent("ran", "scheduled"), "gap_rate_pct": _percent("gap_windows", "possible_windows")})


def period_pivot_merge(period_routes: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each route with its trips, stop delivery and on-time share in each period side by side, changes since the first, and its name.

    period_routes: period_route_rollup(). names: route_id, route_name. A period that a route has no row in leaves nulls.
    """
    own = period_routes.where("grain = 'route'").withColumns({"stops_pct": 100.0 * F.col("delivered") / F.col("scheduled_stop_rows"), "on_time_pct": F.try_divide(100.0 * F.col("on_time"), F.col("arrivals"))})
    at = lambda x, p: F.max(F.when(F.col("period") == p, F.col(x))).alias(f"{x}_{_suffix(p)}")
    wide = own.groupBy("route_id", "route_group").agg(*[at(x, p) for x in ("observed_trips", "stops_pct", "on_time_pct") for p in PERIOD_NAMES])
    first, *later = map(_suffix, PERIOD_NAMES)
    change = {f"{x}_change_{p}": F.col(f"{x}_{p}") - F.col(f"{x}_{first}") for x in ("stops_pct", "on_time_pct") for p in later}
    out = wide.withColumns(change)
    shown = [c.rounded(F.col(x), 3).alias(x) if "_pct" in x else F.col(x) for x in out.columns]
    return out.select(*shown).join(names.dropDuplicates(["route_id"]), "route_id", "left")


def route_changes(comparison: DataFrame, n: int = 6, least_first: int = 100, least_last: int = 50) -> DataFrame:
    """The n routes whose stop delivery fell most and the n where it rose most from the first to the last period, of those observed often enough in both."""
    first, last = _suffix(PERIOD_NAMES[0]), _suffix(PERIOD_NAMES[-1])
    by = f"stops_pct_change_{last}"
    own = comparison.where((F.col(f"observed_trips_{first}") >= least_first) & (F.col(f"observed_trips_{last}") >= least_last) & F.col(by).isNotNull()).select("route_id", "route_group", by)
    return own.orderBy(by, "route_id").limit(n).union(own.orderBy(F.desc(by), "route_id").limit(n)).distinct().orderBy(by, "route_id")


def group_metrics(period_routes: DataFrame, schedule: DataFrame, completion: DataFrame) -> DataFrame:
    """Trip and stop delivery, on-time, early, very late and severely cut short shares of each route group and period."""
    own = period_routes.where("grain = 'group'").select("period", "route_group", _percent("delivered", "scheduled_stop_rows").alias("stops_pct"), *[_percent(x, "arrivals").alias(f"{x}_pct") for x in ("on_time", "early", "very_late")])
    severe = completion.where("grain = 'period'").select("period", "route_group", _percent("below_80", "ran").alias("below_80_pct"))
    key = ["period", "route_group"]
    return own.join(schedule.select(*key, F.col("delivered_pct").alias("trips_pct")), key).join(severe, key, "left")


def before_and_after(metrics: DataFrame, group: str) -> DataFrame:
    """Four measures of one route group in the first and the last period: a row each."""
    measures = {"Trips delivered": F.col("trips_pct"), "Stops delivered": F.col("stops_pct"), "Strictly on time": F.col("on_time_pct"), "Not severely truncated": 100 - F.col("below_80_pct")}
    long = metrics.where(F.col("route_group") == group).select("period", F.explode(F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*measures.values()))).alias("measure", "value"))
    at = lambda p: c.rounded(F.max(F.when(F.col("period") == p, F.col("value"))), 3)
    return long.groupBy("measure").agg(at(PERIOD_NAMES[0]).alias("before_pct"), at(PERIOD_NAMES[-1]).alias("after_pct"))


def coverage_summary(audit: DataFrame) -> DataFrame:
    """One row over audit_daily(): days, rows, and the share of rows that repeat others."""
    own = audit.agg(F.count("*").alias("days"), F.min("service_date").alias("first_day"), F.max("service_date").alias("last_day"), F.sum("raw_rows").alias("raw_rows"), F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"))
    return own.withColumn("duplicate_pct", c.rounded(F.try_divide(100.0 * F.col("duplicates"), F.col("raw_rows")), 1))


def daily_rollups(rollups: DataFrame, week: Column) -> DataFrame:
    """The archived daily rows of the week from `week`, a Sunday; a day that is missing has a row of nulls."""
    days = rollups.sparkSession.range(7).select(F.date_add(week, F.col("id").cast("int")).alias("service_date"))
    return days.join(rollups.where(F.col("service_date").between(week, F.date_add(week, 6))), "service_date", "left")


def available_weeks(dates: DataFrame) -> DataFrame:
    """Ends (Saturdays) of the weeks that have all seven dates."""
    own = dates.select("service_date").distinct().groupBy(c.week_start(F.col("service_date")).alias("week_start")).agg(F.count("*").alias("days"))
    return own.where("days = 7").select(F.date_add("week_start", 6).alias("week_end"))


def snap_to_week(asked: DataFrame, weeks: DataFrame) -> DataFrame:
    """For each asked day, the latest available week_end that is no later than its last complete week's."""
    own = asked.select("day", c.last_complete_week_end(F.col("day")).alias("wanted"))
    return own.join(F.broadcast(weeks), F.col("week_end") <= F.col("wanted"), "left").groupBy("day").agg(F.max("week_end").alias("week_end"))  # a row a week
