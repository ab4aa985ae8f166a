"""Report card: weighted route metrics, a composite score and its letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.schedule import floor_percentile, routes_full

# fixed values: weights of the parts, lower bounds of the letters
WEIGHTS = {"delivered_pct": 60, "on_time_pct": 15, "speed_pct": 15, "headway_pct": 10}
LETTERS = [("A+", 97), ("A", 93), ("A-", 90), ("B+", 87), ("B", 83), ("B-", 80), ("C+", 77), ("C", 73), ("C-", 70), ("D+", 67), ("D", 63), ("D-", 60), ("F", 0)]
TARGET_MPH = 13.0


#: What a day's statistics of a route weigh by its observations: values to one decimal.
WEIGHED = ("on_time_pct", "avg_speed_mph", "p95_delay_s", "p50_distortion_pct")


def route_days(stats: DataFrame, trips: DataFrame, stops: DataFrame, distorted: DataFrame) -> DataFrame:
    """A row for each day and route, observed or only scheduled. stats: route_stats(), trips: daily_service_delivered(), stops: route_stop_delivery(), distorted: day, route and percent."""
    key = ["service_date", "route_id"]
    middle = floor_percentile(distorted, key, "percent", 0.5).select(*key, c.rounded(F.col("percent"), 1).alias("p50_distortion_pct"))
    own = stats.select(*key, "trips", "observations", "on_time_pct", "avg_speed_mph", "p95_delay_s")
    return routes_full(own, trips.select(*key, "scheduled", "ran")).join(stops.select(*key, "scored", "delivered"), key, "left").join(middle, key, "left")


def _weighed(x: str) -> Column:
    """The mean of x by observations; days without it have no weight. Tenths are summed as whole numbers."""
    known = F.col(x).isNotNull() & (F.col("observations") > 0)
    tenths = F.sum(F.when(known, F.round(F.col(x) * 10).cast("long") * F.col("observations")))
    return tenths / F.sum(F.when(known, F.col("observations"))) / 10


def report_card_routes(days: DataFrame, *by: str) -> DataFrame:
    """Sums and weighed means of the days of each route (and `by`), with score, grade and whether the route is limited."""
    n = F.col("observations")
    runs = F.try_divide(F.sum("scheduled"), F.count_if(F.col("scheduled") > 0))
    own = days.groupBy(*by, "route_id").agg(
        F.sum("trips").alias("trips"), F.sum(n).alias("observations"), F.count_if(n > 0).alias("days"), F.sum("scheduled").alias("scheduled"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
        F.coalesce(runs, F.lit(0.0)).alias("runs_per_day"), F.try_divide(100.0 * F.sum("delivered"), F.sum("scored")).alias("delivered_pct"), *[_weighed(x).alias(x) for x in WEIGHED],
    )
    return composite_score(own).withColumn("limited", c.is_limited(F.col("route_id"), F.col("runs_per_day")))


def agency_score(routes: DataFrame, *by: str) -> DataFrame:
    """Means of the routes' values by their observations, and the same score of these. Limited routes and those without a score are left out."""
    own = routes.where("not limited and score is not null and observations > 0")
    mean = lambda x: F.sum(F.col(x) * F.col("observations")) / F.sum(F.when(F.col(x).isNotNull(), F.col("observations")))
    return composite_score(own.groupBy(*by).agg(F.count("*").alias("routes"), F.sum("trips").alias("trips"), F.sum("observations").alias("observations"), *[mean(x).alias(x) for x in ("delivered_pct", *WEIGHED)]))


def history_windows(days: DataFrame, window: int = 28, step: int = 7, months: int = 6) -> DataFrame:
    """days, once for each window of `window` available dates that they belong to, with the window's last date as end_date.

    Windows end at every step-th available date, back from the latest to `months` months before it, and only full ones count.
    """
    dates = days.select("service_date").distinct()
    latest = dates.agg(F.max("service_date").alias("latest"), F.count("*").alias("dates"))
    # a row a date: the one window over all dates is as long as the calendar
    ranked = dates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("service_date"))) - 1).crossJoin(latest)
    ends = ranked.where((F.col("rank") % step == 0) & (F.col("rank") + window <= F.col("dates")) & (F.col("service_date") >= F.add_months("latest", -months))).select(F.col("service_date").alias("end_date"), F.explode(F.sequence(F.col("rank"), F.col("rank") + window - 1)).alias("rank"))
    members = ends.join(ranked.select("rank", "service_date"), "rank").select("end_date", "service_date")
    return days.join(F.broadcast(members), "service_date")  # window rows a date, over `months` months


def grade_history(days: DataFrame, window: int = 28, step: int = 7, top: int = 10) -> DataFrame:
    """end_date, route_id (null: the agency), score of the `top` routes by scheduled runs in the latest window, and of the agency."""
    routes = report_card_routes(history_windows(days, window, step), "end_date").where("score is not null")
    agency = agency_score(routes, "end_date").select("end_date", F.lit(None).cast("string").alias("route_id"), "score")
    latest = routes.agg(F.max("end_date").alias("end_date"))
    chosen = routes.join(latest, "end_date").orderBy(F.desc("scheduled"), "route_id").limit(top).select("route_id")
    return routes.join(F.broadcast(chosen), "route_id").select("end_date", "route_id", "score").unionByName(agency)  # `top` rows


def composite_score(metrics: DataFrame) -> DataFrame:
    """score and grade: weights of missing parts are shared out among the others."""
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))
    parts = {"delivered_pct": F.col("delivered_pct"), "on_time_pct": F.col("on_time_pct"), "speed_pct": F.col("avg_speed_mph") / TARGET_MPH * 100, "headway_pct": 100 - F.abs("p50_distortion_pct")}
    total = weight = F.lit(0.0)
    for name, x in parts.items():
        total, weight = total + F.coalesce(clamp(x) * WEIGHTS[name], F.lit(0.0)), weight + F.when(x.isNotNull(), WEIGHTS[name]).otherwise(0)
    grade = F.lit("F")
    for letter, least in reversed(LETTERS):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    return metrics.withColumn("score", c.rounded(total / F.when(weight > 0, weight), 1)).withColumn("grade", F.when(F.col("score").isNotNull(), grade))
