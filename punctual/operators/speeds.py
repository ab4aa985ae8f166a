"""Speeds of legs, from counts in bins of half a mile an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import fresh

MPH = 2.2369


def leg_speed_hist(obs: DataFrame, *keys: str) -> DataFrame:
    own = fresh(obs).where(F.col("leg_avg_speed_mps").between(0, 35))
    bin_ = F.floor(F.col("leg_avg_speed_mps") * MPH / 0.5).cast("int")
    return own.groupBy(*(keys or ("route_id",)), c.day_type(F.col("service_date")).alias("day_type"), c.local_hour(F.col("actual_arrival")).alias("hour"), bin_.alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin").between(0, 139))


def binned_summary(hist: DataFrame, keys: list[str], ps: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """n, mean, population standard deviation (null if n is 1) from bin middles, and quantiles with the crossing bin cut in proportion."""
    bins = hist.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    own = bins.withColumns({"cum": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w), "mid": F.col("bin") * 0.5 + 0.25})
    at = lambda p: F.min(F.when(F.col("cum") >= F.lit(p) * F.col("total"), F.struct("bin", (0.5 * (F.col("bin") + (F.lit(p) * F.col("total") - (F.col("cum") - F.col("n"))) / F.col("n"))).alias("x"))))["x"]
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("mid")), F.sum(F.col("n") * F.col("mid") * F.col("mid"))
    sd = F.when(n > 1, c.rounded(F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))), 1))
    return own.groupBy(*keys).agg(n.alias("n"), c.rounded(s / n, 1).alias("mean_mph"), sd.alias("stddev_mph"), *[c.rounded(at(p), 1).alias(f"p{round(p * 100)}_mph") for p in ps])


def speed_summary(obs: DataFrame) -> DataFrame:
    return binned_summary(leg_speed_hist(obs, "route_id", "direction_id"), ["route_id", "direction_id", "day_type"], (0.05, 0.5, 0.95, 0.99))


def speed_by_hour(obs: DataFrame, least: int = 10) -> DataFrame:
    """speed_summary() by local hour; hours with fewer than `least` legs are left out here, but count in speed_summary()."""
    return binned_summary(leg_speed_hist(obs, "route_id", "direction_id"), ["route_id", "direction_id", "day_type", "hour"], (0.05, 0.5, 0.95, 0.99)).where(F.col("n") >= least)


def with_directions(hist: DataFrame, directions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trip-level histogram rows with the direction of their trip, and how many rows have none: those are left out. directions: trip_id, direction_id."""
    known = directions.dropDuplicates(["trip_id"])
    return hist.join(known, "trip_id"), hist.join(known, "trip_id", "left_anti").agg(F.count("*").alias("missing"))


def segment_speed(obs: DataFrame, plan: DataFrame) -> DataFrame:
    """By route, direction and pair of neighbouring planned stops."""
    w = Window.partitionBy("service_date", "trip_id").orderBy("stop_sequence")
    pairs = plan.select("service_date", "trip_id", "stop_sequence", F.lag("stop_id").over(w).alias("from_stop"), F.col("stop_id").alias("to_stop")).where("from_stop is not null")
    own = fresh(obs).where(F.col("leg_avg_speed_mps").between(0, 35)).join(pairs, ["service_date", "trip_id", "stop_sequence"])
    hist = own.groupBy("route_id", "direction_id", "from_stop", "to_stop", F.floor(F.col("leg_avg_speed_mps") * MPH / 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin").between(0, 139))
    return binned_summary(hist, ["route_id", "direction_id", "from_stop", "to_stop"], (0.5,))


def route_leg_speed_rank(obs: DataFrame) -> DataFrame:
    own = fresh(obs).where("leg_avg_speed_mps is not null").groupBy("route_id").agg(F.avg("leg_avg_speed_mps").alias("v"))
    return own.select("route_id", c.rounded(F.col("v"), 3).alias("mean_mps"), c.rounded(F.col("v") * 2.236936, 3).alias("mean_mph")).orderBy(F.desc("mean_mps"), "route_id")
