"""Quantiles and distinct counts that can be merged: sketches by day, hour and route stand for the rows they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators.observations import arrived

#: Size of a quantile sketch (rank error about 0.4 %) and the binary logarithm of a distinct sketch's registers (about 1 %).
KLL_K, HLL_LG = 600, 14
_SHARES = {"on_time": (0, 180), "within_5": (0, 300), "within_7": (0, 420)}


def daily_sketches(obs: DataFrame) -> DataFrame:
    """service_date, route_id, hour (local): counts of fresh arrivals by punctuality, sums of leg speeds, and sketches of delays, trips and vehicles.

    Trips are those with any arrival, stale ones too; all else goes by fresh arrivals. A stored table of these rows, some KB each, serves any period and
    route without observations.
    """
    d, fresh = F.col("delay_seconds"), ~F.col("is_stale")
    count = lambda x: F.count_if(fresh & x)
    mps = F.when(fresh & F.col("leg_avg_speed_mps").between(0, 35), F.col("leg_avg_speed_mps"))
    return arrived(obs).groupBy("service_date", "route_id", c.local_hour(F.col("actual_arrival")).alias("hour")).agg(
        F.count_if(fresh).alias("observations"), *[count(d.between(*x)).alias(k) for k, x in _SHARES.items()], count(d < 0).alias("early"), count(d > 180).alias("late"), count(d > 420).alias("very_late"),
        F.count(mps).alias("legs"), F.sum(mps).alias("mps"), F.kll_sketch_agg_bigint(F.when(fresh, d), F.lit(KLL_K)).alias("delays"),
        F.hll_sketch_agg(F.concat_ws("|", "service_date", "trip_id"), F.lit(HLL_LG)).alias("trips"), F.hll_sketch_agg(F.when(fresh, F.col("vehicle_id")), F.lit(HLL_LG)).alias("vehicles"),
    )


def merged(daily: DataFrame, *by: Column | str) -> DataFrame:
    """Rows of daily_sketches() merged by any columns of theirs, or of what they give (a week, a day of the week)."""
    sums = ["observations", *_SHARES, "early", "late", "very_late", "legs", "mps"]
    return daily.groupBy(*by).agg(*[F.sum(x).alias(x) for x in sums], F.kll_merge_agg_bigint("delays").alias("delays"), *[F.hll_union_agg(x).alias(x) for x in ("trips", "vehicles")])


def _delay(p: float) -> Column:
    return F.when(F.kll_sketch_get_n_bigint("delays") > 0, F.kll_sketch_get_quantile_bigint("delays", F.lit(p)))


def system_stats(sketches: DataFrame, *by: str) -> DataFrame:
    """The columns of observations.system_stats() from merged sketches: counts of rows and shares exact, trips, vehicles and quantiles within their sketches' errors."""
    share = lambda x: F.coalesce(c.rounded(F.try_divide(100.0 * F.col(x), F.col("observations")), 1), F.lit(0.0)).alias(f"{x}_pct")
    speed = c.rounded(F.try_divide("mps", "legs") * 2.2369, 1).alias("avg_speed_mph")
    return sketches.select(*by, F.hll_sketch_estimate("trips").alias("trips"), "observations", F.hll_sketch_estimate("vehicles").alias("vehicles"), *[share(x) for x in (*_SHARES, "early", "late", "very_late")], _delay(0.5).alias("p50_delay_s"), _delay(0.95).alias("p95_delay_s"), speed)


def delay_heatmap(daily: DataFrame, least: int = 10) -> DataFrame:
    """Day of week by local hour with any arrival: n, and the quantiles of cells with at least `least` rows."""
    own = merged(daily, F.dayofweek("service_date").alias("dow"), "hour")
    shown = lambda p: F.when(F.col("observations") >= least, _delay(p / 100)).alias(f"p{p}_delay_s")
    return own.select("dow", "hour", F.col("observations").alias("n"), shown(50), shown(95))


def rank_error(values: DataFrame, found: DataFrame, key: list[str], value: str, quantile: str, p: float) -> DataFrame:
    """key, error: how far p lies from the ranks that found's quantile has among values, as a share of them."""
    own = values.join(found.select(*key, quantile), key)
    below, upto = F.count_if(F.col(value) < F.col(quantile)) / F.count("*"), F.count_if(F.col(value) <= F.col(quantile)) / F.count("*")
    return own.groupBy(*key).agg(F.greatest(F.lit(0.0), below - p, p - upto).alias("error"))
