"""What a query's plan moves: one narrow shuffle where rows could be moved several times, and no state of quantiles for each trip."""

import pytest
from pyspark.sql import functions as F

from punctual.operators import observations as o
from punctual.operators import schedule
from punctual.plans import fixtures

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_observations_move_once(spark, threshold):
    """Observations and trips are shuffled by trip, and neither windows nor storing shuffle again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        shown = plan_of(fixtures.derived_observations(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shown.count("Exchange hashpartitioning") == (2 if threshold == "-1" else 1)


def test_stored_observations_need_no_ranges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fixtures, "stored_table", lambda s, sf, name, inputs, derive: seen.append(derive()))
    fixtures.observed(spark, SF)
    assert "rangepartitioning" not in plan_of(seen[0])


def test_trips_are_counted_beside_quantiles(spark):
    """No aggregate that is keyed by a trip or vehicle holds a group's quantiles."""
    obs = fixtures.derived_observations(spark, SF)
    for own in (o.route_stats(obs), o.system_stats(obs), o.weekly_group_rollup(obs)):
        keyed = [x for x in plan_of(own).splitlines() if "percentile" in x and "Aggregate(keys=" in x]
        assert keyed and not any("trip_id" in x.split("functions=")[0] or "vehicle_id" in x.split("functions=")[0] for x in keyed)


def test_counts_beside_quantiles_keep_null_routes(spark):
    rows = [("2026-05-20", None, "a", "v", 5), ("2026-05-20", None, "b", "v", 7), ("2026-05-20", "1", "a", "w", 9)]
    obs = spark.createDataFrame(rows, "d string, route_id string, trip_id string, vehicle_id string, delay_seconds long").selectExpr("cast(d as date) as service_date", "route_id", "trip_id", "vehicle_id", "delay_seconds", "timestamp'2026-05-20 12:00:00' as actual_arrival", "false as is_stale", "1d as leg_avg_speed_mps")
    assert {x.route_id: (x.trips, x.observations, x.p95_delay_s) for x in o.route_stats(obs).collect()} == {None: (2, 2, 7), "1": (1, 1, 9)}


def test_plan_is_dealt_before_stops(spark):
    """Windows by trip over the plan need no shuffle of stops: the only one lies under the explode."""
    shown = plan_of(schedule.stop_plan(fixtures.plan(spark, SF)))
    assert shown.count("Exchange ") == 1 and shown.index("Generate explode") < shown.index("Exchange ")


def test_completion_in_one_pass(spark):
    shown = plan_of(schedule.completion_distribution(schedule.trips_not_completed(fixtures.plan(spark, SF), fixtures.derived_observations(spark, SF))))
    assert shown.count("Generate explode") == 1


def test_stops_meet_observations_within_their_trip(spark):
    """Neither delivery nor the merge with the schedule nor the segments behind it shuffle stops."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, obs = fixtures.plan(spark, SF), spark.range(1).selectExpr("date_add(date'2026-05-20', cast(id as int)) as service_date", "cast(id as string) as trip_id", "id as stop_sequence", "concat('S', id) as stop_id", "'v' as vehicle_id", "timestamp'2026-05-20 12:00:00' as actual_arrival", "5L as delay_seconds", "false as is_stale")
        merged = o.segments(schedule.schedule_obs_merge(plan, obs), F.col("stop_sequence") * 352)
        assert plan_of(merged).count("Exchange ") == 2
        assert plan_of(schedule.route_stop_delivery(plan, obs)).count("Exchange ") == 3  # the last is of counts by day and route
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
