"""Sketches against exact statistics, nested documents, published versions, and stored tables whose input changes."""

import datetime as dt
import os
import shutil

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from punctual.operators import documents, feeds, observations, schedule, sketches, trips
from punctual.plans import fixtures, storage
from punctual.sources import files, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def obs(spark):
    """A week of two routes, one of them with 60,000 arrivals a day of skewed delays, and rows that are stale or without arrival."""
    day = F.date_add(F.lit("2026-05-17").cast("date"), (F.col("id") % 7).cast("int"))
    own = spark.range(180_000).select(
        day.alias("service_date"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("route_id"), (F.col("id") % 5000).cast("string").alias("trip_id"), (F.col("id") % 700).cast("string").alias("vehicle_id"), F.col("id").alias("stop_sequence"),
        F.when(F.col("id") % 50 != 0, (F.pow(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000, 3) * 3000 - 120).cast("long")).alias("delay_seconds"), (F.col("id") % 20 == 3).alias("is_stale"), (F.col("id") % 12).cast("double").alias("leg_avg_speed_mps"),
    )
    at = F.timestamp_seconds(F.unix_seconds(F.col("service_date").cast("timestamp")) + 36_000 + F.col("stop_sequence") % 50_000)
    return own.withColumn("actual_arrival", F.when(F.col("delay_seconds").isNotNull(), at)).persist()


def test_sketches_merge_to_the_exact_answers(spark, obs, tmp_path):
    """A week from stored daily sketches: ranks within 1 %, distinct counts within 3 %, all else exact; by route, and in any number of steps."""
    sketches.daily_sketches(obs).write.partitionBy("service_date").parquet(str(tmp_path / "s"))
    daily = spark.read.parquet(str(tmp_path / "s"))
    for by in ([], ["route_id"]):
        got = sketches.system_stats(sketches.merged(daily, *by), *by)
        want = {tuple(x[b] for b in by): x for x in (observations.period_stats(obs, *by) if by else observations.system_stats(obs)).collect()}
        for x in got.collect():
            y = want[tuple(x[b] for b in by)]
            for name in ("observations", "on_time_pct", "within_5_pct", "within_7_pct", "early_pct", "late_pct", "very_late_pct", "avg_speed_mph"):
                assert x[name] == y[name], name
            assert abs(x.trips - y.trips) <= 0.03 * y.trips and abs(x.vehicles - y.vehicles) <= 0.03 * y.vehicles
        for p in (50, 95):
            keyed = got.withColumn("k", F.lit(1))
            errors = sketches.rank_error(observations.fresh(obs).withColumn("k", F.lit(1)), keyed, ["k", *by], "delay_seconds", f"p{p}_delay_s", p / 100)
            assert max(x.error for x in errors.collect()) <= 0.01
    twice = sketches.merged(sketches.merged(daily, "service_date", "route_id"), "route_id")
    assert {x.route_id: x.n for x in twice.select("route_id", F.kll_sketch_get_n_bigint("delays").alias("n")).collect()} == {x.route_id: x["count"] for x in observations.fresh(obs).groupBy("route_id").count().collect()}
    assert sketches.system_stats(sketches.merged(daily.where("false"), "route_id"), "route_id").count() == 0
    none = sketches.system_stats(sketches.merged(sketches.daily_sketches(obs.withColumn("is_stale", F.lit(True))), "route_id"), "route_id").first()
    assert (none.observations, none.p50_delay_s, none.on_time_pct, none.avg_speed_mph) == (0, None, 0.0, None)


def test_documents_round_trip(spark):
    day = dt.date(2026, 5, 17)
    system = spark.createDataFrame([(day, 5, None), (dt.date(2026, 5, 18), 6, 1.5)], "service_date date, trips long, pct double")
    routes = spark.createDataFrame([(day, "b", 2, None), (day, "a", 1, 0.25), (dt.date(2026, 5, 19), "a \"x\"\n", 3, 1e-7)], "service_date date, route_id string, n long, x double")
    one, many = {"system": system}, {"routes": (routes, ["route_id"])}
    docs = documents.documents("service_date", one, many)
    assert docs.count() == 3
    text = docs.where(F.col("service_date") == day).first().document
    assert text == '{"service_date":"2026-05-17","system":{"trips":5,"pct":null},"routes":[{"route_id":"a","n":1,"x":0.25},{"route_id":"b","n":2,"x":null}]}'
    back = documents.parsed(docs, documents.document_schema("service_date", one, many))
    for name, table in (("system", system), ("routes", routes)):
        assert sorted(map(str, documents.section(back, "service_date", name).select(*table.columns).collect())) == sorted(map(str, table.collect()))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        documents.parsed(spark.createDataFrame([("{",)], "document string"), documents.document_schema("service_date", one, many)).collect()
    grid = documents.week_grid(routes, "2026-05-17", ["n"]).where("route_id = 'a'").first()
    assert [x.n if x else None for x in grid.days] == [1, None, None, None, None, None, None]


def test_published_versions(spark, tmp_path, monkeypatch):
    """The index moves at once: a reader during a publication, or after one that failed, finds what was there; versions never change."""
    path = str(tmp_path / "roll")
    rows = lambda x: spark.createDataFrame([(x,)], "x string")
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.read_published(spark, path)
    moved = [sinks.publish_rollup(rows(f"{d}-{k}"), path, dt.date(2026, 1, d)) for k, d in enumerate((2, 1, 3, 3))]
    assert moved == [True, False, True, True] and sinks.published_days(spark, path) == ["2026-01-03", "2026-01-02", "2026-01-01"]
    assert sinks.read_published(spark, path).first().x == "3-3" and sinks.read_published(spark, path, "2026-01-01").first().x == "1-1"
    reader = sinks.read_published(spark, path)
    seen = []
    real = files.swap_text

    def watched(spark, where, text):
        seen.append(sinks.read_published(spark, path).first().x)
        real(spark, where, text)
        seen.append(sinks.read_published(spark, path).first().x)

    monkeypatch.setattr(sinks, "swap_text", watched)
    sinks.publish_rollup(rows("later"), path, dt.date(2026, 1, 4))
    assert seen == ["3-3", "later"] and reader.first().x == "3-3"
    monkeypatch.setattr(sinks, "swap_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        sinks.publish_rollup(rows("lost"), path, dt.date(2026, 1, 5))
    assert sinks.read_published(spark, path).first().x == "later" and "2026-01-05" not in sinks.published_days(spark, path)


def test_stored_table_follows_its_input(spark, tmp_path):
    """A changed input changes the answer, and of the stored table only the date that it changes is written."""
    sf = tmp_path / "sf"
    sf.mkdir()
    for name in ("orders", "lineitem"):
        shutil.copy(f"{SF}/{name}.parquet", sf / f"{name}.parquet")
    count = lambda: {x.service_date: x.n for x in fixtures.observed(spark, str(sf)).groupBy("service_date").agg(F.count("*").alias("n")).collect()}
    before = count()
    stored = storage._STORED[(spark.sparkContext.applicationId, str(sf), "observations")]
    times = lambda: {d: max(f.stat().st_mtime_ns for f in (tmp_path.__class__(stored.path.removeprefix("file://")) / d).iterdir()) for d in os.listdir(stored.path.removeprefix("file://")) if d.startswith("service_date")}
    first = times()
    assert count() == before and times() == first
    orders, lines = (pq.read_table(sf / f"{name}.parquet") for name in ("orders", "lineitem"))
    gone = sorted(set(orders["o_orderkey"].to_pylist()) & set(lines["l_orderkey"].to_pylist()))[0]
    pq.write_table(lines.filter(pc.not_equal(lines["l_orderkey"], gone)), sf / "lineitem.parquet")
    after = count()
    changed = {d for d in before if after.get(d) != before[d]}
    assert len(changed) == 1 and {d for d, t in times().items() if first[d] != t} == {f"service_date={next(iter(changed))}"}
    shutil.rmtree(stored.path.removeprefix("file://"))
    assert count() == after


def test_replay_reads_one_date_and_few_row_groups(spark):
    own = fixtures.stored_probes(spark, SF)
    first = own.agg(F.min(F.struct("trip_key", "service_date")).alias("x")).first().x
    found = trips.replay_trip(own, F.lit(first.service_date), F.lit(first.trip_key))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_date" in plan and "EqualTo(trip_key," in plan
    assert found.count() == fixtures.probes(spark, SF).where(F.col("trip_key") == first.trip_key).count()


def test_small_operators(spark):
    archives = spark.createDataFrame([("a", "1", None), ("b", "1", True), ("c", "1", False), ("d", "2", None)], "archive string, content_sha256 string, asked boolean")
    assert [x.archive for x in feeds.feed_versions(archives).orderBy("archive").collect()] == ["a", "d"]
    assert [x.archive for x in feeds.feed_versions(archives, F.col("asked")).orderBy("archive").collect()] == ["a", "b", "d"]
    dropped = spark.createDataFrame([(dt.date(2026, 1, d), f"t{k:03}") for d in (1, 2) for k in range(30)], "service_date date, trip_id string")
    assert {(x.service_date.day, x.n) for x in schedule.dropped_sample(dropped).groupBy("service_date").agg(F.count("*").alias("n")).collect()} == {(1, 20), (2, 20)}
    stats = spark.createDataFrame([(dt.date(2026, 1, 1), r, t, n) for r, t, n in (("x", 1, 9), ("y", 2, 1), ("z", 1, 9), ("w", 1, 10))], "service_date date, route_id string, trips long, observations long")
    assert [x.route_id for x in observations.busiest_first(stats).orderBy("place").collect()] == ["y", "w", "x", "z"]
