"""Known answers for the transit operators, their SQL on the small tables, and streams against batch."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators import feeds, reportcard, schedule, trips, waits
from punctual.plans import backfill, live_queries, more_queries, queries
from punctual.sources import schedule_files, sinks
from punctual.sources.day_store import DayStore
from punctual.streaming import live

SF = "/root/testdata/sf0.001"
assert more_queries.QUERIES is queries.QUERIES and live_queries.live_trips in queries.QUERIES.values()  # one table of queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_columns(spark):
    day = F.lit("2026-03-08").cast("date")
    assert one(spark, F.date_format(c.scheduled_ts(day, F.lit("25:30:00")), "MM-dd HH:mm")) == "03-09 09:30"
    assert one(spark, c.scheduled_ts(day, F.lit("junk"))) is None
    assert one(spark, c.service_date_of(F.to_timestamp(F.lit("2026-04-25 08:30:00")))) == dt.date(2026, 4, 24)
    assert [one(spark, c.rounded(F.lit(x), 1)) for x in (1.25, -1.25, 99.95)] == [1.3, -1.3, 100.0]
    assert [one(spark, c.distortion_bucket(F.lit(x))) for x in (-200.0, -100.0, -99.9, -95.0, 0.0, 4.99, 5.0, 99.99, 100.0)] == [0, 0, 1, 2, 21, 21, 22, 40, 41]
    assert [one(spark, c.is_limited(F.lit(x), F.lit(n))) for x, n in (("99", 9), ("99", 10), ("1T", 9), ("O", 2))] == [True, False, True, False]
    assert one(spark, c.parse_service_date(F.lit("20260424"))) == dt.date(2026, 4, 24) and one(spark, c.parse_service_date(F.lit("x"))) is None


def test_active_services(spark):
    week = [0, 1, 1, 1, 1, 1, 0]
    calendar = spark.createDataFrame([("WKDY", *week), ("SAT", 0, 0, 0, 0, 0, 0, 1)], ["service_id", *schedule.DAYS]).withColumns({"start_date": F.lit("2026-01-01").cast("date"), "end_date": F.lit("2027-12-31").cast("date")})
    days = [dt.date(2026, 4, 27), dt.date(2026, 4, 25), dt.date(2026, 4, 28)]
    dates = spark.createDataFrame([(d,) for d in days], "service_date date")
    exceptions = spark.createDataFrame([("WKDY", days[0], 2), ("HOLIDAY", days[0], 1)], "service_id string, service_date date, exception_type int")
    got = {(x.service_date, x.service_id) for x in schedule.active_services(dates, calendar, exceptions).collect()}
    assert got == {(days[0], "HOLIDAY"), (days[1], "SAT"), (days[2], "WKDY")}


def test_arrivals_and_fallback(spark):
    stops = spark.createDataFrame([("T", 1, 0.0), ("T", 2, 200.0), ("T", 3, 500.0)], "trip_key string, stop_sequence int, stop_m double")

    def run(fixes):
        probes = spark.createDataFrame([("T", dt.datetime(2026, 1, 1, 0, 0, s), float(m)) for s, m in fixes], "trip_key string, ts timestamp, dist_m double")
        hit = trips.detect_arrivals(probes, stops)
        base = pd.Timestamp("2026-01-01").value // 1000
        seconds = lambda df: {x.stop_sequence: (x.arrived_us - base) / 1e6 for x in df.collect()}
        return seconds(hit), seconds(trips.trailing_fallback(probes, stops, hit))

    assert run([(0, 100), (50, 300)]) == ({2: 25.0}, {})
    assert run([(0, 300)]) == ({}, {})
    assert len(run([(0, -50), (50, 600)])[0]) == 3
    assert run([(0, 100), (10, 480)])[1] == {3: 10.0} and run([(0, 490)])[1] == {3: 0.0} and run([(0, 100), (10, 380)])[1] == {3: 10.0}


def test_projection(spark):
    shape = spark.createDataFrame([("S", k, 0.0, x) for k, x in enumerate((0.0, 0.001, 0.002, 0.003))], "shape_id string, seq int, lat double, lon double")
    points = spark.createDataFrame([("a", "S", 0.0001, 0.0015), ("b", "S", 0.0, -1.0), ("c", "S", 0.0, 1.0)], "point_id string, shape_id string, plat double, plon double")
    got = {x.point_id: x for x in trips.project_points(points, trips.shape_segments(shape)).collect()}
    assert got["a"].dist_m == pytest.approx(166.79, abs=0.01) and got["a"].off_m == pytest.approx(11.12, abs=0.01)
    assert got["b"].dist_m == 0 and got["c"].dist_m == pytest.approx(333.58, abs=0.02)


def test_expected_wait(spark):
    at = [dt.datetime(2026, 1, 5, 8 + h, m) for h, m in ((0, 55), (1, 10), (1, 20), (1, 50), (2, 10))]
    rows = [(dt.date(2026, 1, 5), "R", "S", a, "weekday", (b - a).seconds / 60) for a, b in zip(at, at[1:], strict=False)]
    got = waits.expected_wait_by_hour(spark.createDataFrame(rows, "service_date date, route_id string, stop_id string, actual_arrival timestamp, day_type string, headway_min double"))
    assert {x.hour: (x.n, x.covered_s, x.expected_wait_min) for x in got.collect()} == {0: (1, 300.0, 12.5), 1: (4, 3600.0, 11.667), 2: (1, 600.0, 5.0)}


@pytest.fixture(scope="module")
def small():
    db = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, (dt.date, pd.Timestamp)):
        return str(v)[:10]
    return str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, small, name):
    """Every query against its SQL."""
    want = small.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert set(got.columns) == set(want.columns)
    shown = lambda df: sorted(str([_plain(v) for v in r]) for r in df[list(want.columns)].astype(object).itertuples(index=False))
    assert shown(got) == shown(want)


def test_known_answers(spark):
    """Values of small fixtures by hand."""
    day = F.lit("2026-05-17").cast("date")
    assert one(spark, c.quarter_hour(day, F.to_timestamp(F.lit("2026-05-17 06:59:30")))) == 0 and one(spark, c.quarter_hour(day, F.to_timestamp(F.lit("2026-05-17 06:58:30")))) == -1
    assert [one(spark, c.short_stop_name(F.lit(x))) for x in ("Broadway & 14th St", "Broadway & W Grand Av (far side)", "Broadway & Thomas (20th St)")] == ["14th", "Grand", "20th"]
    assert one(spark, c.sanitize_key(F.lit("1/R x"))) == "1_R_x"
    assert one(spark, c.last_complete_week_end(F.lit("2026-06-13").cast("date"))) == dt.date(2026, 6, 6)
    rows = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 5.0)] * 3 + [("c", x) for x in (1.0, 2.0, 3.0)], "k string, x double")
    assert {x.k: x.x for x in schedule.floor_percentile(rows, ["k"], "x", 0.5).collect()} == {"a": 5.0, "b": 5.0, "c": 2.0}
    assert {x.k: x.x for x in schedule.floor_percentile(rows, ["k"], "x", 1.0).collect()} == {"a": 9.0, "b": 5.0, "c": 3.0}
    bins = spark.createDataFrame([("g", None, None, "x", None, 300, 3), ("g", None, None, "x", None, 1800, 1)], "grain string, period string, week_start date, route_group string, route_id string, bin_s long, n long")
    got = waits.weighted_headways(bins).first()
    assert (got.n, got.p50_headway_s, got.p90_headway_s, got.mean_wait_s, got.p50_wait_s, got.p90_wait_s) == (4, 300, 1800, 650.0, 450, 1530)
    plan = spark.createDataFrame([("t", None, 10), ("t", 20, None), ("u", None, None)], "trip_id string, a int, d int").select(day.alias("service_date"), F.lit("1").alias("route_id"), F.lit(0).alias("direction_id"), "trip_id", F.timestamp_seconds("a").alias("scheduled_arrival"), F.timestamp_seconds("d").alias("scheduled_departure"))
    assert [(x.trip_id, x.s) for x in schedule.scheduled_runs(plan).select("trip_id", F.unix_seconds("starts").alias("s")).collect()] == [("t", 10)]
    with pytest.raises(Exception, match="repeated"):
        schedule.schedule_obs_merge(plan.withColumns({"stop_sequence": F.lit(1), "stop_id": F.lit("s")}), plan.withColumns({"stop_sequence": F.lit(1), "stop_id": F.lit("s"), "vehicle_id": F.lit("v"), "actual_arrival": F.lit(None).cast("timestamp"), "delay_seconds": F.lit(0), "is_stale": F.lit(False)})).collect()


def test_score(spark):
    own = spark.createDataFrame([("a", 90.0, 80.0, 13.0, 10.0), ("b", None, 100.0, 26.0, None), ("c", None, None, None, None)], "route_id string, delivered_pct double, on_time_pct double, avg_speed_mph double, p50_distortion_pct double")
    assert {x.route_id: (x.score, x.grade) for x in reportcard.composite_score(own).collect()} == {"a": (90.0, "A-"), "b": (100.0, "A+"), "c": (None, None)}


def test_sessions_across_days(spark):
    at = [dt.datetime(2026, 1, 1, 23, 50), dt.datetime(2026, 1, 2, 0, 5), dt.datetime(2026, 1, 2, 0, 40), dt.datetime(2026, 1, 4, 3, 0), dt.datetime(2026, 1, 4, 3, 20)]
    got = trips.sessions(spark.createDataFrame([("v", a) for a in at], "vehicle_id string, ts timestamp")).orderBy("ts").collect()
    assert [x.session for x in got] == [0, 0, 1, 2, 2]


def test_archives(spark, tmp_path):
    import zipfile

    for k, fare in ((1, "1"), (2, "1"), (3, "2"), (4, "2")):
        with zipfile.ZipFile(tmp_path / f"2026010{k}.zip", "w") as z:
            z.writestr("routes.txt", "\ufeffroute_id, route_long_name\n" + ("1, Main St\n" if k < 4 else "1, High St\n2\n"))
            z.writestr("fare_rules.txt", fare)
    path = str(tmp_path / "*.zip")
    rows = [tuple(x) for x in schedule_files.read_archives(spark, path, "routes").orderBy("archive", "route_id").collect()]
    assert rows[0] == ("20260101.zip", "1", "Main St", "", "") and rows[-1] == ("20260104.zip", "2", "", "", "") and len(rows) == 5
    members = schedule_files.read_archive_members(spark, path)
    assert [(x.archive[6:8], x.changed, x.change_scope) for x in feeds.feed_change_timeline(members).orderBy("archive").collect()] == [("01", 0, feeds.INITIAL), ("02", 0, feeds.IDENTICAL), ("03", 1, feeds.FARES), ("04", 1, feeds.SCHEDULE)]
    assert [x.archive[6:8] for x in feeds.feed_versions(feeds.archive_hashes(members)).orderBy("archive").collect()] == ["01", "03", "04"]
    with pytest.raises(Exception, match="no feed"):
        cover = spark.createDataFrame([("F", True, 1, dt.date(2026, 1, 1), 0)], "feed string, is_current boolean, archived int, service_date date, services int")
        feeds.resolve_feed_for_date(cover.select("service_date"), cover, strict=True).collect()


def test_sinks(spark, tmp_path):
    rows = lambda d: spark.createDataFrame([(dt.date(2026, 1, d), "1/A", f"t{d}")], "service_date date, route_id string, trip_id string")
    for d in (1, 2, 1):
        sinks.append_finalized(rows(d), str(tmp_path / "obs"))
    assert schedule_files.obs_for_range(spark, str(tmp_path / "obs"), F.lit("2026-01-01"), F.lit("2026-01-01")).count() == 2
    with pytest.raises(ValueError, match="not over"):
        sinks.overwrite_service_dates(rows(2), str(tmp_path / "obs"), today=dt.date(2026, 1, 2))
    sinks.overwrite_service_dates(rows(2), str(tmp_path / "obs"), today=dt.date(2026, 1, 2), force=True)
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 3
    sinks.write_per_route(rows(1), str(tmp_path / "per"))
    assert (tmp_path / "per" / "route_key=1_A").exists()


def test_processed_routes(spark, tmp_path):
    shapes = spark.createDataFrame([("H", k, 37.8, -122.0 + k, 10.0 * k) for k in (1, 0)], "shape_id string, seq int, lat double, lon double, along_m double")
    stops = spark.createDataFrame([("A", "First", 37.8, -122.0), ("B", "Other", 37.8, -121.0)], "stop_id string, stop_name string, lat double, lon double")
    runs = spark.createDataFrame([("t", "1", "H", 0)], "trip_id string, route_id string, shape_id string, direction_id int")
    calls = spark.createDataFrame([("t", 2, "B", 10.0, "8:05:00"), ("t", 1, "A", 0.0, "8:00:00")], "trip_id string, stop_sequence int, stop_id string, stop_m double, arrival_time string")
    documents = sinks.processed_routes(shapes, stops, runs, calls)
    own = documents.first()
    assert [p.seq for p in own.shapes["H"]] == [0, 1] and own.stops["B"].stop_name == "Other" and [x.stop_id for x in own.trips["t"].stop_times] == ["A", "B"]
    sinks.export_processed_routes(documents, str(tmp_path / "routes"))
    assert (tmp_path / "routes" / "route_key=1").exists()


def _street(spark):
    points = spark.createDataFrame([("H", k, 0.0, k * 0.001) for k in range(6)], "shape_id string, seq int, lat double, lon double")
    return trips.shape_segments(points)


def test_backfill_day(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    start = 1_767_283_200  # 2026-01-01 08:00 local time
    head = "idx,trip_id,route_id,lon,lat,bearing,speed,timestamp,vehicle_id,start_date\n"
    for k in range(6):
        rows = [f"0,t,1,{k * 0.001},0.0,0,3,{start + 60 * k},v,20260101", f"1,,1,0,0,0,0,{start},w,20260101", f"2,t2,1,x,0,0,0,{start},w,20260101", f"3,t3,1,0,0,0,0,{start},w,20260102"]
        (source / f"{start + 60 * k}.csv").write_text(head + "\n".join(rows) + "\n")
    (source / "1000.csv").write_text(head + f"0,t,1,0.004,0.0,0,3,{start + 5},v,20260101\n")
    assert schedule_files.read_positions_csv(spark, str(source), "2026-01-01").count() == 6
    shapes = _street(spark).withColumn("trip_id", F.lit("t"))
    plan = spark.createDataFrame([("t", k, f"S{k}", "1", 111.19 * k, f"08:0{k}:00") for k in range(1, 5)] + [("t", 5, "S5", "1", 600.0, "08:05:00")], "trip_id string, stop_sequence int, stop_id string, route_id string, stop_m double, arrival_time string")
    counts = backfill.backfill_day(spark, str(source), "2026-01-01", shapes, plan, str(tmp_path / "out"))
    assert counts == {"observations": 5, "probes": 6}
    store = DayStore(spark, str(tmp_path / "out"))
    own = {x.stop_sequence: x for x in store.read("observations").collect()}
    assert all(abs(own[k].delay_seconds) <= 1 for k in range(1, 5)) and own[5].delay_seconds == 0 and own[3].leg_avg_speed_mps == pytest.approx(111.19 / 60, rel=0.02) and not own[5].is_stale
    probe = store.read("probes").orderBy("observed_at").collect()
    assert probe[0].bearing_deg is None and probe[2].nearest_stop_seq == 2 and probe[2].dist_along_route_m == pytest.approx(222.4, abs=0.2)
    backfill.backfill_day(spark, str(source), "2026-01-01", shapes, plan, str(tmp_path / "out"))
    assert store.read("observations").count() == schedule_files.obs_for_range(spark, store, "2026-01-01", "2026-01-31").count() == 5


def test_files(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,stop_lat\nA, Main,37.8\nB,,37.9,x\n")
    assert [tuple(x) for x in schedule_files.read_schedule_table(spark, str(tmp_path), "stops").collect()] == [("A", "Main", "37.8", ""), ("B", "", "37.9", "")]
    (tmp_path / "snap.json").write_text('[{"id":"1","vehicle":{"vehicle":{"id":"v"},"trip":{"trip_id":"t","route_id":"r","start_date":"20260424"},"position":{"latitude":1.0,"longitude":2.0,"speed":0},"timestamp":1700000000}},{"id":"2","vehicle":{"trip":{}}}]')
    row = schedule_files.read_positions_json(spark, str(tmp_path / "snap.json")).collect()
    assert len(row) == 1 and row[0].speed is None and row[0].service_date == dt.date(2026, 4, 24)
    rows = spark.createDataFrame([(dt.date(2026, 1, d), "1", f"t{d}") for d in (1, 2)], "service_date date, route_id string, trip_id string")
    for _ in range(2):
        sinks.overwrite_service_dates(rows, str(tmp_path / "obs"))
    sinks.overwrite_service_dates(rows.where("trip_id = 't1'"), str(tmp_path / "obs"))
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 2
    with pytest.raises(ValueError):
        sinks.overwrite_service_dates(rows.where("false"), str(tmp_path / "obs"))


def test_streams_equal_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(v, f"{v}{m // 40}", start + dt.timedelta(minutes=m)) for v in "ab" for m in (*range(0, 60, 5), *range(100, 120, 5))]
    rows.append(("z", "z0", start + dt.timedelta(days=1)))
    spark.createDataFrame(rows, "vehicle_id string, trip_id string, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("vehicle_id string, trip_id string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    got = {(x.vehicle_id, x.probes) for x in run(live.session_trips(source), "sessions")}
    assert got == {("a", 12), ("b", 12), ("a", 4), ("b", 4)}


def test_live_volume_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    own = spark.createDataFrame([(f"r{k % 2}", start + dt.timedelta(minutes=7 * k)) for k in range(30)] + [("r9", start + dt.timedelta(days=2))], "route_id string, ts timestamp")
    own.write.parquet(str(tmp_path / "in"))
    query = live.live_volume_15min(spark.readStream.schema("route_id string, ts timestamp").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("volume").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(x.route_id, x.w.start, x["count"]) for x in own.where("route_id <> 'r9'").groupBy("route_id", F.window("ts", "15 minutes").alias("w")).count().collect()}
    assert {(x.route_id, x.start, x.n) for x in spark.table("volume").collect()} == want
