"""Live positions to stored observations: the stream against batch, its state, the store of days, and projection by a grid."""

import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from punctual.operators import trips
from punctual.sources import schedule_files
from punctual.sources.day_store import TABLES, DayStore
from punctual.streaming import tracking

START = 1_767_283_200  # 2026-01-01 08:00 local time
KEEP = ["service_date", "route_id", "trip_id", "vehicle_id", "stop_sequence", "stop_id", "scheduled_arrival", "actual_arrival", "delay_seconds", "leg_distance_m", "leg_duration_s", "leg_avg_speed_mps", "is_stale"]


@pytest.fixture(scope="module")
def segments(spark):
    return trips.shape_segments(spark.createDataFrame([("H", k, 0.0, k * 0.001) for k in range(6)], "shape_id string, seq int, lat double, lon double")).persist()


@pytest.fixture(scope="module")
def shapes_of(spark):
    return spark.createDataFrame([(t, "H") for t in "abcde"], "trip_id string, shape_id string")


@pytest.fixture(scope="module")
def stops(spark):
    return spark.createDataFrame([(t, k, f"S{k}", 111.19 * k, f"08:0{k}:00") for t in "abcde" for k in range(1, 5)], "trip_id string, stop_sequence int, stop_id string, stop_m double, arrival_time string")


def _entity(vehicle, trip, seconds, x, **more):
    own = {"vehicle": {"id": vehicle}, "trip": {"trip_id": trip, "route_id": f"r{trip}", "start_date": "20260101"}, "position": {"latitude": 0.0, "longitude": x * 0.001, "speed": 0}, "timestamp": START + seconds}
    return {"id": vehicle, "vehicle": own | more}


def _write(folder, seconds, entities):
    folder.mkdir(exist_ok=True)
    (folder / f"{START + seconds}.json").write_text(json.dumps(entities))


#: Seconds to (vehicle, trip, place); a is completed, b preempted, c and d stale, e is not over; z is not planned.
FIXES = {60 * m: [("v", "a", m)] for m in range(6)}
FIXES |= {600: [("v", "b", 0.5)], 660: [("v", "b", 2.5)], 720: [("v", "c", 0.2)], 780: [("v", "c", 3.9), ("z", "zz", 1)]}
for _at, _x in ((0, 1.5), (60, 2.2), (120, 2.1), (180, 3.5)):
    FIXES[_at] = [*FIXES.get(_at, []), ("w", "d", _x)]
FIXES[24 * 3600] = [("y", "e", 0)]


def _run(spark, folder, store, checkpoint, plan, files=100, **how):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # of the state, too
    shapes_of, segments, stops = plan
    positions = tracking.cleaned(schedule_files.positions_stream(spark, str(folder), files))
    ended = tracking.ended_trips(tracking.with_plan(positions, shapes_of, segments, stops))
    query = tracking.finalized_stream_sink(ended, stops, store, str(checkpoint), **how).trigger(availableNow=True).start()
    query.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if query.exception():
        raise query.exception()
    return query


def _batch(spark, folder, plan, leave_out="false"):
    shapes_of, segments, stops = plan
    own = schedule_files.read_positions_json(spark, str(folder)).where(f"not ({leave_out})").dropDuplicates(["vehicle_id", "trip_id", "ts"]).withColumns({"trip_key": F.concat_ws("|", "vehicle_id", "trip_id"), "plat": F.col("lat"), "plon": F.col("lon")}).persist()
    heads = own.select("trip_key", "trip_id", "route_id", "service_date").distinct()
    planned = heads.join(stops, "trip_id").withColumn("scheduled_us", F.unix_micros(trips.c.scheduled_ts(F.col("service_date"), F.col("arrival_time"))))
    rows = trips.finalized(own.select("trip_key", "vehicle_id", "ts", "plat", "plon"), heads.join(shapes_of, "trip_id").select("trip_key", "shape_id"), segments, planned)
    return sorted(map(str, trips.stored_observations(rows, F.lit(None).cast("timestamp")).where("trip_id <> 'e'").select(*KEEP).collect()))


def _stored(spark, store):
    return sorted(map(str, schedule_files.obs_for_range(spark, store, "2026-01-01", "2026-01-01").where("trip_id <> 'e'").select(*KEEP).collect()))


def test_stream_equals_batch_over_a_restart(spark, tmp_path, shapes_of, segments, stops):
    """Snapshots in two runs, with defective entities, repeated files' rows and a bus that stands still; the gauges of both runs from the state."""
    plan, store, source = (shapes_of, segments, stops), DayStore(spark, str(tmp_path / "store")), tmp_path / "in"
    seconds = sorted(FIXES)
    for at in seconds[:4]:
        _write(source, at, [_entity(v, t, at, x) for v, t, x in FIXES[at]] + [{"id": "q", "vehicle": {"trip": {}}}])
    query = _run(spark, source, store, tmp_path / "checkpoint", plan)
    seen = [p["observedMetrics"]["positions"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(x["entities"] for x in seen) == 12 and sum(x["defective"] for x in seen) == 4
    first = max(p["batchId"] for p in query.recentProgress)
    state = {x.vehicle_id: x for x in tracking.state_of(spark, str(tmp_path / "checkpoint"), "trip", first).select("key.vehicle_id", "value.*").collect()}
    assert {v: (s.trip_id, s.n_fixes, s.ended) for v, s in state.items()} == {"v": ("a", 4, False), "w": ("d", 4, False)}
    gauges = lambda now, batch: tuple(tracking.live_gauges(spark, str(tmp_path / "checkpoint"), (START + now) * 1_000_000, batch).first())
    assert gauges(200, first) == (2, 0, 0) and gauges(180 + 1201, first) == (2, 2, 0)
    for at in seconds[4:]:
        _write(source, at, [_entity(v, t, at, x) for v, t, x in FIXES[at]])
    _write(source, 781, [_entity("v", "c", 780, 3.9)] * 2)  # stands still, and twice in a file
    query = _run(spark, source, store, tmp_path / "checkpoint", plan)
    last = max(p["batchId"] for p in query.recentProgress)
    assert gauges(24 * 3600, last) == (1, 0, 0) and gauges(0, first) == (2, 0, 0)
    want = _batch(spark, source, plan)
    got = _stored(spark, store)
    assert not set(got) ^ set(want) and len(want) == 16
    rows = store.read("probes", "2026-01-01", "2026-01-01")
    assert {x.trip_id: x.n for x in rows.groupBy("trip_id").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 2, "c": 2, "d": 4, "zz": 1}
    assert rows.where("trip_id = 'zz' and dist_along_route_m is null").count() == 1
    before = store.versions("2026-01-01")
    _run(spark, source, store, tmp_path / "checkpoint", plan)
    assert store.versions("2026-01-01") == before and _stored(spark, store) == want
    store.compact("2026-01-01")
    assert len(store.versions("2026-01-01")) == 1 and store.clean("2026-01-01") == 2 * len(before) and _stored(spark, store) == want


def test_failed_batch_is_written_again(spark, tmp_path, shapes_of, segments, stops):
    """An error behind the writes of a batch: the next run writes the batch again, under the same name."""
    plan, store, source = (shapes_of, segments, stops), DayStore(spark, str(tmp_path / "store")), tmp_path / "in"
    for at, fixes in FIXES.items():
        _write(source, at, [_entity(v, t, at, x) for v, t, x in fixes])

    def fail(batch, number):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        _run(spark, source, store, tmp_path / "checkpoint", plan, then=fail)
    versions = store.versions("2026-01-01")
    assert len(versions) == 1
    _run(spark, source, store, tmp_path / "checkpoint", plan)
    assert versions[0] in store.versions("2026-01-01") and _stored(spark, store) == _batch(spark, source, plan)
    counts = store.read("observations").groupBy("trip_id", "stop_sequence").count()
    assert counts.where("count > 1").count() == 0


def test_repeated_late_and_reordered_files(spark, tmp_path, shapes_of, segments, stops):
    """Rows that come again, too late or behind newer ones of their vehicle change nothing: the rest in batch gives the same."""
    plan, store, source = (shapes_of, segments, stops), DayStore(spark, str(tmp_path / "store")), tmp_path / "in"
    late, older = ("x", "e", 3), ("v", "b", 1.5)
    seconds = sorted(FIXES)

    source.mkdir()
    some = lambda first, last: [_entity(v, t, at, x) for at in seconds if first <= at <= last for v, t, x in FIXES[at]]
    day = 24 * 3600
    steps = [some(0, 300), some(600, 780), some(660, 660), [_entity(*older[:2], 630, older[2])], some(day, day), [_entity("y", "e", day + 60, 0)], [_entity(*late[:2], 300, late[2])]]
    for k, (at, entities) in enumerate(zip((300, 780, 660, 630, day, day + 60, 300), steps, strict=True)):  # again, behind a newer one, too late
        (source / f"{k}-{START + at}.json").write_text(json.dumps(entities))
        os.utime(source / f"{k}-{START + at}.json", (START + k, START + k))  # a batch each, in this order
    query = _run(spark, source, store, tmp_path / "checkpoint", plan, files=1)
    assert tracking.late_rows(query) == 1
    assert _stored(spark, store) == _batch(spark, source, plan, f"vehicle_id = 'x' or trip_id = 'b' and unix_seconds(ts) = {START + 630}")


def test_state_is_bounded(spark, tmp_path, shapes_of, segments, stops):
    """However many fixes a trip has, the state keeps the last 20, and a vehicle's state stays under 4 KB; no plan is in it."""
    plan, store, source = (shapes_of, segments, stops), DayStore(spark, str(tmp_path / "store")), tmp_path / "in"
    for k in range(6):
        _write(source, 100 * k, [_entity(f"v{v}", "a", 100 * k + s, (20 * k + s) / 50) for v in range(30) for s in range(0, 20)])
        os.utime(source / f"{START + 100 * k}.json", (START + k, START + k))
    query = _run(spark, source, store, tmp_path / "checkpoint", plan, files=2)
    fixes = tracking.state_of(spark, str(tmp_path / "checkpoint"), "fixes").groupBy("key.vehicle_id").count()
    assert {x["count"] for x in fixes.collect()} == {20} and fixes.count() == 30
    trip = tracking.state_of(spark, str(tmp_path / "checkpoint"), "trip").select("value.*")
    assert {x.n_fixes for x in trip.collect()} == {120} and not {"sequences", "metres", "stops"} & set(trip.columns)
    own = tracking.state_of(spark, str(tmp_path / "checkpoint"), "fixes").agg(F.sum(F.length(F.to_json("list_element"))).alias("s")).first().s + trip.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("s")).first().s
    assert own / 30 < 4096 and query.lastProgress["stateOperators"]


def test_store_changes_both_tables_at_once(spark, tmp_path, monkeypatch):
    day = lambda d, n: dt.date(2026, 1, d)  # noqa: E731, ARG005
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}

    def frames(d, trip):
        fill = lambda schema: {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in schema.split(", ")}
        return {name: spark.range(1).select(*[(F.lit(f"2026-01-0{d}").cast("date") if k == "service_date" else F.lit(trip) if k == "trip_id" else v).alias(k) for k, v in fill(schema).items()]) for name, schema in TABLES.items()}

    store = DayStore(spark, str(tmp_path))
    assert store.read("observations").count() == 0
    assert store.replace(frames(1, "old"), today=day(5, 0)) == {"observations": 1, "probes": 1}
    store.replace(frames(2, "other"), today=day(5, 0))
    trips_of = lambda d: [[x.trip_id for x in store.read(name, d, d).collect()] for name in TABLES]
    with pytest.raises(ValueError, match="no rows"):
        store.replace(frames(1, "new") | {"probes": empty["probes"]}, today=day(5, 0))
    with pytest.raises(ValueError, match="not over"):
        store.replace(frames(1, "new"), today=day(1, 0))
    bad = frames(1, "new")
    bad["probes"] = bad["probes"].withColumn("lat", F.raise_error(F.lit("between the two")).cast("double"))
    with pytest.raises(Exception, match="between the two"):
        store.replace(bad, today=day(5, 0))
    assert trips_of("2026-01-01") == [["old"], ["old"]]
    with monkeypatch.context() as m:
        m.setattr("punctual.sources.day_store.swap_text", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.replace(frames(1, "new"), today=day(5, 0))
    assert trips_of("2026-01-01") == [["old"], ["old"]]
    store.replace(frames(1, "new"), today=day(5, 0))
    assert trips_of("2026-01-01") == [["new"], ["new"]] and trips_of("2026-01-02") == [["other"], ["other"]]
    assert store.clean("2026-01-01") >= 2 and trips_of("2026-01-01") == [["new"], ["new"]]
    store.add(frames(1, "more"), "x")
    store.add(frames(1, "more"), "x")
    assert sorted(trips_of("2026-01-01")[0]) == ["more", "new"] and store.days("2026-01-02") == ["2026-01-02"]


def test_projection_by_grid(spark):
    """Many shapes, one of 5,000 points, loops, long diagonals and single points: the nearest segment is that of a full search, and rows are never multiplied."""
    import random

    draw = random.Random(4)
    points = [("long", k, 37.0 + 0.0002 * k, -122.0 + 0.0003 * math.sin(k / 50)) for k in range(5000)] + [("dot", 0, 37.5, -122.0)]
    for s in range(40):
        lat, lon = 37 + draw.random() / 10, -122 + draw.random() / 10
        for k in range(12):
            points.append((f"s{s}", k, lat, lon))
            lat, lon = lat + draw.uniform(-1, 1) * (0.02 if s % 3 == 0 else 0.001), lon + (0 if s % 5 == 0 else draw.uniform(-1, 1) * 0.003)
    segments = trips.shape_segments(spark.createDataFrame(points, "shape_id string, seq int, lat double, lon double")).persist()
    fixes = []
    for n in range(600):
        shape, _, lat, lon = draw.choice(points if n % 5 == 0 else points[5000:])
        spread = draw.choice([0, 1e-5, 4e-4, 1e-2, 1.0]) if n % 50 else draw.choice([0, 1e-5, 1e-4])
        fixes.append((n, shape, lat + draw.uniform(-1, 1) * spread, lon + draw.uniform(-1, 1) * spread))
    fixes += [(2000, "none", 37.0, -122.0), (2001, "dot", 37.0, -122.0), (2002, None, 37.0, -122.0)]
    own = spark.createDataFrame(fixes, "point_id long, shape_id string, plat double, plon double")
    placed = trips.project_points(own, segments).collect()
    got = {x.point_id: (x.dist_m, x.off_m) for x in placed}
    assert len(got) == len(placed) == len(fixes)
    by_shape = {}
    for x in segments.orderBy("shape_id", "seg").collect():
        by_shape.setdefault(x.shape_id, []).append(x)
    for n, shape, lat, lon in fixes:
        best = None
        for x in by_shape.get(shape, []):
            k, east = trips.M_PER_DEGREE, math.cos(math.radians(x.lat0))
            px, py, sx, sy = (lon - x.lon) * east * k, (lat - x.lat) * k, (x.lon2 - x.lon) * east * k, (x.lat2 - x.lat) * k
            q = sx * sx + sy * sy
            t = max(0.0, min(1.0, (px * sx + py * sy) / q)) if q > 0 else 0.0
            off2 = (px - t * sx) ** 2 + (py - t * sy) ** 2
            if best is None or off2 < best[0]:
                best = off2, x.along_m + t * x.length_m
        want = (best[1], math.sqrt(best[0])) if best else (0.0, 0.0)
        assert got[n] == pytest.approx(want, abs=1e-5), (n, shape)
    listed = trips.segment_index(segments).where("shape_id = 'long'").agg(F.max(F.size("_near"))).first()[0]
    assert listed < 30  # of 4,999 segments


def test_state_is_asked_once_a_call():
    """A vehicle's trips in one batch don't each ask and change its state; the lists hold what the last trip leaves."""
    from pyspark.sql import Row

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *args: calls.append(name)

    class Handle(State):
        getValueState = getListState = getMapState = lambda self, *args: State()  # noqa: N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 0  # noqa: N815

    tracker = tracking.Tracker()
    tracker.init(Handle())
    rows = [Row(vehicle_id="v", trip_id=f"t{k // 3}", route_id="1", service_date=dt.date(2026, 5, 20), ts_us=k * 10**6, seen_us=k * 10**6, lat=1.0, lon=1.0, bearing=None, speed=None, dist_m=None, nearest_stop_seq=None, sequences=None, metres=None) for k in range(30)]
    ended = list(tracker.handleInputRows(("v",), iter(rows[::-1]), Now()))
    assert [(x.trip_id, x.reason, x.n_fixes, len(x.fixes)) for x in ended] == [(f"t{k}", "preempted", 3, 3) for k in range(9)]
    assert sorted(calls) == ["get", "put", "registerTimer", "update"]
