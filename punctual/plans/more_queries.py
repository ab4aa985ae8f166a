"""Queries over feeds, fixes, study periods and the corridor, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators import documents, feeds, rollups, schedule, sketches, speeds, study, trips
from punctual.operators import observations as o
from punctual.plans import fixtures as fx
from punctual.plans import queries as base
from punctual.plans.queries import QUERIES, SQL, query, r


def alone(sql: str):
    """A query whose SQL does not stand on the observations' tables."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- feeds and schedules
_PICK = lambda names, n, x="t": f"(array[{', '.join(repr(x) for x in names)}])[({x} % {n} + 1)::INT]"
_FEEDS = ", ".join(f"('{n}', date '{a}', date '{b}')" for n, a, b in fx.FEEDS)
_TEMPLATES = f"""fd AS (SELECT * FROM (VALUES {_FEEDS}) AS v(feed, first_day, last_day)), tt AS (SELECT feed, t, 'T' || t AS trip_id, {_PICK(fx.ROUTES, 12)} AS route_id, t % 2 AS direction_id, {_PICK(['WKDY', 'SAT', 'SUN'], 3)} AS service_id, 'H' || ((t // 12) % 4) AS shape_id FROM (SELECT DISTINCT o_orderkey % 500 AS t FROM orders), fd WHERE feed = 'F1' OR t % 5 <> 0),
stt AS (SELECT feed, trip_id, s AS stop_sequence, 'S' || s AS stop_id, 18000 + t * 7919 % 72000 + (s - 1) * 300 AS scheduled_s FROM tt, unnest(range(1, 8)) AS u(s) WHERE s < 7 OR t % 7 > 2),
dt AS (SELECT DISTINCT service_date FROM trips), cal AS (SELECT DISTINCT feed, service_id FROM tt),
act0 AS (SELECT service_date, feed, service_id FROM dt, cal WHERE CASE service_id WHEN 'WKDY' THEN dayofweek(service_date) BETWEEN 1 AND 5 WHEN 'SAT' THEN dayofweek(service_date) = 6 ELSE dayofweek(service_date) = 0 END AND NOT (service_id = 'WKDY' AND service_date = date '{fx.HOLIDAYS[0]}')),
act AS (SELECT * FROM act0 UNION SELECT service_date, feed, service_id FROM dt, cal WHERE service_id = 'SUN' AND service_date = date '{fx.HOLIDAYS[0]}')"""


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scheduled_trips(spark, sf_dir).select("service_date").distinct()


def _first_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.templates(spark, sf_dir).where("feed = 'F1'")


@query(f", {_TEMPLATES} SELECT service_date, service_id FROM act WHERE feed = 'F1'")
def active_services(spark, sf_dir):
    own = _first_feed(spark, sf_dir)
    return schedule.active_services(_dates(spark, sf_dir), fx.calendar(own).drop("feed"), fx.calendar_exceptions(own).drop("feed"))


@query(f", {_TEMPLATES} SELECT DISTINCT service_date, trip_id, route_id, direction_id FROM act JOIN tt USING (feed, service_id) WHERE feed = 'F1'")
def scheduled_trips(spark, sf_dir):
    own = _first_feed(spark, sf_dir)
    return schedule.scheduled_trips(schedule.active_services(_dates(spark, sf_dir), fx.calendar(own).drop("feed"), fx.calendar_exceptions(own).drop("feed")), own)


_EXPANDED = f""", {_TEMPLATES}, sn AS (SELECT DISTINCT 'S' || l_linenumber AS stop_id, CASE WHEN l_linenumber <= 6 THEN 'Broadway & ' || l_linenumber || 'th St' ELSE 'College Av & Main (far side)' END AS stop_name, 37.79 + 0.004::DOUBLE * l_linenumber AS lat FROM lineitem),
ex AS (SELECT service_date, feed, trip_id, route_id, direction_id, stop_sequence, stop_id, stop_name, scheduled_s, (scheduled_s // 3600) % 24 AS h FROM act JOIN fd USING (feed) JOIN tt USING (feed, service_id) JOIN stt USING (feed, trip_id) JOIN sn USING (stop_id) WHERE service_date BETWEEN first_day AND last_day)"""


@query(_EXPANDED + f" SELECT service_date, feed, trip_id, route_id, direction_id, stop_sequence, stop_id, stop_name, scheduled_s, h::INT AS hour, {base._DAY3}, {base._BAND} FROM ex")
def schedule_expand(spark, sf_dir):
    own = fx.templates(spark, sf_dir)
    stops = fx.stop_names(spark, sf_dir).withColumn("feed", F.explode(F.array(*[F.lit(f[0]) for f in fx.FEEDS])))
    out = feeds.schedule_expand(_dates(spark, sf_dir), fx.feeds(spark), fx.calendar(own), fx.calendar_exceptions(own), own.drop("t"), fx.stop_times(own), stops)
    return out.select("service_date", "feed", "trip_id", "route_id", "direction_id", "stop_sequence", "stop_id", "stop_name", "scheduled_s", "hour", "day_type", "time_band")


@query("SELECT DISTINCT service_date, trip_id, route_id FROM obs ANTI JOIN (SELECT service_date, trip_id FROM trips WHERE o_orderkey % 10 <> 3) USING (service_date, trip_id)")
def unscheduled_trips(spark, sf_dir):
    planned = fx.scheduled_trips(spark, sf_dir).where(F.col("trip_id").cast("long") % 10 != 3)  # one trip in ten is not in this schedule
    return schedule.unscheduled_trips(planned, fx.observed(spark, sf_dir))


_MERGED = ", mg AS (SELECT p.service_date, p.route_id, p.trip_id, p.direction_id, p.stop_sequence, p.stop_id, p.sched_s, a.act_s, a.delay_seconds, count(a.act_s) OVER (PARTITION BY p.service_date, p.trip_id) > 0 AS trip_observed FROM plan p LEFT JOIN dedup a ON a.service_date = p.service_date AND a.trip_id = p.trip_id AND a.stop_sequence = p.stop_sequence)"


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.schedule_obs_merge(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir))


@query(_MERGED + " SELECT service_date, trip_id, stop_sequence, stop_id, delay_seconds, trip_observed FROM mg")
def schedule_obs_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("service_date", "trip_id", "stop_sequence", "stop_id", "delay_seconds", "trip_observed")


_MEMBERS = """WITH mb0 AS (SELECT strftime(o_orderdate, '%Y%m') AS archive, o_orderkey % 5 AS k, count(*) AS n FROM orders GROUP BY 1, 2),
mb AS (SELECT archive, (array['stops.txt', 'trips.txt', 'stop_times.txt', 'fare_rules.txt', 'fare_attributes.txt'])[(k + 1)::INT] AS member, sha256(CASE WHEN k < 3 THEN archive[1:4] || '/' || ((archive[5:6]::INT - 1) // 6) ELSE 'fares ' || ((n % 4) // 3) END) AS sha256 FROM mb0),
ah AS (SELECT archive, sha256(string_agg(member || ':' || sha256, '' ORDER BY member)) AS content_sha256 FROM mb GROUP BY 1), ap AS (SELECT archive, lag(archive) OVER (ORDER BY archive) AS before FROM (SELECT DISTINCT archive FROM mb)),
cm AS (SELECT coalesce(n.archive, o.archive) AS archive, coalesce(n.member, o.member) AS member FROM (SELECT mb.* FROM mb JOIN ap USING (archive) WHERE before IS NOT NULL) n FULL JOIN (SELECT ap.archive, mb.member, mb.sha256 FROM ap JOIN mb ON mb.archive = ap.before) o ON n.archive = o.archive AND n.member = o.member WHERE n.sha256 IS DISTINCT FROM o.sha256)"""


@alone(_MEMBERS + " SELECT archive, content_sha256 FROM (SELECT *, lag(content_sha256) OVER (ORDER BY archive) AS b FROM ah) WHERE b IS NULL OR b <> content_sha256")
def feed_versions(spark, sf_dir):
    return feeds.feed_versions(feeds.archive_hashes(fx.archive_members(spark, sf_dir)))


@alone(_MEMBERS + " SELECT * FROM cm")
def changed_members(spark, sf_dir):
    return feeds.changed_members(fx.archive_members(spark, sf_dir))


@alone(_MEMBERS + f""" SELECT archive, content_sha256, coalesce(n, 0) AS changed, CASE WHEN archive = (SELECT min(archive) FROM mb) THEN '{feeds.INITIAL}' WHEN n IS NULL THEN '{feeds.IDENTICAL}' WHEN fares THEN '{feeds.FARES}' ELSE '{feeds.SCHEDULE}' END AS change_scope
FROM ah LEFT JOIN (SELECT archive, count(*) AS n, bool_and(member IN ('fare_attributes.txt', 'fare_rules.txt')) AS fares FROM cm GROUP BY 1) USING (archive)""")
def feed_change_timeline(spark, sf_dir):
    return feeds.feed_change_timeline(fx.archive_members(spark, sf_dir))


@query(""", cv AS (SELECT o_orderkey % 4 AS f, service_date, count(*) FILTER (vehicle_id::BIGINT % 3 = 0 AND (o_orderkey % 4 < 3 OR dayofweek(service_date) NOT IN (0, 6))) AS services FROM trips GROUP BY 1, 2), bs AS (SELECT service_date, 'V' || f AS feed FROM cv WHERE services > 0 QUALIFY row_number() OVER (PARTITION BY service_date ORDER BY f = 3 DESC, f DESC) = 1)
SELECT d.service_date, feed FROM (SELECT DISTINCT service_date FROM trips UNION SELECT DISTINCT service_date + 28 FROM trips) d LEFT JOIN bs USING (service_date)""")
def resolve_feed_for_date(spark, sf_dir):
    dates = _dates(spark, sf_dir)
    return feeds.resolve_feed_for_date(dates.union(dates.select(F.date_add("service_date", 28))), fx.feed_coverage(spark, sf_dir))


@query("SELECT DISTINCT route_id, CASE WHEN route_id IN ('1', '6') THEN upper('a' || route_id || 'bbcc') ELSE 'FFFFFF' END AS color, CASE WHEN route_id = '1' THEN 'FFFFFF' ELSE '000000' END AS text_color FROM trips")
def route_colors(spark, sf_dir):
    known = fx.scheduled_trips(spark, sf_dir).select("route_id").distinct()
    listed = known.where("route_id in ('1', '6', '12')").select("route_id", F.when(F.col("route_id") == "12", " ").otherwise(F.concat(F.lit(" a"), "route_id", F.lit("bbcc"))).alias("route_color"), F.when(F.col("route_id") == "1", "ffffff").alias("route_text_color"))
    return feeds.route_colors(listed, known)


_SNAPSHOTS = f"WITH sp AS (SELECT 'feed' || (user_id % 3) AS feed, date_trunc('hour', ts) AS fetched_at, user_id::VARCHAR AS vehicle_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE {_PICK(fx.ROUTES, 12, 'user_id')} END AS route_id FROM events), rk AS (SELECT feed, fetched_at, row_number() OVER (PARTITION BY feed ORDER BY fetched_at DESC) AS rank FROM (SELECT DISTINCT feed, fetched_at FROM sp))"


@alone(_SNAPSHOTS + " SELECT feed, epoch(fetched_at)::BIGINT AS fetched_s, vehicle_id, route_id, rank FROM sp JOIN rk USING (feed, fetched_at) WHERE rank <= 10")
def snapshot_history(spark, sf_dir):
    return feeds.latest_snapshots(fx.snapshots(spark, sf_dir), 10).select("feed", F.unix_seconds("fetched_at").alias("fetched_s"), "vehicle_id", "route_id", F.col("rank").cast("long"))


@alone(_SNAPSHOTS + " SELECT DISTINCT route_id FROM sp JOIN rk USING (feed, fetched_at) WHERE rank = 1 AND route_id <> ''")
def active_route_ids(spark, sf_dir):
    return feeds.active_route_ids(fx.snapshots(spark, sf_dir))


_SHAPES = """, ln AS (SELECT trip_id, count(*) AS stops FROM stt WHERE feed = 'F1' GROUP BY 1), sc AS (SELECT * FROM (SELECT route_id, direction_id, shape_id, count(*) AS trips FROM tt WHERE feed = 'F1' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY trips DESC, shape_id) = 1),
dm AS (SELECT route_id, direction_id, shape_id, trips, trip_id, stops FROM sc JOIN (SELECT * FROM tt WHERE feed = 'F1') USING (route_id, direction_id, shape_id) JOIN ln USING (trip_id) QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY stops DESC, trip_id) = 1)"""


@query(f", {_TEMPLATES}" + _SHAPES + " SELECT * FROM dm")
def dominant_shape(spark, sf_dir):
    own = _first_feed(spark, sf_dir)
    return feeds.dominant_shapes(own, fx.stop_times(own))


def _stop_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _first_feed(spark, sf_dir)
    return fx.stop_times(own).join(own.select("trip_id", "shape_id"), "trip_id").select("trip_id", "shape_id", "stop_sequence", "stop_id", ((F.col("stop_sequence") - 0.5) * fx.STOP_M).alias("stop_m"))


def _shape_of_every_route(spark: SparkSession) -> DataFrame:
    names = fx.street(spark).withColumn("shape_id", F.explode(F.array(*[F.lit(f"H{k}") for k in range(4)])))
    return trips.shape_segments(names)


@query(f", {_TEMPLATES}" + _SHAPES + " SELECT route_id, direction_id, stop_sequence, 3 AS points FROM dm JOIN stt USING (trip_id) WHERE feed = 'F1' AND stop_sequence > 1")
def route_segment_features(spark, sf_dir):
    own = _first_feed(spark, sf_dir)
    speeds = base.QUERIES["segment_speed"](spark, sf_dir)
    out = feeds.route_segment_features(feeds.dominant_shapes(own, fx.stop_times(own)), _stop_positions(spark, sf_dir).drop("shape_id"), _shape_of_every_route(spark), speeds)
    return out.select("route_id", "direction_id", "stop_sequence", F.size("points").alias("points"))  # each leg lies across one point of the shape


@query(f", {_TEMPLATES} SELECT trip_id, stop_sequence, {r('0.5 * 352 * (2 * stop_sequence - 3)')} AS from_m, 3 AS points, {r(f'-122.0 + 352.0 * (stop_sequence - 1.5) / {fx.M_PER_LON!r}', 6)} AS first_lon, {r(f'-122.0 + 352.0 * (stop_sequence - 0.5) / {fx.M_PER_LON!r}', 6)} AS last_lon FROM stt WHERE feed = 'F1' AND stop_sequence > 1")
def slice_shape(spark, sf_dir):
    own = _stop_positions(spark, sf_dir).where("stop_sequence > 1").select(F.concat_ws("/", "trip_id", "stop_sequence").alias("leg_id"), "trip_id", "shape_id", "stop_sequence", (F.col("stop_m") - fx.STOP_M).alias("from_m"), F.col("stop_m").alias("to_m"))
    out = feeds.slice_shape(_shape_of_every_route(spark), own)
    end = lambda k: c.rounded(F.element_at("points", k)["lon"], 6)
    return out.select("trip_id", "stop_sequence", c.rounded(F.col("from_m"), 1).alias("from_m"), F.size("points").alias("points"), end(1).alias("first_lon"), end(-1).alias("last_lon"))


# ---- from fixes to observations
_FIXES = base._PROBES.replace("pr AS (SELECT trip_key,", "pr AS (SELECT u, trip_key,", 1) + f""", fxs AS (SELECT *, 37.8 + (u % 7) * 1e-4::DOUBLE AS plat, -122.0::DOUBLE + d / {fx.M_PER_LON!r}::DOUBLE AS plon FROM pr),
pt AS (SELECT k, 37.8::DOUBLE AS lat, -122.0::DOUBLE + k * 352 / {fx.M_PER_LON!r}::DOUBLE AS lon FROM unnest(range(42)) AS x(k)), sm0 AS (SELECT k + 1 AS seg, lon, lead(lon) OVER (ORDER BY k) AS lon2 FROM pt),
sm1 AS (SELECT *, 2 * 6371000.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)) AS length_m FROM (SELECT *, cos(radians(37.8::DOUBLE)) * cos(radians(37.8::DOUBLE)) * sin(radians(lon2 - lon) / 2) * sin(radians(lon2 - lon) / 2) AS a FROM sm0 WHERE lon2 IS NOT NULL)), sm AS (SELECT *, coalesce(sum(length_m) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along_m FROM sm1),
pj0 AS (SELECT trip_key, us, u, seg, along_m, length_m, (plon - lon) * cos(radians(37.8::DOUBLE)) * 111194.92664455873::DOUBLE AS px, (plat - 37.8::DOUBLE) * 111194.92664455873::DOUBLE AS py, (lon2 - lon) * cos(radians(37.8::DOUBLE)) * 111194.92664455873::DOUBLE AS sx FROM fxs, sm WHERE u % 5 <> 0),
pj1 AS (SELECT *, greatest(0, least(1, px * sx / (sx * sx))) AS t FROM pj0), pj2 AS (SELECT *, (px - t * sx) * (px - t * sx) + py * py AS off2 FROM pj1),
pj AS (SELECT trip_key, us, along_m + t * length_m AS dist_m, sqrt(off2) AS off_m FROM pj2 QUALIFY row_number() OVER (PARTITION BY trip_key, us ORDER BY off2, seg) = 1),
pn AS (SELECT trip_key, s AS stop_sequence, s * 352.0::DOUBLE AS m, min(us) + s * 200000000 AS sched FROM pr, unnest(range(1, 11)) AS x(s) WHERE u % 5 <> 0 GROUP BY 1, 2, 3),
ns AS (SELECT pj.trip_key, pj.us, pn.stop_sequence FROM pj JOIN pn USING (trip_key) QUALIFY row_number() OVER (PARTITION BY pj.trip_key, pj.us ORDER BY abs(pn.m - pj.dist_m), pn.m, pn.stop_sequence) = 1),
fb AS (SELECT trip_key, stop_sequence, fu FROM (SELECT pn.trip_key, pn.stop_sequence, fu, min(CASE WHEN ar.arrived_us IS NULL AND abs(pn.m - fd) <= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY pn.trip_key ORDER BY pn.stop_sequence DESC) AS run FROM pn JOIN (SELECT trip_key, d AS fd, us AS fu FROM pr QUALIFY row_number() OVER (PARTITION BY trip_key ORDER BY d DESC, us) = 1) USING (trip_key) LEFT JOIN ar ON ar.trip_key = pn.trip_key AND ar.stop_sequence = pn.stop_sequence) WHERE run = 1),
aa AS (SELECT pn.trip_key, pn.stop_sequence, pn.m, pn.sched, coalesce(ar.arrived_us, fb.fu) AS t FROM pn LEFT JOIN ar ON ar.trip_key = pn.trip_key AND ar.stop_sequence = pn.stop_sequence LEFT JOIN fb ON fb.trip_key = pn.trip_key AND fb.stop_sequence = pn.stop_sequence),
ob0 AS (SELECT *, CASE WHEN t IS NOT NULL THEN last_value(CASE WHEN t IS NOT NULL THEN {{'m': m, 't': t}} END IGNORE NULLS) OVER (PARTITION BY trip_key ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS pv FROM aa),
ob AS (SELECT trip_key, stop_sequence, t AS arrived_us, trunc((t - sched) / 1e6)::BIGINT AS delay_seconds, CASE WHEN m - pv.m > 0 AND t - pv.t > 0 THEN {r('(m - pv.m) / ((t - pv.t) / 1e6::DOUBLE)', 3)} END AS leg_avg_speed_mps FROM ob0)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixes(spark, sf_dir).withColumn("point_id", F.struct("trip_key", F.unix_micros("ts").alias("us")))


def _street(spark: SparkSession) -> DataFrame:
    return trips.shape_segments(fx.street(spark))


@alone(_FIXES + f" SELECT trip_key, us, {r('dist_m')} AS dist_m, {r('off_m')} AS off_m FROM pj")
def project_points(spark, sf_dir):
    own = _points(spark, sf_dir)
    out = trips.project_points(own.join(fx.probe_trips(own), "trip_key").select("point_id", "shape_id", "plat", "plon"), _street(spark))
    return out.select("point_id.*", c.rounded(F.col("dist_m"), 1).alias("dist_m"), c.rounded(F.col("off_m"), 1).alias("off_m"))


@alone(_FIXES + f" SELECT pr.trip_key, pr.us, {r('dist_m')} AS dist_m, ns.stop_sequence::INT AS nearest_stop_seq FROM pr LEFT JOIN pj USING (trip_key, us) LEFT JOIN ns USING (trip_key, us)")
def project_probes(spark, sf_dir):
    own = _points(spark, sf_dir)
    out = trips.project_probes(own, fx.probe_trips(own), _street(spark), fx.probe_plan(own))
    return out.select("point_id.*", c.rounded(F.col("dist_m"), 1).alias("dist_m"), "nearest_stop_seq")


@alone(_FIXES + " SELECT trip_key, us, stop_sequence::INT AS nearest_stop_seq FROM ns")
def nearest_stop(spark, sf_dir):
    own = fx.probes(spark, sf_dir)
    near = trips.nearest_stop(own.withColumn("point_id", F.struct("trip_key", F.unix_micros("ts").alias("us"))), fx.probe_plan(own))
    return near.select("point_id.*", "nearest_stop_seq")


@query(f", {_TEMPLATES} SELECT DISTINCT trip_id, shape_id, stop_id, {r('352.0 * (stop_sequence - 1)')} AS stop_m FROM stt JOIN tt USING (feed, trip_id) WHERE feed = 'F1'")
def project_stops(spark, sf_dir):
    own = _first_feed(spark, sf_dir)
    at = fx.stop_times(own).join(own.select("trip_id", "shape_id"), "trip_id").select("trip_id", "shape_id", "stop_id", F.lit(fx.LAT).alias("plat"), (F.lit(-122.0) + (F.col("stop_sequence") - 1) * fx.STOP_M / fx.M_PER_LON).alias("plon"))
    return trips.project_stops(at, _shape_of_every_route(spark)).select("trip_id", "shape_id", "stop_id", c.rounded(F.col("stop_m"), 1).alias("stop_m"))


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = fx.probes(spark, sf_dir)
    plan = fx.probe_plan(own)
    found = trips.detect_arrivals(own, plan)
    return plan, found.unionByName(trips.trailing_fallback(own, plan, found))


@alone(_FIXES + " SELECT trip_key, stop_sequence::INT AS stop_sequence, arrived_us, delay_seconds, leg_avg_speed_mps FROM ob")
def observation_rows(spark, sf_dir):
    plan, found = _arrivals(spark, sf_dir)
    return trips.observation_rows(plan, found).select("trip_key", "stop_sequence", "arrived_us", "delay_seconds", c.rounded(F.col("leg_avg_speed_mps"), 3).alias("leg_avg_speed_mps"))


@alone(_FIXES + f", sl AS (SELECT ANY_VALUE(u) AS u, trip_key, min(us) AS a, max(us) AS b FROM pr GROUP BY 2), nx AS (SELECT *, lead(a) OVER (PARTITION BY u ORDER BY a, trip_key) AS n FROM sl), dn AS (SELECT trip_key FROM ob WHERE stop_sequence = 10 AND arrived_us IS NOT NULL) SELECT trip_key, CASE WHEN dn.trip_key IS NOT NULL THEN 'completed' WHEN n - b <= {3600 * 1_000_000} THEN 'preempted' ELSE 'stale' END AS reason FROM nx LEFT JOIN dn USING (trip_key)")
def trip_end_reason(spark, sf_dir):
    own = fx.probes(spark, sf_dir)
    _, found = _arrivals(spark, sf_dir)
    seen = own.groupBy("vehicle_id", "trip_key").agg(F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"))
    return trips.trip_end_reason(seen, found.where("stop_sequence = 10"), stale_s=3600).select("trip_key", "reason")


@alone(_FIXES + " SELECT trip_key, us, nullif((u % 3)::DOUBLE, 0) AS bearing_deg, nullif((u % 4)::DOUBLE, 0) AS reported_speed_mps, nullif((u % 2)::INT, 0) AS nearest_stop_seq FROM pr")
def probe_rows(spark, sf_dir):
    own = fx.probes(spark, sf_dir).withColumns({"bearing_deg": (F.col("u") % 3).cast("double"), "reported_speed_mps": (F.col("u") % 4).cast("double"), "nearest_stop_seq": (F.col("u") % 2).cast("int")})
    return trips.probe_rows(own, F.current_timestamp()).select("trip_key", F.unix_micros("ts").alias("us"), "bearing_deg", "reported_speed_mps", "nearest_stop_seq")


@alone("WITH p AS (SELECT user_id::VARCHAR AS vehicle_id, event_type AS trip_id, epoch_us(ts) // 3600000000 AS h, min(value) AS value, min(event_id) AS e FROM events GROUP BY ALL) SELECT vehicle_id, trip_id, h, value, min(h) OVER w AS first_h, max(h) OVER w AS last_h, first_value(route) OVER (PARTITION BY vehicle_id, trip_id ORDER BY h) AS route_id FROM (SELECT *, 'r' || (h % 3) AS route FROM p) WINDOW w AS (PARTITION BY vehicle_id, trip_id)")
def reconstruct_trips(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    own = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("vehicle_id"), F.col("event_type").alias("trip_id"), hour.alias("ts"), "value", F.concat(F.lit("r"), F.floor(F.unix_seconds(hour) / 3600) % 3).alias("route_id"))
    h = lambda x: F.floor(F.unix_seconds(x) / 3600).alias
    return trips.reconstruct_trips(own).select("vehicle_id", "trip_id", h("ts")("h"), "value", h("first_seen")("first_h"), h("last_seen")("last_h"), "route_id")


@alone(base._PROBES + " SELECT trip_key, us, d AS dist_m FROM pr WHERE trip_key = (SELECT min(trip_key) FROM pr)")
def replay_trip(spark, sf_dir):
    own = fx.stored_probes(spark, sf_dir)
    first = own.agg(F.min(F.struct("trip_key", "service_date")).alias("first")).first().first  # one row
    return trips.replay_trip(own, F.lit(first.service_date), F.lit(first.trip_key)).select("trip_key", F.unix_micros("ts").alias("us"), "dist_m")


# ---- weeks and study periods
@query(base._SHORT + base._SEEN + f""", sd AS (SELECT service_date, route_id, count(*) AS scored, count(x.trip_id) AS delivered FROM st LEFT JOIN (SELECT service_date, trip_id, stop_sequence FROM arr WHERE delay_seconds BETWEEN -60 AND 420) x USING (service_date, trip_id, stop_sequence) WHERE pos > 1 AND pos < stops AND pickup_type <> 1 GROUP BY ALL),
wa AS (SELECT service_date - dayofweek(service_date)::INT AS week_start, sum(scheduled)::BIGINT AS scheduled, sum(ran)::BIGINT AS ran FROM daily GROUP BY 1), wb AS (SELECT service_date - dayofweek(service_date)::INT AS week_start, sum(scored)::BIGINT AS scored, sum(delivered)::BIGINT AS delivered FROM sd GROUP BY 1), wc AS (SELECT service_date - dayofweek(service_date)::INT AS week_start, count(*) AS not_completed FROM nc GROUP BY 1),
wk AS (SELECT week_start, scheduled, ran, coalesce(scored, 0) AS scored, coalesce(delivered, 0) AS delivered, coalesce(not_completed, 0) AS not_completed, scheduled - ran AS dropped FROM wa LEFT JOIN wb USING (week_start) LEFT JOIN wc USING (week_start)) SELECT *, {r('100.0::DOUBLE * ran / scheduled')} AS trips_pct, {r('100.0::DOUBLE * delivered / nullif(scored, 0)')} AS stops_pct FROM wk""")
def weekly_compliance(spark, sf_dir):
    obs, plan = fx.observed(spark, sf_dir), fx.plan(spark, sf_dir)
    return schedule.weekly_compliance(schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), obs), schedule.route_stop_delivery(plan, obs), schedule.trips_not_completed(plan, obs))


SQL["compliance_ratios"] = SQL["weekly_compliance"].rsplit(" SELECT *, trunc", 1)[0] + f" SELECT week_start, {r('100.0::DOUBLE * dropped / scheduled')} AS dropped_pct, {r('100.0::DOUBLE * not_completed / nullif(ran, 0)')} AS not_completed_pct FROM wk"


def compliance_ratios(spark, sf_dir):
    return schedule.compliance_ratios(weekly_compliance(spark, sf_dir))


QUERIES["compliance_ratios"] = compliance_ratios


@query(base._SEEN + f", wk AS (SELECT DISTINCT service_date - dayofweek(service_date)::INT AS week_start, route_id FROM daily), sp AS (SELECT week_start, route_id, week_start + d::INT AS service_date FROM wk, unnest(range(7)) AS u(d)) SELECT sp.*, scheduled, ran, {r('100.0::DOUBLE * ran / scheduled')} AS delivered_pct FROM sp LEFT JOIN daily USING (service_date, route_id)")
def service_week_days(spark, sf_dir):
    return schedule.week_days(schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)), ["route_id"], ["scheduled", "ran", "delivered_pct"])


_DAYS = base._GAPS_SEEN + f""", sd AS (SELECT daily.*, gap_windows, {fx.SQL_PERIOD} AS period, service_date - dayofweek(service_date)::INT AS week_start, CASE WHEN gap_windows IS NOT NULL THEN greatest(scheduled - 1, 0) END AS possible_windows, (SELECT any_value(route_group) FROM obs x WHERE x.route_id = daily.route_id) AS rg0 FROM daily LEFT JOIN gw USING (service_date, route_id)),
s2 AS (SELECT *, CASE WHEN route_id IN ('701') THEN 'Early Bird' WHEN route_id IN ('800') THEN 'All Nighter' WHEN route_id = '600' THEN 'School' WHEN route_id IN ('F', 'NL') THEN 'Transbay' ELSE 'Local / other' END AS route_group FROM sd WHERE {fx.SQL_PERIOD} IS NOT NULL)"""
_ROLLED = lambda keys: f"SELECT *, {r('100.0::DOUBLE * ran / nullif(scheduled, 0)', 3)} AS delivered_pct, {r('100.0::DOUBLE * gap_windows / nullif(possible_windows, 0)', 3)} AS gap_rate_pct FROM (SELECT {keys}, count(DISTINCT service_date) AS service_days, sum(scheduled)::BIGINT AS scheduled, sum(ran)::BIGINT AS ran, sum(gap_windows)::BIGINT AS gap_windows, sum(possible_windows)::BIGINT AS possible_windows FROM s2 GROUP BY {keys})"


def _schedule_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fx.observed(spark, sf_dir)
    gaps = schedule.gap_windows(schedule.scheduled_runs(fx.plan(spark, sf_dir)), obs)
    return rollups.schedule_days(schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), obs), gaps, base._period())


for _name, _keys in {"daily": ["service_date", "week_start", "period", "route_group"], "weekly": ["week_start", "period", "route_group"], "period": ["period", "route_group"], "route": ["period", "route_group", "route_id"]}.items():
    QUERIES[f"schedule_rollup_{_name}"] = lambda spark, sf_dir, keys=_keys: rollups.schedule_rollup(_schedule_days(spark, sf_dir), keys)
    SQL[f"schedule_rollup_{_name}"] = fx.SQL + _DAYS + _ROLLED(", ".join(_keys))


_WIDE = ", ".join(f"max(CASE WHEN period = '{p}' THEN {x} END) AS {k}_{p.lower().replace('-', '_')}" for k, x in (("observed_trips", "observed_trips"), ("stops_pct", "100.0::DOUBLE * delivered / scheduled_stop_rows"), ("on_time_pct", "100.0::DOUBLE * on_time / nullif(arrivals, 0)")) for p, _, _ in fx.PERIODS)
_CHANGES = [(f"{x}_change_{p}", f"{x}_{p} - {x}_baseline") for x in ("stops_pct", "on_time_pct") for p in ("summer", "post_shift")]
_PIVOT = base._PERIOD_ROUTES + f""", pv0 AS (SELECT route_id, route_group, {_WIDE} FROM prr WHERE grain = 'route' GROUP BY 1, 2), pv AS (SELECT route_id, route_group, {', '.join(f'observed_trips_{p}' for p in ('baseline', 'summer', 'post_shift'))}, {', '.join(f"{r(f'{x}_{p}', 3)} AS {x}_{p}" for x in ('stops_pct', 'on_time_pct') for p in ('baseline', 'summer', 'post_shift'))}, {', '.join(f'{r(x, 3)} AS {k}' for k, x in _CHANGES)} FROM pv0)"""


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.scheduled_trips(spark, sf_dir).select("route_id").distinct().where("route_id <> '12'").withColumn("route_name", F.concat(F.lit("Line "), "route_id"))
    return rollups.period_pivot_merge(base.QUERIES["period_route_rollup"](spark, sf_dir), names)


@query(_PIVOT + " SELECT pv.*, CASE WHEN route_id <> '12' THEN 'Line ' || route_id END AS route_name FROM pv")
def period_pivot_merge(spark, sf_dir):
    return _comparison(spark, sf_dir)


_CHANGED = "stops_pct_change_post_shift"


@query(_PIVOT + f", el AS (SELECT route_id, route_group, {_CHANGED} FROM pv WHERE observed_trips_baseline >= 10 AND observed_trips_post_shift >= 5 AND {_CHANGED} IS NOT NULL) (SELECT * FROM el ORDER BY {_CHANGED}, route_id LIMIT 3) UNION (SELECT * FROM el ORDER BY {_CHANGED} DESC, route_id LIMIT 3)")
def route_changes(spark, sf_dir):
    return rollups.route_changes(_comparison(spark, sf_dir), 3, 10, 5)


_METRICS = base._PERIOD_ROUTES + base._COMPLETION + _DAYS + f""", gm AS (SELECT period, route_group, {r('100.0::DOUBLE * delivered / scheduled_stop_rows', 3)} AS stops_pct, {', '.join(f"{r(f'100.0::DOUBLE * {x} / nullif(arrivals, 0)', 3)} AS {x}_pct" for x in ('on_time', 'early', 'very_late'))} FROM prr WHERE grain = 'group'),
gs AS ({_ROLLED('period, route_group')}), gc AS (SELECT period, route_group, {r('100.0::DOUBLE * below_80 / ran', 3)} AS below_80_pct FROM cp WHERE grain = 'period'), gr AS (SELECT gm.*, gs.delivered_pct AS trips_pct, below_80_pct FROM gm JOIN gs USING (period, route_group) LEFT JOIN gc USING (period, route_group))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.group_metrics(base.QUERIES["period_route_rollup"](spark, sf_dir), rollups.schedule_rollup(_schedule_days(spark, sf_dir), ["period", "route_group"]), base.QUERIES["completion_rollup"](spark, sf_dir))


@query(_METRICS + " SELECT * FROM gr")
def group_metrics_merge(spark, sf_dir):
    return _metrics(spark, sf_dir)


_MEASURES = {"Trips delivered": "trips_pct", "Stops delivered": "stops_pct", "Strictly on time": "on_time_pct", "Not severely truncated": "100 - below_80_pct"}


@query(_METRICS + f", lo AS ({' UNION ALL '.join(f"SELECT '{k}' AS measure, period, {x} AS value FROM gr WHERE route_group = 'School'" for k, x in _MEASURES.items())}) SELECT measure, {r("max(CASE WHEN period = 'Baseline' THEN value END)", 3)} AS before_pct, {r("max(CASE WHEN period = 'Post-shift' THEN value END)", 3)} AS after_pct FROM lo GROUP BY 1")
def school_before_after(spark, sf_dir):
    return rollups.before_and_after(_metrics(spark, sf_dir), "School")


@query(base._AUDIT + f" SELECT count(*) AS days, min(service_date) AS first_day, max(service_date) AS last_day, sum(raw_rows)::BIGINT AS raw_rows, sum(rows)::BIGINT AS rows, sum(duplicates)::BIGINT AS duplicates, {r('100.0::DOUBLE * sum(duplicates) / sum(raw_rows)')} AS duplicate_pct FROM au")
def coverage_summary(spark, sf_dir):
    return rollups.coverage_summary(base.QUERIES["audit_daily"](spark, sf_dir))


@query(", dy AS (SELECT service_date, count(*) AS arrivals FROM fresh WHERE dayofweek(service_date) <> 3 GROUP BY 1) SELECT date '2026-05-24' + d::INT AS service_date, arrivals FROM unnest(range(7)) AS u(d) LEFT JOIN dy ON dy.service_date = date '2026-05-24' + d::INT")
def read_daily_rollups(spark, sf_dir):
    daily = o.fresh(fx.observed(spark, sf_dir)).groupBy("service_date").agg(F.count("*").alias("arrivals")).where(F.dayofweek("service_date") != 4)  # Wednesdays are missing
    return rollups.daily_rollups(daily, F.lit("2026-05-24").cast("date"))


@query(", wk AS (SELECT service_date - dayofweek(service_date)::INT + 6 AS week_end FROM (SELECT DISTINCT service_date FROM trips WHERE service_date <> date '2026-06-01') GROUP BY 1 HAVING count(*) = 7), dy AS (SELECT DISTINCT service_date AS day FROM trips) SELECT day, (SELECT max(week_end) FROM wk WHERE week_end <= day - dayofweek(day)::INT - 1) AS week_end FROM dy")
def last_complete_week(spark, sf_dir):
    dates = _dates(spark, sf_dir)
    return rollups.snap_to_week(dates.select(F.col("service_date").alias("day")), rollups.available_weeks(dates.where("service_date <> date '2026-06-01'")))


@query("SELECT service_date, trip_id FROM trips ANTI JOIN arr USING (service_date, trip_id) QUALIFY row_number() OVER (PARTITION BY service_date ORDER BY trip_id) <= 20")
def dropped_sample(spark, sf_dir):
    return schedule.dropped_sample(schedule.dropped_trips(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)))


@query("SELECT d.direction_id, h.day_type, h.hour::INT AS hour, h.bin, sum(n)::BIGINT AS n FROM (SELECT trip_id, day_type, hour, floor(v * 2.2369 / 0.5)::INT AS bin, count(*) AS n FROM fresh WHERE v BETWEEN 0 AND 35 GROUP BY 1, 2, 3, 4 HAVING bin BETWEEN 0 AND 139) h JOIN (SELECT trip_id, direction_id FROM trips WHERE o_orderkey % 10 <> 3) d USING (trip_id) GROUP BY 1, 2, 3, 4")
def trip_direction_lookup(spark, sf_dir):
    known = fx.scheduled_trips(spark, sf_dir).where(F.col("trip_id").cast("long") % 10 != 3).select("trip_id", "direction_id")
    found, _ = speeds.with_directions(speeds.leg_speed_hist(fx.observed(spark, sf_dir), "trip_id"), known)
    return found.groupBy("direction_id", "day_type", "hour", "bin").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT service_date FROM fresh INTERSECT SELECT DISTINCT service_date + 7 FROM fresh")
def dates_with_week_before(spark, sf_dir):
    dates = o.fresh(fx.observed(spark, sf_dir)).select("service_date").distinct()
    return dates.intersect(dates.select(F.date_add("service_date", 7)))


# ---- the corridor
_SHORTENED = "replace(replace(replace(regexp_replace(stop_name, ' \\([^)]*\\)', '', 'g'), 'Broadway & ', ''), ' St', ''), ' Av', '')"
_CORRIDOR = f""", sn AS (SELECT DISTINCT 'S' || l_linenumber AS stop_id, CASE WHEN l_linenumber <= 6 THEN 'Broadway & ' || l_linenumber || 'th St' ELSE 'College Av & Main (far side)' END AS stop_name, 37.79 + 0.004::DOUBLE * l_linenumber AS lat FROM lineitem), ins AS (SELECT stop_id, lat, {_SHORTENED} AS name FROM sn WHERE contains(stop_name, 'Broadway') AND lat >= 37.797),
cg0 AS (SELECT service_date, route_id, direction_id, trip_id, stop_sequence, stop_id AS from_stop, act_s, sched_s, lead({{'q': stop_sequence, 'id': stop_id, 't': act_s, 's': sched_s}}) OVER (PARTITION BY service_date, trip_id ORDER BY stop_sequence) AS nx FROM mg),
cg AS (SELECT service_date, route_id, direction_id, trip_id, stop_sequence, from_stop, nx.id AS to_stop, from_stop || '-' || nx.id AS segment_id, 352.0::DOUBLE AS distance_m, nx.s - sched_s AS scheduled_s, nx.t - act_s AS runtime_s, ((act_s - 25200) // 3600) % 24 AS h, CASE WHEN dayofweek(service_date) = 0 OR service_date = date '{fx.HOLIDAYS[0]}' THEN 'Sunday / holiday' WHEN dayofweek(service_date) = 6 THEN 'Saturday' ELSE 'Weekday' END AS day_type FROM cg0 WHERE nx.q = stop_sequence + 1),
cr AS (SELECT cg.*, {base._BAND}, a.name || ' > ' || b.name AS segment_label, CASE WHEN direction_id = 0 AND from_stop = 'S3' THEN 'third crossing' WHEN direction_id = 1 AND from_stop = 'S4' THEN 'fourth crossing' END AS target_label FROM cg JOIN ins a ON a.stop_id = from_stop JOIN ins b ON b.stop_id = to_stop),
vd AS (SELECT *, h AS hour, target_label IS NOT NULL AS is_target, distance_m / runtime_s * 2.236936 AS speed_mph FROM cr WHERE runtime_s BETWEEN 10 AND 1800)"""
_CORRIDOR_SQL = _MERGED + _CORRIDOR
_QC = lambda x, p: f"quantile_cont({x}, {p})"
_BASE = """, bl AS (SELECT direction_id, segment_id, CASE WHEN count(*) FILTER (day_type = 'Weekday' AND hour IN (5, 6)) >= 20 THEN quantile_cont(runtime_s, 0.5) FILTER (day_type = 'Weekday' AND hour IN (5, 6)) ELSE quantile_cont(runtime_s, 0.15) END AS baseline_s, CASE WHEN count(*) FILTER (day_type = 'Weekday' AND hour IN (5, 6)) >= 20 THEN '%s' ELSE '%s' END AS baseline_method, CASE WHEN count(*) FILTER (day_type = 'Weekday' AND hour IN (5, 6)) >= 20 THEN count(*) FILTER (day_type = 'Weekday' AND hour IN (5, 6)) ELSE count(*) END AS baseline_n FROM vd GROUP BY 1, 2)""" % (study.EARLY_LABEL, study.SHARE_LABEL)


def _corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = study.with_bands(o.segments(_merged(spark, sf_dir), F.col("stop_sequence") * fx.STOP_M), fx.HOLIDAYS)
    return study.corridor_filter(segs, fx.stop_names(spark, sf_dir), "Broadway", 37.797, fx.targets(spark))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.runtime_valid(_corridor(spark, sf_dir))


@query(_CORRIDOR_SQL + " SELECT service_date, trip_id, direction_id, segment_id, segment_label, target_label, day_type, time_band, runtime_s FROM vd")
def corridor_segments(spark, sf_dir):
    return _valid(spark, sf_dir).select("service_date", "trip_id", "direction_id", "segment_id", "segment_label", "target_label", "day_type", "time_band", "runtime_s")


@query(_CORRIDOR_SQL + _BASE + f" SELECT direction_id, segment_id, {r('baseline_s', 3)} AS baseline_s, baseline_method, baseline_n FROM bl")
def segment_baseline(spark, sf_dir):
    return study.segment_baseline(_valid(spark, sf_dir)).withColumn("baseline_s", c.rounded(F.col("baseline_s"), 3))


_OVER = lambda x: r(f"100.0::DOUBLE * (median_s - {x}) / nullif({x}, 0)", 3)
_SUMMARY = _CORRIDOR_SQL + _BASE + f""", sm0 AS (SELECT direction_id, segment_id, day_type, time_band, count(*) AS n, count(DISTINCT service_date) AS service_days, {r(_QC('distance_m', 0.5), 3)} AS distance_m, {_QC('scheduled_s', 0.5)} AS scheduled_s, {_QC('runtime_s', 0.5)} AS median_s, {', '.join(f"{r(_QC('runtime_s', p / 100), 3)} AS p{p}_s" for p in (25, 75, 90, 95))}, max(runtime_s) AS max_s, {r(_QC('speed_mph', 0.5), 3)} AS median_mph FROM vd GROUP BY 1, 2, 3, 4),
sm AS (SELECT sm0.*, {r('baseline_s', 3)} AS baseline_s, baseline_method, baseline_n, {_OVER('baseline_s').replace('baseline_s', 'bl.baseline_s')} AS slowdown_pct, {_OVER('scheduled_s').replace('scheduled_s', 'sm0.scheduled_s')} AS overrun_pct FROM sm0 JOIN bl USING (direction_id, segment_id))"""


def _summary_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.segment_summary(_valid(spark, sf_dir)).withColumn("baseline_s", c.rounded(F.col("baseline_s"), 3))


@query(_SUMMARY + " SELECT * FROM sm")
def segment_summary(spark, sf_dir):
    return _summary_of(spark, sf_dir)


@query(_SUMMARY + " SELECT direction_id, segment_id, n, slowdown_pct FROM sm WHERE day_type = 'Weekday' AND time_band = 'PM peak' AND n >= 5")
def hotspots(spark, sf_dir):
    return study.hotspots(_summary_of(spark, sf_dir), 5).select("direction_id", "segment_id", "n", "slowdown_pct")


_REPS = 200


@query(_CORRIDOR_SQL + f""", dm AS (SELECT direction_id, segment_id, service_date, quantile_cont(runtime_s, 0.5) AS m FROM vd GROUP BY 1, 2, 3), ds AS (SELECT direction_id, segment_id, list(m ORDER BY service_date) AS m, count(*) AS n FROM dm GROUP BY 1, 2),
bt AS (SELECT direction_id, segment_id, rep, quantile_cont(m[((((rep * 7919 + k * 104729 + 12345) * 2654435761 % 4294967296) // 128) % n)::INT + 1], 0.5) AS x FROM ds, unnest(range({_REPS})) AS u(rep), unnest(range(n)) AS v(k) WHERE n >= 5 GROUP BY 1, 2, 3),
ci AS (SELECT direction_id, segment_id, {r(_QC('x', 0.025), 3)} AS low_s, {r(_QC('x', 0.975), 3)} AS high_s FROM bt GROUP BY 1, 2) SELECT direction_id, segment_id, n AS days, low_s, high_s FROM ds LEFT JOIN ci USING (direction_id, segment_id)""")
def bootstrap_median_ci(spark, sf_dir):
    return study.bootstrap_median_ci(_valid(spark, sf_dir), study.SEGMENT, _REPS)


_HDAY = lambda x: f"CASE WHEN dayofweek({x}) = 0 OR {x} = date '{fx.HOLIDAYS[0]}' THEN 'Sunday / holiday' WHEN dayofweek({x}) = 6 THEN 'Saturday' ELSE 'Weekday' END AS day_type"


@query(_MERGED + f", tr AS (SELECT service_date, trip_id, count(*) AS s, count(act_s) AS a FROM mg GROUP BY 1, 2), dy AS (SELECT service_date, count(*) AS scheduled_trips, count(*) FILTER (a > 0) AS observed_trips, sum(s)::BIGINT AS scheduled_stops, sum(a)::BIGINT AS observed_arrivals FROM tr GROUP BY 1) SELECT *, {r('100.0::DOUBLE * observed_trips / scheduled_trips', 3)} AS trips_pct, {r('100.0::DOUBLE * observed_arrivals / scheduled_stops', 3)} AS stops_pct, {_HDAY('service_date')} FROM dy")
def coverage_daily(spark, sf_dir):
    return study.coverage_daily(_merged(spark, sf_dir), fx.HOLIDAYS)


@query(_MERGED + f", un AS (SELECT DISTINCT service_date, trip_id FROM obs ANTI JOIN (SELECT service_date, trip_id FROM trips WHERE o_orderkey % 10 <> 3) USING (service_date, trip_id)) SELECT count(*) AS scheduled_rows, count(DISTINCT (service_date, trip_id)) AS scheduled_trips, count(DISTINCT CASE WHEN trip_observed THEN (service_date, trip_id) END) AS observed_trips, count(DISTINCT service_date) AS service_days, (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM dedup) AS rows, (SELECT count(act_s) FROM dedup) AS arrivals, (SELECT count(*) FROM un) AS unscheduled_trips, {r('(SELECT 100.0::DOUBLE * ((SELECT count(*) FROM raw) - count(*)) / (SELECT count(*) FROM raw) FROM dedup)', 3)} AS duplicate_pct FROM mg")
def study_audit(spark, sf_dir):
    return study.study_audit(_merged(spark, sf_dir), fx.raw_observations(spark, sf_dir), fx.observed(spark, sf_dir), unscheduled_trips(spark, sf_dir))


@query(_CORRIDOR_SQL + f" SELECT direction_id, segment_id, {', '.join(f'quantile_cont(runtime_s, 0.5) FILTER (hour = {h}) AS h{h}_s' for h in range(5, 24))} FROM vd WHERE day_type = 'Weekday' AND hour BETWEEN 5 AND 23 GROUP BY 1, 2")
def hourly_segment_matrix(spark, sf_dir):
    return study.hourly_segment_matrix(_valid(spark, sf_dir))


@query(_CORRIDOR_SQL + f" SELECT direction_id, segment_label, hour::INT AS hour, count(*) AS n, quantile_cont(runtime_s, 0.5) AS median_s, {r(_QC('runtime_s', 0.9), 3)} AS p90_s FROM vd WHERE day_type = 'Weekday' AND is_target AND hour BETWEEN 5 AND 23 GROUP BY 1, 2, 3")
def target_hourly(spark, sf_dir):
    return study.target_hourly(_valid(spark, sf_dir))


@query(_CORRIDOR_SQL + " SELECT direction_id, day_type, time_band, count(*) AS n, quantile_cont(runtime_s, 0.5) AS median_s FROM vd WHERE time_band IN ('AM peak', 'Midday', 'PM peak', 'Evening') GROUP BY 1, 2, 3")
def weekend_runtime(spark, sf_dir):
    return study.weekend_runtime(_valid(spark, sf_dir))


@query(_CORRIDOR_SQL + ", so AS (SELECT direction_id, segment_id, quantile_cont(stop_sequence, 0.5) AS sequence FROM vd GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY direction_id ORDER BY sequence, segment_id) AS place FROM so")
def segment_order(spark, sf_dir):
    return study.segment_order(_valid(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(_CORRIDOR_SQL + " SELECT stop_id, name, lat FROM ins WHERE stop_id IN (SELECT from_stop FROM vd WHERE direction_id = 1 UNION SELECT max_by(to_stop, (stop_sequence, service_date, trip_id)) FROM vd WHERE direction_id = 1)")
def corridor_stops(spark, sf_dir):
    return study.corridor_stops(_valid(spark, sf_dir), fx.stop_names(spark, sf_dir), 1)


_GAPS_ONLY = base._GAPS


@query(_CORRIDOR_SQL + _GAPS_ONLY + f""", fr AS (SELECT direction_id, segment_id, quantile_cont(runtime_s, 0.15) AS f FROM vd WHERE day_type = 'Weekday' AND hour BETWEEN 5 AND 23 GROUP BY 1, 2), ta AS (SELECT direction_id, hour, {r(_QC('100.0::DOUBLE * (runtime_s - f) / f', 0.5), 3)} AS slowdown_pct FROM vd JOIN fr USING (direction_id, segment_id) WHERE day_type = 'Weekday' AND hour BETWEEN 5 AND 23 GROUP BY 1, 2),
tb AS (SELECT direction_id, h AS hour, {r(base._CV, 3)} AS headway_cv FROM gp WHERE day_type = 'Weekday' GROUP BY 1, 2), tc AS (SELECT direction_id, ((sched_s - 25200) // 3600) % 24 AS hour, count(*) AS scheduled, count(act_s) AS observed FROM sc WHERE dayofweek(service_date) NOT IN (0, 6) GROUP BY 1, 2) SELECT direction_id, hour::INT AS hour, slowdown_pct, headway_cv, scheduled, observed, {r('100.0::DOUBLE * (scheduled - observed) / scheduled', 3)} AS missing_pct FROM ta JOIN tb USING (direction_id, hour) JOIN tc USING (direction_id, hour)""")
def traffic_vs_spacing(spark, sf_dir):
    screen = base._screen(spark, sf_dir)
    return study.traffic_vs_spacing(_valid(spark, sf_dir), screen, base.screenline.intervals(screen))


_FEED_OF = "CASE " + " ".join(f"WHEN service_date BETWEEN date '{a}' AND date '{b}' THEN '{n}'" for n, a, b in fx.FEEDS) + " END"


@query(_CORRIDOR_SQL + base._SCREEN + f""", fa AS (SELECT {_FEED_OF} AS feed, direction_id, target_label, time_band, count(*) AS n, quantile_cont(runtime_s, 0.5) AS median_s, {r(_QC('runtime_s', 0.9), 3)} AS p90_s FROM vd WHERE day_type = 'Weekday' AND is_target GROUP BY 1, 2, 3, 4),
fb AS (SELECT feed, direction_id, {base._BAND}, count(*) AS scheduled, count(act_s) AS observed FROM (SELECT *, {_FEED_OF} AS feed, ((sched_s - 25200) // 3600) % 24 AS h FROM sc WHERE dayofweek(service_date) NOT IN (0, 6)) GROUP BY 1, 2, 3) SELECT fa.*, scheduled, observed, {r('100.0::DOUBLE * observed / scheduled', 3)} AS observed_pct FROM fa LEFT JOIN fb USING (feed, direction_id, time_band)""")
def feed_comparison(spark, sf_dir):
    return study.feed_comparison(_valid(spark, sf_dir), base._screen(spark, sf_dir), c.study_period(F.col("service_date"), fx.FEEDS))


@query(_MERGED + _GAPS_ONLY + f""", da AS (SELECT {_HDAY('service_date')}, service_date, trip_id, count(act_s) AS k FROM mg GROUP BY ALL), db AS (SELECT day_type, count(DISTINCT service_date) AS service_days, count(*) AS scheduled_trips, count(*) FILTER (k > 0) AS observed_trips FROM da GROUP BY 1),
dc AS (SELECT {_HDAY('service_date')}, count(*) AS evening_scheduled, count(act_s) AS evening_observed FROM sc WHERE ((sched_s - 25200) // 3600) % 24 >= 19 GROUP BY 1), dd AS (SELECT day_type, count(*) AS evening_gaps, quantile_cont(headway_s, 0.5) AS median_gap_s, {r(_QC('headway_s', 0.9), 3)} AS p90_gap_s, max(headway_s) AS max_gap_s FROM gp WHERE time_band = 'Evening' GROUP BY 1)
SELECT *, {r('100.0::DOUBLE * observed_trips / scheduled_trips', 3)} AS trips_pct, {r('100.0::DOUBLE * evening_observed / evening_scheduled', 3)} AS evening_pct FROM db JOIN dc USING (day_type) JOIN dd USING (day_type)""")
def day_type_summary(spark, sf_dir):
    screen = base._screen(spark, sf_dir)
    return study.day_type_summary(_merged(spark, sf_dir), screen, base.screenline.intervals(screen), fx.HOLIDAYS)


_EVENING = "dayofweek(service_date) NOT IN (0, 6) AND ((sched_s - 25200) // 3600) % 24 >= 19"
_FINDINGS = {
    "corridor_legs": "(SELECT count(*) FROM cr)", "valid_legs": "(SELECT count(*) FROM vd)", "invalid_legs": "(SELECT count(*) FROM cr) - (SELECT count(*) FROM vd)",
    "weekday_pm_peak_target_median_s": "(SELECT quantile_cont(runtime_s, 0.5) FROM vd WHERE day_type = 'Weekday' AND is_target AND time_band = 'PM peak')",
    "weekday_evening_scheduled": f"(SELECT count(*) FROM sc WHERE {_EVENING})", "weekday_evening_observed": f"(SELECT count(act_s) FROM sc WHERE {_EVENING})",
    "max_gap_s": "(SELECT max(headway_s) FROM gp)", "max_evening_gap_s": "(SELECT max(headway_s) FROM gp WHERE time_band = 'Evening')",
}


@query(_CORRIDOR_SQL + _GAPS_ONLY + " " + " UNION ALL ".join(f"SELECT '{k}' AS finding, ({x})::DOUBLE AS value" for k, x in _FINDINGS.items()))
def findings_summary(spark, sf_dir):
    screen = base._screen(spark, sf_dir)
    return study.findings_summary(_corridor(spark, sf_dir), _valid(spark, sf_dir), screen, base.screenline.intervals(screen))


# ---- weeks: exact, from sketches, and as documents
@query(f"""SELECT week_start, (SELECT count(DISTINCT (service_date, trip_id)) FROM arr WHERE arr.week_start = f.week_start) AS trips, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles, {base._PUNCTUAL}, {base.q(0.5)} AS p50_delay_s, {base.q(0.95)} AS p95_delay_s, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph FROM fresh f GROUP BY week_start""")
def weekly_system_stats(spark, sf_dir):
    return o.period_stats(fx.observed(spark, sf_dir).withColumn("week_start", c.week_start(F.col("service_date"))), "week_start")


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored daily sketches."""
    return fx.stored_table(spark, sf_dir, "sketches", ["orders", "lineitem"], lambda: sketches.daily_sketches(fx.observed(spark, sf_dir)).repartitionByRange("service_date", "route_id"))


_WEEK = "week_start"


@query(f"SELECT week_start, count(*) AS observations, {base._PUNCTUAL}, true AS p50_within_1_pct, true AS p95_within_1_pct, true AS trips_within_3_pct, true AS vehicles_within_3_pct FROM fresh GROUP BY week_start")
def sketched_weeks(spark, sf_dir):
    """Weeks from daily sketches alone; quantiles and distinct counts are held against the exact ones."""
    obs = fx.observed(spark, sf_dir).withColumn(_WEEK, c.week_start(F.col("service_date")))
    weeks = sketches.system_stats(sketches.merged(_sketches(spark, sf_dir), c.week_start(F.col("service_date")).alias(_WEEK)), _WEEK)
    exact = o.period_stats(obs, _WEEK).select(_WEEK, *[F.col(x).alias(f"exact_{x}") for x in ("trips", "vehicles")])
    own = weeks.join(exact, _WEEK)
    for p in (50, 95):
        own = own.join(sketches.rank_error(o.fresh(obs), weeks, [_WEEK], "delay_seconds", f"p{p}_delay_s", p / 100).withColumnRenamed("error", f"e{p}"), _WEEK)
    near = lambda x: (F.abs(F.col(x) - F.col(f"exact_{x}")) <= 0.03 * F.col(f"exact_{x}")).alias(f"{x}_within_3_pct")
    return own.select(_WEEK, "observations", *[f"{x}_pct" for x in ("on_time", "within_5", "within_7", "early", "late", "very_late")], *[(F.col(f"e{p}") <= 0.01).alias(f"p{p}_within_1_pct") for p in (50, 95)], near("trips"), near("vehicles"))


@query("SELECT dow::INT AS dow, hour::INT AS hour, count(*) FILTER (NOT is_stale) AS n, true AS p50_within_1_pct, true AS p95_within_1_pct FROM arr GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_stale) >= 10")
def sketched_heatmap(spark, sf_dir):
    cells = sketches.delay_heatmap(_sketches(spark, sf_dir)).where("n >= 10")
    values = o.fresh(fx.observed(spark, sf_dir)).select(F.dayofweek("service_date").alias("dow"), c.local_hour(F.col("actual_arrival")).alias("hour"), "delay_seconds")
    own = cells
    for p in (50, 95):
        own = own.join(sketches.rank_error(values, cells, ["dow", "hour"], "delay_seconds", f"p{p}_delay_s", p / 100).withColumnRenamed("error", f"e{p}"), ["dow", "hour"])
    return own.select("dow", "hour", "n", *[(F.col(f"e{p}") <= 0.01).alias(f"p{p}_within_1_pct") for p in (50, 95)])


def _day_sections(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    obs = fx.observed(spark, sf_dir)
    daily = schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), obs)
    minutes = o.fresh(obs).groupBy("service_date", c.delay_minute(F.col("delay_seconds")).alias("minute")).agg(F.count("*").alias("n"))
    routes = o.route_stats(obs).join(daily.select("service_date", "route_id", "scheduled", "ran"), ["service_date", "route_id"], "full")
    return {"system": o.period_stats(obs, "service_date")}, {"routes": (routes, ["route_id"]), "minutes": (minutes, ["minute"])}


def daily_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The nested document of each day as JSON, and what is read from it again."""
    one, many = _day_sections(spark, sf_dir)
    docs = documents.documents("service_date", one, many)
    return docs, documents.parsed(docs, documents.document_schema("service_date", one, many))


_ROUTE_PS = ", ".join(f"{base.q(p / 100)} AS p{p}_delay_s" for p in (5, 25, 50, 75, 95))


@query(f""", rs AS (SELECT service_date, route_id, count(DISTINCT trip_id) AS trips, count(*) AS observations, {base._PUNCTUAL}, {_ROUTE_PS}, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph FROM fresh GROUP BY ALL),
sd AS (SELECT service_date, route_id, count(*) AS scheduled, count(a.trip_id) AS ran FROM trips LEFT JOIN (SELECT DISTINCT service_date, trip_id FROM arr) a USING (service_date, trip_id) GROUP BY 1, 2) SELECT * FROM rs FULL JOIN sd USING (service_date, route_id)""")
def document_routes(spark, sf_dir):
    """Routes as they come back from the days' documents."""
    return documents.section(daily_documents(spark, sf_dir)[1], "service_date", "routes")


@query(f"SELECT service_date, (SELECT count(DISTINCT trip_id) FROM arr WHERE arr.service_date = f.service_date) AS trips, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles, {base._PUNCTUAL}, {base.q(0.5)} AS p50_delay_s, {base.q(0.95)} AS p95_delay_s, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph FROM fresh f GROUP BY service_date")
def document_system(spark, sf_dir):
    return documents.section(daily_documents(spark, sf_dir)[1], "service_date", "system")


@query("SELECT route_id, (d.service_date - date '2026-05-24') AS day, scheduled, ran FROM (SELECT service_date, route_id, count(*) AS scheduled, count(a.trip_id) AS ran FROM trips LEFT JOIN (SELECT DISTINCT service_date, trip_id FROM arr) a USING (service_date, trip_id) GROUP BY 1, 2) d WHERE d.service_date BETWEEN date '2026-05-24' AND date '2026-05-30' AND dayofweek(d.service_date) <> 3")
def document_week(spark, sf_dir):
    """A week's matrix of days by route, from its document; Wednesdays are missing."""
    daily = schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)).where(F.dayofweek("service_date") != 4)
    many = {"routes": (documents.week_grid(daily, "2026-05-24", ["scheduled", "ran"]), ["route_id"])}
    docs = documents.documents("week_start", {}, many)
    back = documents.section(documents.parsed(docs, documents.document_schema("week_start", {}, many)), "week_start", "routes")
    return back.select("route_id", F.posexplode("days").alias("day", "d")).where("d is not null").select("route_id", F.col("day").cast("long").alias("day"), "d.scheduled", "d.ran")


@query(f"SELECT service_date, route_id, trips, observations, row_number() OVER (PARTITION BY service_date ORDER BY trips DESC, observations DESC, route_id) AS place FROM (SELECT service_date, route_id, count(DISTINCT trip_id) AS trips, count(*) AS observations FROM fresh GROUP BY ALL)")
def busiest_first(spark, sf_dir):
    return o.busiest_first(o.route_stats(fx.observed(spark, sf_dir))).select("service_date", "route_id", "trips", "observations", F.col("place").cast("long"))


# ---- columns
@alone("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders")
def parse_service_date(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyyMMdd")
    own = fx.table(spark, sf_dir, "orders").withColumn("text", F.when(F.col("o_orderkey") % 3 == 2, F.concat(text, F.lit("x"))).otherwise(text))
    return own.select("o_orderkey", c.parse_service_date(F.col("text")).alias("day"))


_CLOCK = "printf('%d:%02d:%02d', h, l_partkey % 60, l_suppkey % 60)"


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a timetable, up to 28 o'clock; one in seven is no time."""
    own = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey").distinct()
    text = F.format_string("%d:%02d:%02d", F.col("l_orderkey") % 29, F.col("l_partkey") % 60, F.col("l_suppkey") % 60)
    return own.withColumn("text", F.when(F.col("l_partkey") % 7 == 0, "soon").otherwise(text))


_SECONDS = "CASE WHEN l_partkey % 7 <> 0 THEN l_orderkey % 29 * 3600 + l_partkey % 60 * 60 + l_suppkey % 60 END"
_LINES = "SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem"


@alone(f"SELECT l_orderkey, l_linenumber, l_partkey, ({_SECONDS})::BIGINT AS s FROM ({_LINES})")
def gtfs_seconds(spark, sf_dir):
    return _clock(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", c.schedule_seconds(F.col("text")).cast("long").alias("s"))


@alone(f"SELECT l_orderkey, l_linenumber, l_partkey, epoch(timezone('America/Los_Angeles', l_shipdate::DATE::TIMESTAMP))::BIGINT + ({_SECONDS})::BIGINT AS s FROM ({_LINES})")
def scheduled_ts(spark, sf_dir):
    return _clock(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.unix_seconds(c.scheduled_ts(F.col("l_shipdate").cast("date"), F.col("text"))).alias("s"))


@alone("SELECT event_id, (timezone('America/Los_Angeles', timezone('UTC', ts)) - INTERVAL 4 HOUR)::DATE AS day FROM events")
def service_date_of(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", c.service_date_of(F.col("ts").cast("timestamp")).alias("day"))


@alone("SELECT o_orderkey, regexp_replace(o_orderpriority || '/' || o_orderstatus, '[^A-Za-z0-9_-]', '_', 'g') AS key FROM orders")
def sanitize_route_key(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", c.sanitize_key(F.concat_ws("/", "o_orderpriority", "o_orderstatus")).alias("key"))
