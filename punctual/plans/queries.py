"""The transit operators as queries over the derived tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import columns as c
from punctual.operators import observations as o
from punctual.operators import reportcard, schedule, screenline, speeds, trips, waits
from punctual.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def r(x: str, digits: int = 1) -> str:
    return f"trunc(({x}) * {10**digits} + CASE WHEN ({x}) < 0 THEN -0.5 ELSE 0.5 END) / {10**digits}"


def pct(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, fx.SQL + sql
        return f

    return add


_BANDS = {"on_time_pct": "delay_seconds BETWEEN 0 AND 180", "within_5_pct": "delay_seconds BETWEEN 0 AND 300", "within_7_pct": "delay_seconds BETWEEN 0 AND 420", "early_pct": "delay_seconds < 0", "late_pct": "delay_seconds > 180", "very_late_pct": "delay_seconds > 420"}
_PUNCTUAL = ", ".join(f"coalesce({r(pct(x))}, 0) AS {k}" for k, x in _BANDS.items())
q = lambda p, x="delay_seconds": f"quantile_disc({x}, {p})"


@query("SELECT service_date, trip_id, stop_sequence, route_id, delay_seconds, is_stale, sched_s FROM dedup")
def dedup_observations(spark, sf_dir):
    own = o.dedup_observations(fx.raw_observations(spark, sf_dir), fx.TIES)
    return own.select("service_date", "trip_id", "stop_sequence", "route_id", "delay_seconds", "is_stale", F.unix_seconds("scheduled_arrival").alias("sched_s"))


@query("SELECT service_date, trip_id, stop_sequence, count(*) OVER (PARTITION BY service_date, trip_id, stop_sequence) AS copies FROM raw")
def finalization_copies(spark, sf_dir):
    return o.finalization_copies(fx.raw_observations(spark, sf_dir)).select(*o.KEY, "copies")


@query(f"SELECT (SELECT count(DISTINCT (service_date, trip_id)) FROM arr) AS trips, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles, {_PUNCTUAL}, {q(0.5)} AS p50_delay_s, {q(0.95)} AS p95_delay_s, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph FROM fresh")
def system_stats(spark, sf_dir):
    return o.system_stats(fx.observed(spark, sf_dir))


@query(f"SELECT service_date, route_id, count(DISTINCT trip_id) AS trips, count(*) AS observations, {_PUNCTUAL}, {', '.join(f'{q(p / 100)} AS p{p}_delay_s' for p in (5, 25, 50, 75, 95))}, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph FROM fresh GROUP BY ALL")
def route_stats(spark, sf_dir):
    return o.route_stats(fx.observed(spark, sf_dir))


@query("SELECT CASE WHEN delay_seconds < -900 THEN -15 WHEN delay_seconds > 2700 THEN 45 ELSE floor(delay_seconds / 60) END::INT AS minute, count(*) AS n FROM fresh GROUP BY 1")
def delay_minute_histogram(spark, sf_dir):
    return o.delay_minute_histogram(fx.observed(spark, sf_dir))


_VOLUME = "SELECT service_date, route_id, bucket, count(*) AS n FROM (SELECT *, floor(trunc((act_s - epoch(service_date::TIMESTAMP)::BIGINT - 25200) / 60.0) / 15)::INT AS bucket FROM fresh) WHERE bucket BETWEEN 0 AND 95 GROUP BY 1, 2, 3"


@query(_VOLUME)
def volume_15min(spark, sf_dir):
    return o.volume_15min(fx.observed(spark, sf_dir))


@query(f""", vol AS ({_VOLUME}), lim AS (SELECT service_date, route_id FROM trips GROUP BY 1, 2 HAVING count(*) < 10 AND regexp_matches(route_id, '[^A-Za-z]')),
op AS (SELECT * FROM vol ANTI JOIN lim USING (service_date, route_id)), rk AS (SELECT service_date, route_id, row_number() OVER (PARTITION BY service_date ORDER BY t DESC, route_id) AS k FROM (SELECT service_date, route_id, sum(n) AS t FROM op GROUP BY 1, 2)),
sh AS (SELECT service_date, route_id, CASE WHEN k <= 5 THEN route_id ELSE 'Other' END AS series FROM rk), nm AS (SELECT service_date, series, bucket, sum(n)::BIGINT AS n FROM op JOIN sh USING (service_date, route_id) GROUP BY 1, 2, 3)
SELECT service_date, series AS route_id, b::INT AS bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT service_date, series, b AS bucket, b FROM sh, unnest(range(96)) AS u(b)) LEFT JOIN nm USING (service_date, series, bucket)""")
def volume_top_n(spark, sf_dir):
    planned = fx.scheduled_trips(spark, sf_dir).groupBy("service_date", "route_id").agg(F.count("*").alias("runs"))
    return o.volume_top_n(o.volume_15min(fx.observed(spark, sf_dir)), planned.where(c.is_limited(F.col("route_id"), F.col("runs"))), 5)


@query(f""", own AS (SELECT dow, hour, count(*) AS n, {q(0.5)} AS p50, {q(0.95)} AS p95 FROM fresh GROUP BY ALL)
SELECT d::INT AS dow, h::INT AS hour, coalesce(n, 0) AS n, CASE WHEN n >= 10 THEN p50 END AS p50_delay_s, CASE WHEN n >= 10 THEN p95 END AS p95_delay_s FROM unnest(range(1, 8)) AS a(d), unnest(range(24)) AS b(h) LEFT JOIN own ON dow = d AND hour = h""")
def delay_heatmap(spark, sf_dir):
    return o.delay_heatmap(fx.observed(spark, sf_dir))


@query(f"SELECT route_id, hour::INT AS hour, count(*) AS n, {q(0.5)} AS p50_delay_s, {q(0.95)} AS p95_delay_s FROM fresh GROUP BY 1, 2 HAVING count(*) >= 10")
def route_delay_by_hour(spark, sf_dir):
    return o.route_delay_by_hour(fx.observed(spark, sf_dir))


@query(f"SELECT route_id, count(*) AS n, {q(0.5)} AS p50_delay_s FROM fresh GROUP BY 1 HAVING count(*) >= 10")
def route_overall_delay(spark, sf_dir):
    return o.route_overall_delay(fx.observed(spark, sf_dir))


@query(f"SELECT week_start, route_id, stop_id, count(*) AS n, {q(0.5)} AS p50_delay_s, {q(0.95)} AS p95_delay_s, {r('stddev_samp(delay_seconds)')} AS stddev_delay_s FROM fresh GROUP BY ALL")
def route_stop_week(spark, sf_dir):
    return o.route_stop_week(fx.observed(spark, sf_dir))


@query("SELECT service_date, trip_id, max(stop_sequence) AS last_sequence FROM arr GROUP BY ALL")
def trip_progress(spark, sf_dir):
    return o.trip_progress(fx.observed(spark, sf_dir))


_AUDIT = f""", a AS (SELECT service_date, count(*) AS raw_rows FROM raw GROUP BY 1), b AS (SELECT service_date, count(*) AS rows, count(DISTINCT route_id) AS routes, count(DISTINCT CASE WHEN act_s IS NOT NULL THEN trip_id END) AS trips, count(DISTINCT CASE WHEN act_s IS NOT NULL THEN vehicle_id END) AS vehicles, count(act_s) AS arrivals, count(*) FILTER (act_s IS NOT NULL AND NOT is_stale) AS fresh_arrivals FROM dedup GROUP BY 1),
au AS (SELECT *, raw_rows - rows AS duplicates, {r('100.0::DOUBLE * (raw_rows - rows) / raw_rows')} AS duplicate_pct FROM a JOIN b USING (service_date))"""


@query(_AUDIT + " SELECT * FROM au")
def audit_daily(spark, sf_dir):
    raw = fx.raw_observations(spark, sf_dir)
    return o.audit_daily(raw, o.dedup_observations(raw, fx.TIES))


_BAND_COUNTS = {"delivered": "BETWEEN -60 AND 420", "on_time": "BETWEEN 0 AND 180", "early": "< 0", "late": "> 180", "very_late": "> 420"}
_DELIVERY = "count(DISTINCT service_date) AS service_days, count(*) AS scheduled_stop_rows, count(DISTINCT CASE WHEN act_s IS NOT NULL THEN service_date::VARCHAR || '|' || trip_id END) AS observed_trips, count(act_s) AS arrivals, " + ", ".join(f"count(*) FILTER (act_s IS NOT NULL AND delay_seconds {x}) AS {k}" for k, x in _BAND_COUNTS.items())
_PERIOD_ROUTES = f""", pr0 AS (SELECT *, {fx.SQL_PERIOD} AS period FROM obs WHERE service_date NOT IN (date '2026-06-03')), prr AS (SELECT CASE WHEN grouping(route_id) = 1 THEN 'group' ELSE 'route' END AS grain, period, route_group, route_id, {_DELIVERY}, {', '.join(f'{q(p / 100)} AS p{p}_delay_s' for p in (5, 50, 95))} FROM pr0 WHERE period IS NOT NULL GROUP BY GROUPING SETS ((period, route_group), (period, route_group, route_id)))"""


def _study_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.exclude_dates(fx.observed(spark, sf_dir), ["2026-06-03"])


def _period(day: str = "service_date"):
    return c.study_period(F.col(day), fx.PERIODS)


@query(_PERIOD_ROUTES + " SELECT * FROM prr")
def period_route_rollup(spark, sf_dir):
    return o.period_route_rollup(_study_obs(spark, sf_dir), _period())


@query(f"SELECT week_start, route_group, {_DELIVERY}, {', '.join(f'{q(p / 100)} AS p{p}_delay_s' for p in (50, 95))} FROM obs GROUP BY 1, 2")
def weekly_group_rollup(spark, sf_dir):
    return o.weekly_group_rollup(fx.observed(spark, sf_dir))


@query(f"SELECT route_id, {r(pct('delay_seconds <= 60'), 3)} AS on_time_pct, {q(0.95)} AS p95_delay_s FROM arr WHERE service_date > date '2026-06-06' GROUP BY 1")
def route_on_time_rate(spark, sf_dir):
    return o.route_on_time_rate(fx.observed(spark, sf_dir), F.lit("2026-06-13").cast("date"))


_SEGMENTS = ", sg0 AS (SELECT *, lead({'q': stop_sequence, 'id': stop_id, 't': act_s, 's': sched_s}) OVER (PARTITION BY service_date, trip_id ORDER BY stop_sequence) AS nx FROM obs), sg AS (SELECT service_date, route_id, trip_id, stop_sequence, stop_id AS from_stop, nx.id AS to_stop, 352.0::DOUBLE AS distance_m, nx.s - sched_s AS scheduled_s, nx.t - act_s AS runtime_s FROM sg0 WHERE nx.q = stop_sequence + 1)"


@query(_SEGMENTS + f" SELECT *, {r('CASE WHEN runtime_s <> 0 THEN distance_m / runtime_s END * 2.236936', 3)} AS speed_mph FROM sg")
def segments(spark, sf_dir):
    own = o.segments(fx.observed(spark, sf_dir), F.col("stop_sequence") * fx.STOP_M)
    return own.select("service_date", "route_id", "trip_id", "stop_sequence", "from_stop", "to_stop", "distance_m", "scheduled_s", "runtime_s", c.rounded(F.col("speed_mph"), 3).alias("speed_mph"))


_STOPS = ", st AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY service_date, trip_id) AS stops, max(CASE WHEN pickup_type <> 1 THEN stop_sequence END) OVER (PARTITION BY service_date, trip_id) AS last_boarding FROM plan WINDOW w AS (PARTITION BY service_date, trip_id ORDER BY stop_sequence))"


@query(_STOPS + " SELECT service_date, trip_id, stop_sequence, pos AS position, last_boarding, pos > 1 AND pos < stops AND pickup_type <> 1 AS scored FROM st")
def stop_plan(spark, sf_dir):
    return schedule.stop_plan(fx.plan(spark, sf_dir)).select("service_date", "trip_id", "stop_sequence", F.col("position").cast("long"), "last_boarding", "scored")


@query("SELECT service_date, route_id, direction_id, trip_id, min(sched_s) AS starts_s FROM plan GROUP BY ALL")
def scheduled_runs(spark, sf_dir):
    return schedule.scheduled_runs(fx.plan(spark, sf_dir)).select("service_date", "route_id", "direction_id", "trip_id", F.unix_seconds("starts").alias("starts_s"))


@query(_STOPS + f", dl AS (SELECT service_date, route_id, count(*) AS scored, count(x.trip_id) AS delivered FROM st LEFT JOIN (SELECT service_date, trip_id, stop_sequence FROM arr WHERE delay_seconds BETWEEN -60 AND 420) x USING (service_date, trip_id, stop_sequence) WHERE pos > 1 AND pos < stops AND pickup_type <> 1 GROUP BY ALL) SELECT *, {r('100.0::DOUBLE * delivered / scored')} AS delivered_pct FROM dl")
def route_stop_delivery(spark, sf_dir):
    return schedule.route_stop_delivery(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir))


@query("SELECT service_date, route_id, trip_id FROM trips ANTI JOIN arr USING (service_date, trip_id)")
def dropped_trips(spark, sf_dir):
    return schedule.dropped_trips(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)).select("service_date", "route_id", "trip_id")


@query("SELECT service_date, route_id, trip_id FROM trips SEMI JOIN arr USING (service_date, trip_id)")
def ran_trips(spark, sf_dir):
    return schedule.ran_trips(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)).select("service_date", "route_id", "trip_id")


_SEEN = ", seen AS (SELECT DISTINCT service_date, trip_id, 1 AS ran FROM arr), daily AS (SELECT service_date, route_id, count(*) AS scheduled, count(ran) AS ran FROM trips LEFT JOIN seen USING (service_date, trip_id) GROUP BY ALL)"


@query(_SEEN + f" SELECT *, {r('100.0::DOUBLE * ran / scheduled')} AS delivered_pct FROM daily")
def daily_service_delivered(spark, sf_dir):
    return schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir))


@query(_SEEN + f" SELECT route_id, count(*) AS days, {r('avg(scheduled)')} AS runs_per_day FROM daily WHERE scheduled > 0 GROUP BY 1")
def scheduled_runs_per_day(spark, sf_dir):
    return schedule.scheduled_runs_per_day(schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), fx.observed(spark, sf_dir)))


@query(_STOPS + f", dl AS (SELECT service_date, route_id, count(*) AS scored, count(x.trip_id) AS delivered FROM st LEFT JOIN (SELECT service_date, trip_id, stop_sequence FROM arr WHERE delay_seconds BETWEEN -60 AND 420) x USING (service_date, trip_id, stop_sequence) WHERE pos > 1 AND pos < stops AND pickup_type <> 1 GROUP BY ALL), wk AS (SELECT service_date - dayofweek(service_date)::INT AS week_start, route_id, count(*) AS days, sum(scored)::BIGINT AS scored, sum(delivered)::BIGINT AS delivered FROM dl GROUP BY 1, 2) SELECT *, {r('100.0::DOUBLE * delivered / scored')} AS delivered_pct FROM wk")
def week_stop_delivery(spark, sf_dir):
    return schedule.week_stop_delivery(schedule.route_stop_delivery(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir)))


_GAPS_SEEN = _SEEN + ", runs AS (SELECT service_date, route_id, direction_id, trip_id, min(sched_s) AS s FROM plan GROUP BY ALL), g AS (SELECT r.*, coalesce(ran, 0) AS ok, lag(coalesce(ran, 0)) OVER (PARTITION BY service_date, route_id, direction_id ORDER BY s, trip_id) AS before FROM runs r LEFT JOIN seen USING (service_date, trip_id)), gw AS (SELECT service_date, route_id, count(*) FILTER (ok = 0 AND before = 0) AS gap_windows FROM g GROUP BY ALL)"


@query(_GAPS_SEEN + " SELECT * FROM gw")
def gap_windows(spark, sf_dir):
    return schedule.gap_windows(schedule.scheduled_runs(fx.plan(spark, sf_dir)), fx.observed(spark, sf_dir))


_GRID_DAYS = ", ".join(f"max(CASE WHEN dayofweek(service_date) = {k} THEN {r('100.0::DOUBLE * ran / scheduled')} END) AS {d}_pct" for k, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat")))


@query(_GAPS_SEEN + f""", wk AS (SELECT service_date - dayofweek(service_date)::INT AS week_start, route_id, sum(scheduled)::BIGINT AS scheduled, sum(ran)::BIGINT AS ran, count(*) FILTER (scheduled > 0) AS active_days, {_GRID_DAYS}, CASE WHEN count(gap_windows) = count(*) FILTER (scheduled > 0) THEN sum(gap_windows)::BIGINT END AS gap_windows FROM daily LEFT JOIN gw USING (service_date, route_id) GROUP BY 1, 2),
w2 AS (SELECT *, {r('scheduled::DOUBLE / active_days')} AS runs_per_day FROM wk), dl AS (SELECT week_start, route_id, {q(0.5)} AS p50_delay_s FROM fresh GROUP BY 1, 2) SELECT w2.*, runs_per_day < 10 AND regexp_matches(route_id, '[^A-Za-z]') AS limited, p50_delay_s FROM w2 LEFT JOIN dl USING (week_start, route_id)""")
def route_week_grid(spark, sf_dir):
    obs = fx.observed(spark, sf_dir)
    delays = o.fresh(obs).groupBy(c.week_start(F.col("service_date")).alias("week_start"), "route_id").agg(c.percentile("delay_seconds", 0.5).alias("p50_delay_s"))
    gaps = schedule.gap_windows(schedule.scheduled_runs(fx.plan(spark, sf_dir)), obs)
    return schedule.route_week_grid(schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), obs), gaps, delays)


_SHORT = _STOPS + f""", p AS (SELECT service_date, trip_id, max(stop_sequence) AS last_sequence FROM arr GROUP BY ALL), f AS (SELECT service_date, st.route_id, trip_id, last_sequence, max(CASE WHEN st.stop_sequence = last_sequence THEN pos END) AS a, max(CASE WHEN st.stop_sequence = last_boarding THEN pos END) AS b FROM st JOIN p USING (service_date, trip_id) WHERE last_sequence < last_boarding GROUP BY ALL),
ns AS (SELECT service_date, route_id, trip_id, last_sequence, 100.0::DOUBLE * a / b AS pct FROM f WHERE a IS NOT NULL), nc AS (SELECT service_date, route_id, trip_id, last_sequence, pct, {r('pct')} AS completed_pct, least(trunc(pct / 10), 9)::INT AS bucket FROM ns)"""


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.trips_not_completed(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir))


@query(_SHORT + " SELECT * EXCLUDE (pct) FROM nc")
def trips_not_completed(spark, sf_dir):
    return _short(spark, sf_dir).drop("pct")


def _floor_at(x: str, p: float) -> str:
    return f"list_sort(list({x}))[least(trunc(count(*) * {p}), count(*) - 1)::INT + 1]"


@query(_SHORT + f" SELECT service_date, count(*) AS trips, {', '.join(f'count(*) FILTER (bucket = {k}) AS bucket_{k}' for k in range(10))}, {', '.join(f'{r(_floor_at("pct", p / 100))} AS p{p}_pct' for p in (5, 25, 50, 75, 95))} FROM nc GROUP BY 1")
def completion_distribution(spark, sf_dir):
    return schedule.completion_distribution(_short(spark, sf_dir))


_DISTORTION = """, inst AS (SELECT service_date, route_id, stop_id, sched_s, count(*) AS k FROM plan GROUP BY ALL), near AS (SELECT *, sched_s - lag(sched_s) OVER w AS b, CASE WHEN k > 1 THEN 0 ELSE lead(sched_s) OVER w - sched_s END AS a FROM inst WINDOW w AS (PARTITION BY service_date, route_id, stop_id ORDER BY sched_s)),
dist AS (SELECT service_date, route_id, trip_id, stop_sequence, 100.0::DOUBLE * delay_seconds / CASE WHEN delay_seconds > 0 THEN b ELSE a END AS percent FROM fresh JOIN near USING (service_date, route_id, stop_id, sched_s) WHERE delay_seconds <> 0 AND CASE WHEN delay_seconds > 0 THEN b ELSE a END > 0)"""


@query(_DISTORTION + " SELECT route_id, CASE WHEN percent <= -100 THEN 0 WHEN percent >= 100 THEN 41 ELSE floor((percent + 100) / 5) + 1 END::INT AS bucket, count(*) AS n FROM dist GROUP BY ALL")
def distortion_histogram(spark, sf_dir):
    return schedule.distortion_histogram(schedule.distortion(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir)))


@query(_DISTORTION + f", k AS (SELECT route_id, percent, row_number() OVER (PARTITION BY route_id ORDER BY percent) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM dist) SELECT route_id, {r('percent')} AS p95_pct FROM k WHERE i = least(trunc(n * 0.95), n - 1)")
def distortion_p95(spark, sf_dir):
    own = schedule.floor_percentile(schedule.distortion(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir)), ["route_id"], "percent", 0.95)
    return own.select("route_id", c.rounded(F.col("percent"), 1).alias("p95_pct"))


_COMPLETION = f""", ct AS (SELECT service_date, route_id, route_group, week_start, {fx.SQL_PERIOD} AS period, trip_id, max(stop_sequence) AS f, max(CASE WHEN act_s IS NOT NULL THEN stop_sequence END) AS l FROM obs GROUP BY ALL), cr AS (SELECT *, 100.0::DOUBLE * l / f AS pct FROM ct WHERE l IS NOT NULL AND f > 0),
cp AS (SELECT period, week_start, route_group, CASE WHEN grouping(period) = 1 THEN 'week' ELSE 'period' END AS grain, count(*) AS ran, count(*) FILTER (l >= f) AS reached, count(*) FILTER (l < f) AS incomplete, count(*) FILTER (pct < 80) AS below_80, {r(q(0.05, 'pct'), 3)} AS p5_pct, {r(q(0.5, 'pct'), 3)} AS p50_pct FROM cr GROUP BY GROUPING SETS ((period, route_group), (week_start, route_group)))"""


@query(_COMPLETION + " SELECT * FROM cp")
def completion_rollup(spark, sf_dir):
    return schedule.completion_rollup(fx.observed(spark, sf_dir), _period())


_LEAD = ", hw0 AS (SELECT *, lead(act_s) OVER (PARTITION BY route_id, stop_id, service_date ORDER BY act_s, trip_id) - act_s AS s FROM fresh), hw AS (SELECT *, s / 60 AS h FROM hw0 WHERE s BETWEEN 30 AND 5400)"
_LAG = ", lg0 AS (SELECT *, act_s - lag(act_s) OVER (PARTITION BY service_date, route_id, stop_id ORDER BY act_s, trip_id) AS headway_s FROM arr), lg AS (SELECT * FROM lg0 WHERE headway_s BETWEEN 60 AND 7200)"
_BINS = _LAG + f""", bn AS (SELECT {fx.SQL_PERIOD} AS period, week_start, route_group, route_id, (60 * floor(headway_s / 60 + 0.5))::BIGINT AS bin_s FROM lg),
bins AS (SELECT period, week_start, route_group, route_id, bin_s, CASE WHEN grouping(period) = 1 THEN 'week_group' WHEN grouping(route_id) = 1 THEN 'period_group' ELSE 'period_route' END AS grain, count(*) AS n FROM bn GROUP BY GROUPING SETS ((period, route_group, bin_s), (week_start, route_group, bin_s), (period, route_group, route_id, bin_s)))"""
_GRAIN = "grain, period, week_start, route_group, route_id"
# the shortest whole second by which p of the riders have waited, by trying all of them around the answer
_WAIT_AT = "(SELECT min(w) FROM unnest(range(0, 7201)) AS u(w) WHERE list_sum(list_transform(hs, lambda x: x.n * least(w, x.h))) >= {p} * mass)"
_DISTRIBUTION = _BINS + f""", cm AS (SELECT *, sum(n) OVER (PARTITION BY {_GRAIN} ORDER BY bin_s) AS cum, sum(n) OVER (PARTITION BY {_GRAIN}) AS al FROM bins),
dq AS (SELECT {_GRAIN}, sum(n)::BIGINT AS n, min(CASE WHEN cum >= 0.5 * al THEN bin_s END) AS p50_headway_s, min(CASE WHEN cum >= 0.9 * al THEN bin_s END) AS p90_headway_s, {r('sum(n * bin_s * bin_s)::DOUBLE / (2 * sum(n * bin_s))::DOUBLE')} AS mean_wait_s, list({{'n': n, 'h': bin_s}}) AS hs, sum(n * bin_s)::DOUBLE AS mass FROM cm GROUP BY {_GRAIN}),
dw AS (SELECT {_GRAIN}, n, p50_headway_s, p90_headway_s, mean_wait_s, {_WAIT_AT.format(p=0.5)}::BIGINT AS p50_wait_s, {_WAIT_AT.format(p=0.9)}::BIGINT AS p90_wait_s FROM dq)"""


@query(_LAG + " SELECT service_date, route_id, stop_id, trip_id, headway_s FROM lg")
def headways_lag(spark, sf_dir):
    return waits.headways_lag(fx.observed(spark, sf_dir))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits.headway_bins(waits.headways_lag(fx.observed(spark, sf_dir)), _period())


@query(_BINS + " SELECT * FROM bins")
def headway_bins(spark, sf_dir):
    return _bins(spark, sf_dir)


@query(_DISTRIBUTION + " SELECT * FROM dw")
def headway_distribution(spark, sf_dir):
    return waits.weighted_headways(_bins(spark, sf_dir))


@query(_DISTRIBUTION + " SELECT route_group, " + ", ".join(f"max(CASE WHEN period = '{p}' THEN mean_wait_s END) AS {p.lower().replace('-', '_')}_wait_s" for p, _, _ in fx.PERIODS) + " FROM dw WHERE grain = 'period_group' AND n >= 500 GROUP BY 1")
def wait_by_group(spark, sf_dir):
    return waits.wait_by_group(waits.weighted_headways(_bins(spark, sf_dir)))


@query(_LAG + " SELECT service_date, route_id, stop_id, trip_id, headway_s FROM lg ORDER BY headway_s DESC, service_date, route_id, stop_id, trip_id LIMIT 25")
def worst_gaps(spark, sf_dir):
    return waits.worst_gaps(waits.headways_lag(fx.observed(spark, sf_dir)))


@query(_LEAD + f" SELECT route_id, day_type, count(*) AS n, {r('avg(h)', 3)} AS mean_headway, {r(q(0.5, 'h'), 3)} AS p50_headway, {r('sum(h * h) / (2 * sum(h))', 3)} AS mean_wait FROM hw GROUP BY ALL")
def wait_summary(spark, sf_dir):
    return waits.wait_summary(waits.headways_lead(fx.observed(spark, sf_dir)))


@query(_LEAD + f", ms AS (SELECT route_id, day_type, b::INT AS bin, sum(greatest(0, least(b + 1, h) - b)) AS mass FROM hw, unnest(range(90)) AS u(b) GROUP BY ALL HAVING mass > 0) SELECT route_id, day_type, bin, {r('mass', 3)} AS mass, {r('mass / sum(mass) OVER (PARTITION BY route_id, day_type)', 3)} AS density FROM ms")
def wait_histogram(spark, sf_dir):
    return waits.wait_histogram(waits.headways_lead(fx.observed(spark, sf_dir)))


_DENSITY = _LEAD + f", ms AS (SELECT route_id, day_type, b::INT AS bin, sum(greatest(0, least(b + 1, h) - b)) AS mass FROM hw, unnest(range(90)) AS u(b) GROUP BY ALL HAVING mass > 0), dn AS (SELECT route_id, day_type, bin, {r('mass / sum(mass) OVER (PARTITION BY route_id, day_type)', 3)} AS density FROM ms), dk AS (SELECT *, round(density * 1000)::BIGINT AS k FROM dn), dc AS (SELECT *, sum(k) OVER (PARTITION BY route_id, day_type ORDER BY bin) AS cum FROM dk)"
_CROSS = lambda p: r(f"coalesce(min(CASE WHEN cum >= {p * 10} THEN {{'bin': bin, 'x': bin + ({p * 10}::DOUBLE - (cum - k)) / k}} END).x, 89.0)")


@query(_DENSITY + f" SELECT route_id, day_type, {', '.join(f'{_CROSS(p)} AS p{p}_min' for p in (50, 95, 99))} FROM dc GROUP BY 1, 2")
def wait_quantiles(spark, sf_dir):
    return waits.wait_quantiles(waits.wait_histogram(waits.headways_lead(fx.observed(spark, sf_dir))), ["route_id", "day_type"])


@query(_LEAD + f", hh AS (SELECT *, count(*) OVER (PARTITION BY route_id, day_type, hour) AS gaps FROM hw), ms AS (SELECT route_id, day_type, hour::INT AS hour, b::INT AS bin, sum(greatest(0, least((b + 1) * 60, s) - b * 60))::BIGINT AS mass_s FROM hh, unnest(range(90)) AS u(b) WHERE gaps >= 5 GROUP BY 1, 2, 3, 4 HAVING mass_s > 0) SELECT *, {r('mass_s::DOUBLE / sum(mass_s) OVER (PARTITION BY route_id, day_type, hour)', 3)} AS density FROM ms")
def wait_histogram_hourly(spark, sf_dir):
    return waits.wait_histogram_hourly(waits.headways_lead(fx.observed(spark, sf_dir)))


@query(_LEAD + f""", ct AS (SELECT route_id, day_type, act_s AS a, act_s + s AS b, k FROM hw, unnest(range(act_s // 3600, (act_s + s - 1) // 3600 + 1)) AS u(k)), sl AS (SELECT *, greatest(a, k * 3600) AS lo, least(b, (k + 1) * 3600) AS hi FROM ct)
SELECT route_id, day_type, ((k - 7) % 24)::INT AS hour, count(*) AS n, sum(hi - lo)::DOUBLE AS covered_s, {r('sum((b - lo) * (b - lo) - (b - hi) * (b - hi))::DOUBLE / 2 / sum(hi - lo)::DOUBLE / 60', 3)} AS expected_wait_min FROM sl GROUP BY 1, 2, 3""")
def expected_wait_by_hour(spark, sf_dir):
    return waits.expected_wait_by_hour(waits.headways_lead(fx.observed(spark, sf_dir)))


_HIST = "SELECT route_id, direction_id, day_type, hour, bin, count(*) AS n FROM (SELECT * REPLACE (hour::INT AS hour), floor(v * 2.2369 / 0.5)::INT AS bin FROM fresh WHERE v BETWEEN 0 AND 35) WHERE bin BETWEEN 0 AND 139 GROUP BY 1, 2, 3, 4, 5"


@query(_HIST)
def leg_speed_hist(spark, sf_dir):
    return speeds.leg_speed_hist(fx.observed(spark, sf_dir), "route_id", "direction_id")


def _summary(hist: str, keys: str, ps: tuple[int, ...]) -> str:
    at = lambda p: r(f"min(CASE WHEN cum >= {p / 100} * total THEN {{'bin': bin, 'x': 0.5 * (bin + ({p / 100}::DOUBLE * total - (cum - n)) / n)}} END).x")
    return f""", hs AS ({hist}), bn AS (SELECT {keys}, bin, sum(n)::BIGINT AS n FROM hs GROUP BY ALL), cm AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin)::BIGINT AS cum, sum(n) OVER (PARTITION BY {keys})::BIGINT AS total, bin * 0.5::DOUBLE + 0.25::DOUBLE AS mid FROM bn)
    SELECT {keys}, sum(n)::BIGINT AS n, {r('sum(n * mid) / sum(n)')} AS mean_mph, CASE WHEN sum(n) > 1 THEN {r('sqrt(greatest(0, sum(n * mid * mid) / sum(n) - (sum(n * mid) / sum(n)) * (sum(n * mid) / sum(n))))')} END AS stddev_mph, {', '.join(f'{at(p)} AS p{p}_mph' for p in ps)} FROM cm GROUP BY {keys}"""


@query(_summary(_HIST, "route_id, direction_id, day_type", (5, 50, 95, 99)))
def speed_summary(spark, sf_dir):
    return speeds.speed_summary(fx.observed(spark, sf_dir))


@query(_summary(_HIST, "route_id, direction_id, day_type, hour", (5, 50, 95, 99)) + " HAVING sum(n) >= 10")
def speed_by_hour(spark, sf_dir):
    return speeds.speed_by_hour(fx.observed(spark, sf_dir))


@query(", pr AS (SELECT service_date, trip_id, stop_sequence, lag(stop_id) OVER (PARTITION BY service_date, trip_id ORDER BY stop_sequence) AS from_stop, stop_id AS to_stop FROM plan)" + _summary("SELECT route_id, direction_id, from_stop, to_stop, floor(v * 2.2369 / 0.5)::INT AS bin, count(*) AS n FROM fresh JOIN pr USING (service_date, trip_id, stop_sequence) WHERE from_stop IS NOT NULL AND v BETWEEN 0 AND 35 GROUP BY ALL HAVING bin BETWEEN 0 AND 139", "route_id, direction_id, from_stop, to_stop", (50,)))
def segment_speed(spark, sf_dir):
    return speeds.segment_speed(fx.observed(spark, sf_dir), fx.plan(spark, sf_dir))


@query(f"SELECT route_id, {r('avg(v)', 3)} AS mean_mps, {r('avg(v) * 2.236936', 3)} AS mean_mph FROM fresh WHERE v IS NOT NULL GROUP BY 1")
def route_leg_speed_rank(spark, sf_dir):
    return speeds.route_leg_speed_rank(fx.observed(spark, sf_dir))


_PROBES = """WITH p0 AS (SELECT user_id AS u, (epoch_us(ts) // 60)::BIGINT AS us FROM events), p1 AS (SELECT *, CASE WHEN trunc((us - lag(us) OVER (PARTITION BY u ORDER BY us)) / 1e6) > 1200 THEN 1 ELSE 0 END AS nw FROM p0), p2 AS (SELECT *, u || '-' || sum(nw) OVER (PARTITION BY u ORDER BY us) AS trip_key FROM p1),
pr AS (SELECT trip_key, us, u % 40 + 1.5::DOUBLE * ((us - min(us) OVER (PARTITION BY trip_key)) / 1e6::DOUBLE) AS d FROM p2), pl AS (SELECT *, lag(d) OVER w AS d0, lag(us) OVER w AS us0 FROM pr WINDOW w AS (PARTITION BY trip_key ORDER BY us)),
st AS (SELECT DISTINCT trip_key, s AS stop_sequence, s * 352.0::DOUBLE AS m FROM pr, unnest(range(1, 41)) AS x(s)),
fc AS (SELECT trip_key, stop_sequence, m, us, d, d0, us0 FROM pl JOIN st USING (trip_key) WHERE d >= m QUALIFY row_number() OVER (PARTITION BY trip_key, stop_sequence ORDER BY us) = 1),
ar AS (SELECT trip_key, stop_sequence::INT AS stop_sequence, (us0 + floor((us - us0) * ((m - d0) / (d - d0))))::BIGINT AS arrived_us FROM fc WHERE d0 IS NOT NULL)"""


@query("")
def detect_arrivals(spark, sf_dir):
    own = fx.probes(spark, sf_dir)
    return trips.detect_arrivals(own, fx.probe_stops(own))


@query("")
def trailing_fallback(spark, sf_dir):
    own = fx.probes(spark, sf_dir)
    stops = fx.probe_stops(own).where("stop_sequence <= 10")
    return trips.trailing_fallback(own, stops, trips.detect_arrivals(own, stops))


SQL["detect_arrivals"] = _PROBES + " SELECT * FROM ar"
SQL["trailing_fallback"] = _PROBES + """, far AS (SELECT trip_key, d AS fd, us AS fu FROM pr QUALIFY row_number() OVER (PARTITION BY trip_key ORDER BY d DESC, us) = 1),
ok AS (SELECT st.trip_key, st.stop_sequence, fu, min(CASE WHEN ar.arrived_us IS NULL AND abs(m - fd) <= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY st.trip_key ORDER BY st.stop_sequence DESC) AS run FROM st JOIN far USING (trip_key) LEFT JOIN ar ON ar.trip_key = st.trip_key AND ar.stop_sequence = st.stop_sequence WHERE st.stop_sequence <= 10)
SELECT trip_key, stop_sequence::INT AS stop_sequence, fu AS arrived_us FROM ok WHERE run = 1"""


_ROUTE_DAYS = _DISTORTION + _SEEN + _STOPS + f""", rs AS (SELECT service_date, route_id, count(DISTINCT trip_id) AS trips, count(*) AS observations, {r(pct('delay_seconds BETWEEN 0 AND 180'))} AS on_time_pct, {r('avg(CASE WHEN v BETWEEN 0 AND 35 THEN v END) * 2.2369')} AS avg_speed_mph, {q(0.95)} AS p95_delay_s FROM fresh GROUP BY 1, 2),
ds AS (SELECT service_date, route_id, {r(_floor_at('percent', 0.5))} AS p50_distortion_pct FROM dist GROUP BY 1, 2), sd AS (SELECT service_date, route_id, count(*) AS scored, count(x.trip_id) AS delivered FROM st LEFT JOIN (SELECT service_date, trip_id, stop_sequence FROM arr WHERE delay_seconds BETWEEN -60 AND 420) x USING (service_date, trip_id, stop_sequence) WHERE pos > 1 AND pos < stops AND pickup_type <> 1 GROUP BY ALL),
rd AS (SELECT service_date, route_id, coalesce(trips, 0) AS trips, coalesce(observations, 0) AS observations, on_time_pct, avg_speed_mph, p95_delay_s, coalesce(scheduled, 0) AS scheduled, coalesce(ran, 0) AS ran, scored, delivered, p50_distortion_pct FROM rs FULL JOIN daily USING (service_date, route_id) LEFT JOIN sd USING (service_date, route_id) LEFT JOIN ds USING (service_date, route_id))"""


def _derived_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, plan = fx.observed(spark, sf_dir), fx.plan(spark, sf_dir)
    return reportcard.route_days(o.route_stats(obs), schedule.daily_service_delivered(fx.scheduled_trips(spark, sf_dir), obs), schedule.route_stop_delivery(plan, obs), schedule.distortion(plan, obs))


def _route_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored daily statistics, from which report cards are made."""
    return fx.stored_table(spark, sf_dir, "route-days", ["orders", "lineitem"], lambda: _derived_days(spark, sf_dir).repartitionByRange("service_date", "route_id"))


@query(_ROUTE_DAYS + " SELECT * FROM rd")
def routes_full(spark, sf_dir):
    return _derived_days(spark, sf_dir)


_KNOWN = lambda x: f"CASE WHEN {x} IS NOT NULL AND observations > 0 THEN observations END"
_MEAN = lambda x: f"sum(round({x} * 10)::BIGINT * ({_KNOWN(x)}))::DOUBLE / sum({_KNOWN(x)})::DOUBLE / 10 AS {x}"
_PARTS = {"delivered_pct": (60, "delivered_pct"), "on_time_pct": (15, "on_time_pct"), "avg_speed_mph": (15, "avg_speed_mph / 13.0 * 100"), "p50_distortion_pct": (10, "100 - abs(p50_distortion_pct)")}
_SCORE = r("(" + " + ".join(f"coalesce(greatest(0, least(100, {x})) * {w}, 0)" for w, x in _PARTS.values()) + ") / nullif(" + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, (w, _) in _PARTS.items()) + ", 0)")
_GRADE = "CASE " + " ".join(f"WHEN score >= {k} THEN '{g}'" for g, k in reportcard.LETTERS) + " END AS grade"


def _card(days: str, by: str) -> str:
    return f"""SELECT *, {_GRADE}, coalesce(runs_per_day < 10 AND regexp_matches(route_id, '[^A-Za-z]'), false) AS limited FROM (SELECT *, {_SCORE} AS score FROM (SELECT {by}route_id, sum(trips)::BIGINT AS trips, sum(observations)::BIGINT AS observations, count(*) FILTER (observations > 0) AS days, sum(scheduled)::BIGINT AS scheduled, coalesce(sum(scored), 0)::BIGINT AS scored, coalesce(sum(scheduled)::DOUBLE / nullif(count(*) FILTER (scheduled > 0), 0), 0.0) AS runs_per_day, 100.0::DOUBLE * sum(delivered) / nullif(sum(scored), 0) AS delivered_pct, {', '.join(map(_MEAN, reportcard.WEIGHED))} FROM {days} GROUP BY ALL))"""


def _agency(card: str, by: str) -> str:
    mean = lambda x: f"sum({x} * observations) / sum(CASE WHEN {x} IS NOT NULL THEN observations END)::DOUBLE AS {x}"
    return f"SELECT *, {_GRADE} FROM (SELECT *, {_SCORE} AS score FROM (SELECT {by}count(*) AS routes, sum(trips)::BIGINT AS trips, sum(observations)::BIGINT AS observations, {', '.join(map(mean, ('delivered_pct', *reportcard.WEIGHED)))} FROM {card} WHERE NOT limited AND score IS NOT NULL AND observations > 0 GROUP BY ALL))"


_SHOWN = ["delivered_pct", *reportcard.WEIGHED]
_ROUNDED = lambda names: ", ".join(f"{r(x, 3)} AS {x}" for x in names)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({x: c.rounded(F.col(x), 3) for x in names})


@query(_ROUTE_DAYS + f", rc AS ({_card('rd', '')}) SELECT * REPLACE ({_ROUNDED([*_SHOWN, 'runs_per_day'])}) FROM rc")
def report_card(spark, sf_dir):
    return _rounded(reportcard.report_card_routes(_route_days(spark, sf_dir)), [*_SHOWN, "runs_per_day"])


@query(_ROUTE_DAYS + f", rc AS ({_card('rd', '')}), ag AS ({_agency('rc', '')}) SELECT * REPLACE ({_ROUNDED(_SHOWN)}) FROM ag")
def agency_score(spark, sf_dir):
    return _rounded(reportcard.agency_score(reportcard.report_card_routes(_route_days(spark, sf_dir))), _SHOWN)


@query(_ROUTE_DAYS + f""", rk AS (SELECT service_date, row_number() OVER (ORDER BY service_date DESC) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT service_date FROM rd)), en AS (SELECT service_date AS end_date, k AS e FROM rk WHERE k % 7 = 0 AND k + 14 <= n), wd AS (SELECT end_date, rd.* FROM rd JOIN rk USING (service_date) JOIN en ON rk.k BETWEEN en.e AND en.e + 13),
hc AS (SELECT * FROM ({_card('wd', 'end_date, ')}) WHERE score IS NOT NULL), ha AS ({_agency('hc', 'end_date, ')}), tp AS (SELECT route_id FROM hc WHERE end_date = (SELECT max(end_date) FROM hc) ORDER BY scheduled DESC, route_id LIMIT 10)
SELECT end_date, route_id, score FROM hc WHERE route_id IN (FROM tp) UNION ALL SELECT end_date, NULL, score FROM ha""")
def grade_history(spark, sf_dir):
    return reportcard.grade_history(_route_days(spark, sf_dir), window=14)


_BAND = "CASE WHEN h < 5 THEN 'Late night' WHEN h < 6 THEN 'Early AM' WHEN h < 9 THEN 'AM peak' WHEN h < 15 THEN 'Midday' WHEN h < 19 THEN 'PM peak' ELSE 'Evening' END AS time_band"
_DAY3 = "CASE dayofweek(service_date) WHEN 0 THEN 'Sunday / holiday' WHEN 6 THEN 'Saturday' ELSE 'Weekday' END AS day_type"
_SCREEN = f""", sc AS (SELECT p.service_date, p.route_id, p.direction_id, p.trip_id, p.sched_s, a.act_s, row_number() OVER w - 1 AS schedule_index, (p.sched_s - lag(p.sched_s) OVER w) / 60.0::DOUBLE AS scheduled_headway_min,
  CASE WHEN a.act_s IS NOT NULL THEN '{screenline.HERE}' WHEN e.trip_id IS NOT NULL THEN '{screenline.ELSEWHERE}' ELSE '{screenline.NOWHERE}' END AS status
  FROM plan p LEFT JOIN arr a ON a.service_date = p.service_date AND a.trip_id = p.trip_id AND a.stop_sequence = p.stop_sequence LEFT JOIN (SELECT DISTINCT service_date, trip_id FROM arr) e ON e.service_date = p.service_date AND e.trip_id = p.trip_id
  WHERE p.stop_id = CASE p.direction_id WHEN 0 THEN 'S4' ELSE 'S3' END WINDOW w AS (PARTITION BY p.service_date, p.route_id, p.direction_id ORDER BY p.sched_s, p.trip_id))"""
_GAPS = _SCREEN + f""", g0 AS (SELECT *, {_DAY3}, {_BAND}, act_s - lag(act_s) OVER w AS headway_s, schedule_index - lag(schedule_index) OVER w - 1 AS missed_slots FROM (SELECT *, ((act_s - 25200) // 3600) % 24 AS h FROM sc WHERE act_s IS NOT NULL) WINDOW w AS (PARTITION BY service_date, route_id, direction_id ORDER BY act_s, trip_id)),
us AS (SELECT route_id, direction_id, day_type, time_band, quantile_cont(round(scheduled_headway_min * 60), 0.5) AS usual_s FROM (SELECT *, {_DAY3}, {_BAND} FROM (SELECT *, ((sched_s - 25200) // 3600) % 24 AS h FROM sc WHERE scheduled_headway_min BETWEEN 1 AND 180)) GROUP BY ALL),
gp AS (SELECT g0.*, headway_s / 60.0::DOUBLE AS headway_min, usual_s, usual_s / 60.0::DOUBLE AS usual_min FROM g0 LEFT JOIN us USING (route_id, direction_id, day_type, time_band) WHERE headway_s BETWEEN 60 AND 10800)"""
_CV = "CASE WHEN count(*) > 1 THEN sqrt(greatest(0.0::DOUBLE, (sum(headway_s * headway_s)::DOUBLE - sum(headway_s)::DOUBLE * sum(headway_s)::DOUBLE / count(*)) / (count(*) - 1))) / (sum(headway_s)::DOUBLE / count(*)) END"


def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screenline.screenline(fx.plan(spark, sf_dir), fx.observed(spark, sf_dir), {0: "S4", 1: "S3"})


@query(_SCREEN + f" SELECT service_date, route_id, direction_id, trip_id, schedule_index, {r('scheduled_headway_min', 3)} AS scheduled_headway_min, status FROM sc")
def screenline_runs(spark, sf_dir):
    return _screen(spark, sf_dir).drop("scheduled_arrival", "actual_arrival").withColumn("scheduled_headway_min", c.rounded(F.col("scheduled_headway_min"), 3))


@query(_GAPS + f" SELECT service_date, route_id, direction_id, trip_id, day_type, time_band, {r('headway_min', 3)} AS headway_min, missed_slots, {r('usual_min', 3)} AS usual_min, {r('headway_s / usual_s::DOUBLE', 3)} AS usual_ratio FROM gp")
def screenline_intervals(spark, sf_dir):
    return screenline.intervals(_screen(spark, sf_dir)).drop("hour", "headway_s", "usual_s").withColumns({x: c.rounded(F.col(x), 3) for x in ("headway_min", "usual_min", "usual_ratio")})


def _part(x: str) -> str:
    return r(f"100.0::DOUBLE * count(*) FILTER ({x}) / count(*)", 3)


_GAP_AT = ", ".join(f"{r(f'floor(quantile_cont(headway_s, {p}) * 100 + 0.5) / 6000.0::DOUBLE', 3)} AS {name}_min" for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))


@query(_GAPS + f""" SELECT route_id, direction_id, day_type, time_band, count(*) AS n, count(DISTINCT service_date) AS service_days, {r('max(usual_s) / 60.0::DOUBLE', 3)} AS usual_min, {_GAP_AT},
  {r('max(headway_s) / 60.0::DOUBLE', 3)} AS max_min, {r('sum(headway_s)::DOUBLE / count(*) / 60', 3)} AS mean_min, {r(_CV, 3)} AS cv, {r('sum(headway_s * headway_s)::DOUBLE / (2 * sum(headway_s)::DOUBLE) / 60', 3)} AS mean_wait_min,
  {_part('headway_s < 0.5 * usual_s')} AS bunching_pct, {_part('headway_s > 1.5 * usual_s')} AS gap_1_5x_pct, {_part('headway_s > 2 * usual_s')} AS gap_2x_pct, {_part('missed_slots > 0')} AS missed_pct FROM gp GROUP BY ALL""")
def headway_summary(spark, sf_dir):
    return screenline.headway_summary(screenline.intervals(_screen(spark, sf_dir)))


@query(_GAPS + f", ct AS (SELECT route_id, direction_id, day_type, headway_min, count(*) AS n FROM gp GROUP BY ALL) SELECT route_id, direction_id, day_type, {r('headway_min', 3)} AS headway_min, n, {r('100.0::DOUBLE * (sum(n) OVER g - sum(n) OVER (g ORDER BY headway_min)) / sum(n) OVER g', 3)} AS longer_pct FROM ct WINDOW g AS (PARTITION BY route_id, direction_id, day_type)")
def headway_survival(spark, sf_dir):
    return screenline.headway_survival(screenline.intervals(_screen(spark, sf_dir))).withColumn("headway_min", c.rounded(F.col("headway_min"), 3))


@query(_GAPS + f""", ds AS (SELECT route_id, direction_id, unnest(range(min(service_date), max(service_date) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS service_date FROM sc GROUP BY 1, 2)
SELECT ds.service_date, ds.route_id, ds.direction_id, max_min FROM ds LEFT JOIN (SELECT service_date, route_id, direction_id, {r('max(headway_min)', 3)} AS max_min FROM gp WHERE time_band = 'Evening' GROUP BY ALL) USING (service_date, route_id, direction_id)""")
def gap_calendar(spark, sf_dir):
    screen = _screen(spark, sf_dir)
    return screenline.gap_calendar(screen, screenline.intervals(screen))


@query(_GAPS + f""", gs AS (SELECT route_id, direction_id, day_type, time_band, round(headway_min * 60) AS s FROM gp), bx AS (SELECT route_id, direction_id, day_type, time_band, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2, quantile_cont(s, 0.75) AS q3 FROM gs GROUP BY ALL)
SELECT route_id, direction_id, day_type, time_band, {r('min(s) / 60.0::DOUBLE', 3)} AS low_min, {r('q1 / 60.0::DOUBLE', 3)} AS q1_min, {r('q2 / 60.0::DOUBLE', 3)} AS median_min, {r('q3 / 60.0::DOUBLE', 3)} AS q3_min, {r('max(s) / 60.0::DOUBLE', 3)} AS high_min
FROM gs JOIN bx USING (route_id, direction_id, day_type, time_band) WHERE s BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY route_id, direction_id, day_type, time_band, q1, q2, q3""")
def boxplot_stats(spark, sf_dir):
    return screenline.boxplot_stats(screenline.intervals(_screen(spark, sf_dir)))


@query(_SCREEN + f", ct AS (SELECT route_id, direction_id, status, count(*) AS n FROM sc GROUP BY ALL) SELECT *, {r('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY route_id, direction_id)')} AS share_pct FROM ct")
def delivery_status_share(spark, sf_dir):
    return screenline.status_share(_screen(spark, sf_dir))


@query(_SCREEN + f", ct AS (SELECT route_id, direction_id, (((sched_s - 25200) // 3600) % 24)::INT AS hour, status, count(*) AS n FROM sc GROUP BY ALL) SELECT *, {r('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY route_id, direction_id, hour)')} AS share_pct FROM ct")
def delivery_by_hour(spark, sf_dir):
    return screenline.status_share(_screen(spark, sf_dir).withColumn("hour", c.local_hour(F.col("scheduled_arrival"))), "hour")


@query(", dy AS (SELECT service_date, count(*) AS arrivals FROM fresh GROUP BY 1) SELECT a.service_date, a.arrivals, w::INT AS weeks_ago, b.arrivals AS before FROM dy a, unnest([1, 2]) AS u(w), dy b WHERE b.service_date = a.service_date - 7 * w::INT")
def prior_same_dow(spark, sf_dir):
    daily = o.fresh(fx.observed(spark, sf_dir)).groupBy("service_date").agg(F.count("*").alias("arrivals"))
    return screenline.prior_same_weekday(daily, "arrivals")


_WAITS = """, {x}ct AS (SELECT route_id, day_type, a, b, k FROM ({rows}), unnest(range(a // 3600, (b - 1) // 3600 + 1)) AS u(k)), {x}sl AS (SELECT *, greatest(a, k * 3600) AS lo, least(b, (k + 1) * 3600) AS hi FROM {x}ct),
{x}ew AS (SELECT route_id, day_type, ((k - 7) % 24)::INT AS hour, count(*) AS n, sum(hi - lo)::DOUBLE AS covered_s, {wait} AS expected_wait_min FROM {x}sl GROUP BY 1, 2, 3)"""
_WAIT = r("sum((b - lo) * (b - lo) - (b - hi) * (b - hi))::DOUBLE / 2 / sum(hi - lo)::DOUBLE / 60", 3)
_DAY2 = "CASE WHEN dayofweek(service_date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type"
_PLANNED = _WAITS.format(x="p", wait=_WAIT, rows=f"SELECT * FROM (SELECT route_id, {_DAY2}, sched_s AS a, lead(sched_s) OVER (PARTITION BY route_id, stop_id, service_date ORDER BY sched_s, trip_id) AS b FROM plan) WHERE b - a BETWEEN 30 AND 5400")
_OBSERVED = _LEAD + _WAITS.format(x="o", wait=_WAIT, rows="SELECT route_id, day_type, act_s AS a, act_s + s AS b FROM hw")


@query(_PLANNED + " SELECT * FROM pew")
def sched_expected_wait(spark, sf_dir):
    return waits.expected_wait_by_hour(waits.scheduled_headways(fx.plan(spark, sf_dir)))


@query(_OBSERVED + _PLANNED + f""", sp AS (SELECT * FROM (SELECT DISTINCT route_id, day_type FROM oew), (SELECT unnest(range(24))::INT AS hour)), bo AS (SELECT sp.*, coalesce(oew.n, 0) AS observed_n, {r('oew.expected_wait_min')} AS observed_min, coalesce(pew.n, 0) AS scheduled_n, {r('pew.expected_wait_min')} AS scheduled_min FROM sp LEFT JOIN oew USING (route_id, day_type, hour) LEFT JOIN pew USING (route_id, day_type, hour))
SELECT *, {r('observed_min - scheduled_min')} AS difference_min FROM bo""")
def obs_vs_sched_wait(spark, sf_dir):
    both = [waits.expected_wait_by_hour(x) for x in (waits.headways_lead(fx.observed(spark, sf_dir)), waits.scheduled_headways(fx.plan(spark, sf_dir)))]
    return waits.observed_vs_scheduled_wait(*both)
