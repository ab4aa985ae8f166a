"""Column helpers: local time, rounding, buckets and classifiers. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TZ = "America/Los_Angeles"


def local(ts: Column, tz: str = TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_hour(ts: Column, tz: str = TZ) -> Column:
    return F.hour(local(ts, tz))


def midnight(day: Column, tz: str = TZ) -> Column:
    """The instant of local midnight."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, cut toward zero."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("long")


def parse_service_date(text: Column) -> Column:
    """yyyymmdd, else null."""
    return F.when(text.rlike(r"^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def schedule_seconds(text: Column) -> Column:
    """H:M:S, hours also beyond 24, as seconds; null when unusable."""
    part = lambda k: F.try_element_at(F.split(text, ":"), F.lit(k)).try_cast("int")
    return F.when(F.size(F.split(text, ":")) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def scheduled_ts(day: Column, text: Column, tz: str = TZ) -> Column:
    return plus_seconds(midnight(day, tz), schedule_seconds(text))


def service_date_of(ts: Column, tz: str = TZ) -> Column:
    """Local date; hours before 4 belong to the day before."""
    return F.date_sub(F.to_date(local(ts, tz)), F.when(local_hour(ts, tz) < 4, 1).otherwise(0))


def week_start(day: Column) -> Column:
    """Sunday of the week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def last_complete_week_end(day: Column) -> Column:
    """The Saturday strictly before day."""
    return F.date_sub(day, F.dayofweek(day))


def short_stop_name(name: Column) -> Column:
    """A stop's name without the street that all share, kinds of street and what stands in brackets."""
    out = F.regexp_replace(name, F.lit(r" \([^)]*\)"), F.lit(""))
    # fixed values: replacements, in order
    for old, new in (("Broadway & ", ""), ("8th St & Broadway", "8th"), ("College Av & Broadway", "College"), ("W MacArthur Blvd", "MacArthur"), ("W Grand Av", "Grand Av"), (" St", ""), (" Av", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(name.contains("(20th St)"), "20th").otherwise(out)


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, by arithmetic alone."""
    scale = 10**digits
    return (x * scale + F.when(x < 0, -0.5).otherwise(0.5)).cast("long") / scale


def share(condition: Column) -> Column:
    """Percentage of rows that meet condition, nulls left out."""
    return F.avg(F.when(condition, 100.0).when(~condition, 0.0))


def percentile(x: str, p: float, kind: str = "bigint") -> Column:
    """The value at share p of the sorted group, exactly. State grows with distinct values, which whole seconds bound."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})").cast(kind)


def percentiles(x: str, ps: tuple[float, ...]) -> Column:
    """percentile() at several shares, as an array: the group's values are kept once."""
    return F.expr(f"percentile_disc(array({', '.join(map(str, ps))})) WITHIN GROUP (ORDER BY {x})").cast("array<bigint>")


def quarter_hour(day: Column, ts: Column, tz: str = TZ) -> Column:
    """Quarter of an hour since local midnight, by whole minutes cut toward zero: the minute before midnight counts to the first quarter."""
    minutes = ((F.unix_micros(ts) - F.unix_micros(midnight(day, tz))) / 60_000_000).cast("long")
    return F.floor(minutes / 15).cast("int")


def delay_minute(delay: Column) -> Column:
    return F.when(delay < -900, -15).when(delay > 2700, 45).otherwise(F.floor(delay / 60)).cast("int")


def distortion_bucket(percent: Column) -> Column:
    """42 buckets: 0 up to -100, steps of 5, 41 from 100."""
    return F.when(percent <= -100, 0).when(percent >= 100, 41).otherwise((F.floor((percent + 100) / 5) + 1).cast("int")).cast("int")


def day_type(day: Column) -> Column:
    return F.when(F.dayofweek(day).isin(1, 7), "weekend").otherwise("weekday")


def day_type3(day: Column, holidays: list[str] | None = None) -> Column:
    return F.when((F.dayofweek(day) == 1) | day.cast("string").isin(holidays or []), "Sunday / holiday").when(F.dayofweek(day) == 7, "Saturday").otherwise("Weekday")


def time_band(hour: Column) -> Column:
    h = hour % 24
    return F.when(h < 5, "Late night").when(h < 6, "Early AM").when(h < 9, "AM peak").when(h < 15, "Midday").when(h < 19, "PM peak").otherwise("Evening")


# fixed values: routes by kind of service, study periods
EARLY_BIRD = ["701", "702", "703"]
ALL_NIGHTER = ["800", "801", "802", "805", "840", "851"]
TRANSBAY = ["E", "F", "FS", "G", "J", "L", "NL", "NX", "NX3", "O", "P", "U", "V", "W"]
PERIODS = [("Baseline", "2026-05-17", "2026-06-13"), ("Summer", "2026-06-14", "2026-08-08"), ("Post-shift", "2026-08-09", "2026-08-18")]


def route_group(route: Column) -> Column:
    school = route.rlike("^[0-9]+$") & route.try_cast("bigint").between(600, 699)
    return F.when(route.isin(EARLY_BIRD), "Early Bird").when(route.isin(ALL_NIGHTER), "All Nighter").when(school, "School").when(route.isin(TRANSBAY), "Transbay").otherwise("Local / other")


def study_period(day: Column, periods: list[tuple[str, str, str]] | None = None) -> Column:
    """The period that day falls in, null if none; periods: (name, first day, last day)."""
    out = F.lit(None).cast("string")
    for name, first, last in PERIODS if periods is None else periods:
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def sanitize_key(route: Column) -> Column:
    return F.regexp_replace(route, "[^A-Za-z0-9_-]", "_")


def is_limited(route: Column, runs_per_day: Column) -> Column:
    return (runs_per_day < 10) & (route != "") & route.rlike("[^A-Za-z]")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(6_371_000.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
