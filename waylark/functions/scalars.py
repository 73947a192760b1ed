"""Scalar functions of the travel and delay domain as Column expressions.

No Python UDF: all of them stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Weather code (WMO) -> ordinal risk. Codes not listed score 0.
WEATHER_RISK = {
    0: 0, 1: 0, 2: 0, 3: 0,
    45: 2, 48: 2,
    51: 1, 53: 1, 55: 2,
    61: 1, 63: 2, 65: 2,
    71: 2, 73: 2, 75: 3,
    80: 1, 81: 2, 82: 2,
    95: 3, 96: 3, 99: 3,
}

# Neutral weather used when nothing was observed.
WEATHER_DEFAULTS = {
    "temperature_c": 20.0,
    "precipitation_mm": 0.0,
    "wind_speed_kmh": 10.0,
    "visibility_m": 10000.0,
    "snowfall_cm": 0.0,
    "weather_code": 0,
}

DELAY_THRESHOLD_MINUTES = 15
NOON = 12
SECONDS_PER_DAY = 86400


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff(
        "MICROSECOND",
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
        as_col(ts).cast("timestamp_ntz"),
    )


def seconds_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Signed seconds from start to end as a double."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1_000_000.0)


def hhmm_hour(value: ColumnLike) -> Column:
    """Hour of a clock number such as 1745; missing or unreadable gives noon."""
    number = as_col(value).try_cast("double")
    hour = F.least(F.lit(23), F.floor(F.floor(number) / 100))
    return F.when(number.isNull() | F.isnan(number), F.lit(NOON)).otherwise(hour).cast("int")


def day_of_week(value: ColumnLike) -> Column:
    """Monday is 0."""
    return F.weekday(as_col(value))


def is_overnight(hour: ColumnLike) -> Column:
    h = as_col(hour)
    return F.when((h >= 21) | (h <= 5), 1).otherwise(0)


def duration_proxy(distance: ColumnLike) -> Column:
    """Minutes of flight guessed from miles; ties go to the even minute."""
    return F.rint(as_col(distance) / F.lit(7.0))


def weather_risk(code: ColumnLike) -> Column:
    table = F.create_map(*[F.lit(v) for pair in WEATHER_RISK.items() for v in pair])
    return F.coalesce(F.try_element_at(table, as_col(code).cast("int")), F.lit(0))


def to_number(value: ColumnLike) -> Column:
    """Double, or null when the text is not a number."""
    return nan_to_null(as_col(value).try_cast("double"))


def nan_to_null(value: ColumnLike) -> Column:
    c = as_col(value)
    return F.when(~F.isnan(c), c)


def delay_label(
    arrival_delay: ColumnLike,
    cancelled: ColumnLike,
    threshold: float = DELAY_THRESHOLD_MINUTES,
) -> Column:
    """1 when more than `threshold` minutes late or cancelled; nulls count as on time."""
    late = F.coalesce(as_col(arrival_delay) > threshold, F.lit(False))
    gone = F.coalesce(as_col(cancelled) == 1, F.lit(False))
    return F.when(late | gone, 1).otherwise(0)


def norm_text(value: ColumnLike, trim: bool = True) -> Column:
    c = F.lower(as_col(value))
    return F.trim(c) if trim else c


def equals_ignoring_case(a: ColumnLike, b: ColumnLike, trim: bool = False) -> Column:
    return norm_text(a, trim) == norm_text(b, trim)


def title_case(value: ColumnLike) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    spaced = F.regexp_replace(F.lower(as_col(value)), r"([^\p{L}]+)", "$1\u0001 ")
    return F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit(""))


def whole_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Completed days from start to end, rounded towards minus infinity."""
    return F.floor(seconds_between(start, end) / SECONDS_PER_DAY).cast("int")


def has_layover(minutes: ColumnLike) -> Column:
    return F.when(F.coalesce(as_col(minutes), F.lit(0)) > 0, 1).otherwise(0)


def clamp_probability(p: ColumnLike) -> Column:
    c = as_col(p)
    # least and greatest skip nulls, so a missing probability needs its own guard
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def risk_band(p: ColumnLike) -> Column:
    """low / moderate / high on the whole percentage (halves round up)."""
    pct = F.floor(as_col(p) * 100 + 0.5)
    return F.when(pct < 20, "low").when(pct < 50, "moderate").when(pct >= 50, "high")


def booking_status(match_ts: ColumnLike, now: Column, open_days: int = 30) -> Column:
    """struct(days, status, opens_in) of a match seen from `now`."""
    days = F.ceil(seconds_between(now, match_ts) / SECONDS_PER_DAY).cast("int")
    status = (
        F.when((days > 0) & (days <= open_days), "open")
        .when(days > open_days, "upcoming")
        .otherwise("passed")
    )
    opens_in = F.when(days > open_days, days - open_days)
    return F.struct(days.alias("days"), status.alias("status"), opens_in.alias("opens_in"))


def elapsed_minutes(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole minutes between two timestamps, halves rounded up."""
    return F.floor(seconds_between(start, end) / 60 + 0.5).cast("int")


def arrival_window(match_ts: ColumnLike, arrival_ts: ColumnLike, days: int = 3, hours: int = 5) -> Column:
    """Arrival between midnight `days` before the match day and `hours` before kick-off."""
    m = as_col(match_ts).cast("timestamp_ntz")
    low = F.date_sub(m.cast("date"), days).cast("timestamp_ntz")
    high = m - F.expr(f"INTERVAL {int(hours)} HOURS")
    return as_col(arrival_ts).between(low, high)


def date_bucket(match_ts: ColumnLike, bucket: str, now: Column) -> Column:
    """Half-open date buckets: today, tomorrow, week, all."""
    spans = {"today": (0, 1), "tomorrow": (1, 2), "week": (0, 7)}
    if bucket == "all":
        return F.lit(True)
    if bucket not in spans:
        raise ValueError(f"unknown date bucket: {bucket}")
    start, end = spans[bucket]
    day = now.cast("date")
    m = as_col(match_ts).cast("timestamp_ntz")
    return (m >= F.date_add(day, start).cast("timestamp_ntz")) & (
        m < F.date_add(day, end).cast("timestamp_ntz")
    )


def local_ts(text: str) -> Column:
    """A zone-less timestamp constant."""
    return F.lit(text).cast("timestamp_ntz")
