"""Weather alignment: hourly join with noon fallback, forecast cascade, seasonal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.lookup import lookup_join
from waylark.operators.upsert import dedupe
from waylark.session import pinned

MEASURES = [
    "temperature_c", "precipitation_mm", "weather_code",
    "wind_speed_kmh", "visibility_m", "snowfall_cm",
]
FORECAST_DAYS = 16


def measures_of(df: DataFrame) -> list[str]:
    return [m for m in MEASURES if m in df.columns]


def by_day(weather: DataFrame, airport: str, day: str, hour: str) -> DataFrame:
    """One row per (airport, day) with a map hour -> measures.

    Rows without an hour are left out. Of repeated hours one row counts: the first in
    the order of its measures, present values before missing ones. So a map has at most
    24 entries. It turns the exact-hour and the noon lookup into a single join, and is
    far smaller than the flights.
    """
    cols = measures_of(weather)
    once = dedupe(weather.filter(F.col(hour).isNotNull()), [airport, day, hour], [F.col(c).asc_nulls_last() for c in cols])
    entry = F.struct(F.col(hour).alias("h"), F.struct(*cols).alias("w"))
    return once.groupBy(airport, day).agg(F.map_from_entries(F.collect_list(entry)).alias("hours"))


def join_hourly_weather(
    flights: DataFrame,
    weather: DataFrame,
    airport: tuple[str, str],
    day: tuple[str, str],
    hour: Column,
    weather_hour: str = "weather_hour",
    fallback_hour: int | None = S.NOON,
    day_known: str | None = None,
) -> DataFrame:
    """Left join on (airport, day, hour), falling back to the noon row.

    A present row wins even if its measures are null. `weather_source` says
    which row was used; `day_known` names a column telling whether the weather has
    the airport and day at all. Pairs are (flight column, weather column).
    """
    cols = measures_of(weather)
    days = by_day(weather, airport[1], day[1], weather_hour).select(
        F.col(airport[1]).alias("_a"), F.col(day[1]).alias("_d"), "hours"
    )
    keyed = flights.withColumns({"_a": F.col(airport[0]), "_d": F.col(day[0])})
    joined = lookup_join(keyed, pinned(days, "weather-days"), ["_a", "_d"])
    exact = F.try_element_at("hours", hour)
    spare = F.try_element_at("hours", F.lit(fallback_hour)) if fallback_hour is not None else None
    source = F.when(exact.isNotNull(), "exact")
    chosen = exact
    if spare is not None:
        source = source.when(spare.isNotNull(), "fallback")
        chosen = F.coalesce(exact, spare)
    known = [F.col("hours").isNotNull().alias(day_known)] if day_known else []
    picked = joined.select(*flights.columns, chosen.alias("_w"), source.alias("weather_source"), *known)
    return picked.select(
        *flights.columns, *[F.col(f"_w.{c}").alias(c) for c in cols], "weather_source",
        *([day_known] if day_known else []),
    )


def enrich_flights(
    flights: DataFrame,
    weather: DataFrame,
    airports: DataFrame,
    airport: tuple[str, str],
    day: tuple[str, str],
    hour: Column,
    weather_hour: str = "weather_hour",
) -> DataFrame:
    """Flights with weather and the mark `weather_enriched`.

    A flight is done when its airport and day were fetched, even if the hour is
    missing, and also when its airport has no coordinates, so that it is not asked
    for again. A pair that could not be fetched stays open.
    """
    joined = join_hourly_weather(flights, weather, airport, day, hour, weather_hour, day_known="_fetched")
    located = airports.filter(F.col("latitude").isNotNull()).select(
        F.col("iata_code").alias(airport[0]), F.lit(True).alias("_located")
    ).distinct()
    marked = joined.join(located, airport[0], "left")
    done = F.col("_fetched") | F.col("_located").isNull()
    return marked.withColumn("weather_enriched", done).drop("_fetched", "_located")


def seasonal_weather(
    segments: DataFrame, weather: DataFrame, airport: tuple[str, str], time_col: str,
    day: str = "weather_date", hour: str = "weather_hour", years_back: int = 1,
) -> DataFrame:
    """Weather of the same month, day and hour some years earlier; no noon fallback.

    29 February maps to the 28th when the earlier year has no leap day.
    """
    shifted = segments.withColumn(
        "_day", F.add_months(F.col(time_col).cast("date"), -12 * years_back)
    )
    out = join_hourly_weather(
        shifted, weather, airport, ("_day", day), F.hour(time_col), hour, fallback_hour=None
    )
    return out.withColumnRenamed("_day", "weather_date")


def missing_weather(
    segments: DataFrame, airport: DataFrame, stored: DataFrame, key: list[str], code: str = "departure_airport_code"
) -> DataFrame:
    """Segments without stored weather whose airport has coordinates."""
    located = airport.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("iata_code").alias(code), "latitude", "longitude"
    )
    return segments.join(stored.select(*key), key, "left_anti").join(located, code)


def weather_cascade(
    segments: DataFrame,
    forecast: DataFrame,
    stored: DataFrame,
    key: list[str],
    airport: tuple[str, str],
    time_col: str,
    now: Column,
    hour: Column | None = None,
    day: str = "weather_date",
    weather_hour: str = "weather_hour",
    window_days: int = FORECAST_DAYS,
) -> DataFrame:
    """Forecast inside the window, else the stored row, else defaults - row-wise.

    The forecast row counts only when its temperature is present; a stored row
    counts even if some of its measures are null (those then take defaults).
    """
    ahead = F.floor(S.seconds_between(now, F.col(time_col)) / S.SECONDS_PER_DAY)
    near = ahead.between(0, window_days)
    base = segments.withColumn("_fday", F.when(near, F.col(time_col).cast("date")))
    f = join_hourly_weather(
        base, forecast, airport, ("_fday", day),
        F.hour(time_col) if hour is None else hour, weather_hour, fallback_hour=None,
    )
    cols = measures_of(forecast)
    f = f.select(*segments.columns, F.struct(*cols).alias("_f"))
    s = stored.select(*key, F.struct(*[F.col(c) for c in cols]).alias("_s"))
    both = f.join(s, key, "left")
    use_f, use_s = F.col("_f.temperature_c").isNotNull(), F.col("_s").isNotNull()
    source = F.when(use_f, "forecast").when(use_s, "stored").otherwise("default")
    value = lambda c: F.when(use_f, F.col(f"_f.{c}")).when(use_s, F.col(f"_s.{c}"))
    return both.select(
        *segments.columns,
        *[F.coalesce(value(c), F.lit(S.WEATHER_DEFAULTS[c])).alias(c) for c in cols],
        source.alias("weather_source"),
    )
