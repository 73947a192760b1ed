"""Planning tables: what has to be fetched, what was already asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S

ROUTE_KEYS = ["match_id", "origin_city"]


def search_plan(
    requests: DataFrame,
    matches: DataFrame,
    airports: DataFrame,
    days_before: tuple[int, ...] = (1, 2),
    skip: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """(match, origin, departure airport, arrival airport, date) searches to run.

    `airports` is (iata_code, city). Requests in `skip` (fresh or already asked
    routes) are left out unless `force`. Cities are matched by equi joins on the
    normalised name, so the work is requests x airports of the two cities.
    """
    r = requests
    if skip is not None and not force:
        r = r.join(skip.select(*ROUTE_KEYS), ROUTE_KEYS, "left_anti")
    by_city = airports.select("iata_code", S.norm_text("city").alias("_c"))
    dep = by_city.select(F.col("_c").alias("_from"), F.col("iata_code").alias("departure_id"))
    arr = by_city.select(F.col("_c").alias("_to"), F.col("iata_code").alias("arrival_id"))
    day = F.col("match_date").cast("date")
    return (
        r.join(matches.select("match_id", "match_date", "city"), "match_id")
        .withColumns({"_from": S.norm_text("origin_city"), "_to": S.norm_text("city")})
        .join(dep, "_from").join(arr, "_to")
        .select(
            *ROUTE_KEYS, "departure_id", "arrival_id",
            F.explode(F.array(*[F.date_sub(day, d) for d in days_before])).alias("outbound_date"),
        )
    )


def route_ledger(ledger: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Ledger plus every newly asked route, including those without results.

    The asked routes are grouped once and not ordered again, as each is there once.
    """
    fresh = asked.groupBy(*ROUTE_KEYS).agg(F.max("n_results").cast("long").alias("n_results"))
    new = fresh.withColumn("asked_at", now).join(ledger.select(*ROUTE_KEYS), ROUTE_KEYS, "left_anti")
    return ledger.unionByName(new.select(*ledger.columns))


def cache_outcomes(requests: DataFrame, fresh_state: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each request with its outcome: hit, stale, negative or miss.

    `fresh_state` has the route keys and `is_stale`; `ledger` lists asked routes.
    """
    state = fresh_state.select(*ROUTE_KEYS, "is_stale")
    asked = ledger.select(*ROUTE_KEYS, F.lit(True).alias("_asked"))
    outcome = (
        F.when(F.col("is_stale"), "stale")
        .when(F.col("is_stale").isNotNull(), "hit")
        .when(F.col("_asked"), "negative")
        .otherwise("miss")
    )
    return (
        requests.join(state, ROUTE_KEYS, "left").join(asked, ROUTE_KEYS, "left")
        .select(*requests.columns, outcome.alias("outcome"))
    )


def cache_report(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per outcome and the share answered without an outside call."""
    n = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0))
    total = F.count(F.lit(1))
    return outcomes.groupBy(*(by or [])).agg(
        total.alias("n_requests"),
        n("hit").alias("n_hit"), n("stale").alias("n_stale"),
        n("negative").alias("n_negative"), n("miss").alias("n_miss"),
        F.try_divide(n("hit") + n("negative"), total).alias("hit_ratio"),
    )


def weather_plan(flights: DataFrame, airport_col: str, day_col: str, airport: DataFrame, done: Column | None = None) -> DataFrame:
    """Distinct (airport, day) pairs to fetch, with coordinates where known.

    Pairs whose airport has no coordinates carry `fetchable = false`.
    """
    todo = flights if done is None else flights.filter(~F.coalesce(done, F.lit(False)))
    pairs = todo.select(F.col(airport_col).alias("airport"), F.col(day_col).alias("day")).distinct()
    dim = airport.select(F.col("iata_code").alias("airport"), "latitude", "longitude")
    located = pairs.join(dim, "airport", "left")
    return located.withColumn(
        "fetchable", F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
