"""Itineraries to a match: city joins, journey ends, arrival window, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.session import pinned


def airport_cities(airport: DataFrame, city: DataFrame) -> DataFrame:
    """(iata_code, id_city, city, country) for airports of known cities."""
    return airport.select("iata_code", "id_city").join(city.select("id_city", "city", "country"), "id_city")


def with_city(df: DataFrame, code_col: str, cities: DataFrame, out: str, how: str = "inner") -> DataFrame:
    """Add the city of an airport code; `how='left'` keeps unknown airports."""
    dim = cities.select(F.col("iata_code").alias(code_col), F.col("city").alias(out))
    return df.join(dim, code_col, how)


def with_endpoints(segments: DataFrame, cities: DataFrame, how: str = "inner") -> DataFrame:
    """The same dimension in two roles: departure and arrival city."""
    d = with_city(segments, "departure_airport_code", cities, "departure_city", how)
    return with_city(d, "arrival_airport_code", cities, "arrival_city", how)


_FIRST = ["pos", "departure_airport_code", "departure_airport_time"]
_LAST = ["pos", "arrival_airport_code", "arrival_airport_time"]


def journey_ends(segments: DataFrame, journey: str = "journey_sk") -> DataFrame:
    """First and last segment attributes in one partially aggregated pass."""
    g = segments.groupBy(journey).agg(
        F.min_by(F.struct(*_FIRST), "pos").alias("first"),
        F.max_by(F.struct(*_LAST), "pos").alias("last"),
        F.count(F.lit(1)).alias("n_segments"),
    )
    return g.select(
        journey,
        F.col("first.pos").alias("first_pos"),
        F.col("first.departure_airport_code").alias("departure_airport_code"),
        F.col("first.departure_airport_time").alias("departure_airport_time"),
        F.col("last.pos").alias("last_pos"),
        F.col("last.arrival_airport_code").alias("arrival_airport_code"),
        F.col("last.arrival_airport_time").alias("arrival_airport_time"),
        F.col("n_segments").cast("int").alias("n_segments"),
    )


_HEAD = [
    "price", "airline", "is_best", "total_journey_duration", "departure_airport_code",
    "departure_airport_time", "departure_city", "updated_at",
]
_TAIL = ["arrival_airport_code", "arrival_airport_time", "arrival_city"]
_LEG = ["pos", "departure_airport_code", "arrival_airport_code", "airline"]


def journey_facts(segments: DataFrame, journey: str = "journey_sk", legs: bool = True) -> DataFrame:
    """One row per journey: what qualifies it and what is shown of it.

    Expects outer-joined cities. The first-leg test looks at `pos = 0`, the
    last-leg test at the highest position of all legs; the displayed ends and the
    leg list only use legs whose two airports are known. All of it is one
    aggregation, without a self join. The leg list is bounded by the legs of one
    search document because (journey, pos) is unique.
    """
    known = F.col("departure_city").isNotNull() & F.col("arrival_city").isNotNull()
    rank = F.when(known, F.col("pos"))
    aggs = [
        F.max(F.when(F.col("pos") == 0, F.col("departure_city"))).alias("origin_city"),
        F.max_by(F.struct("arrival_city", "arrival_airport_time"), "pos").alias("end"),
        F.min_by(F.struct(*_HEAD), rank).alias("head"),
        F.max_by(F.struct(*_TAIL), rank).alias("tail"),
        F.count(rank).alias("n_known"),
    ]
    if legs:
        aggs.append(F.sort_array(F.collect_list(F.when(known, F.struct(*_LEG)))).alias("segments"))
    g = segments.groupBy(journey).agg(*aggs)
    return g.select(
        journey, "origin_city",
        F.col("end.arrival_city").alias("end_city"),
        F.col("end.arrival_airport_time").alias("end_time"),
        F.col("head.price").alias("price"),
        F.col("head.airline").alias("airline"),
        F.col("head.is_best").alias("is_best"),
        F.col("head.total_journey_duration").alias("total_duration"),
        F.col("head.departure_airport_code").alias("departure_airport_code"),
        F.col("head.departure_airport_time").alias("departure_airport_time"),
        F.col("head.departure_city").alias("departure_city"),
        F.col("head.updated_at").alias("updated_at"),
        F.col("tail.arrival_airport_code").alias("arrival_airport_code"),
        F.col("tail.arrival_airport_time").alias("arrival_airport_time"),
        F.col("tail.arrival_city").alias("arrival_city"),
        (F.col("n_known") - 1).cast("int").alias("nb_stops"),
        *(["segments"] if legs else []),
    ).filter("nb_stops >= 0")


def assemble_journeys(segments: DataFrame, journey: str = "journey_sk") -> DataFrame:
    """Journeys with ordered legs from segments whose cities are joined in."""
    return journey_facts(segments, journey).drop("origin_city", "end_city", "end_time")


def itineraries(
    journeys: DataFrame,
    matches: DataFrame,
    origin: str | None = None,
    days: int = 3,
    hours: int = 5,
) -> DataFrame:
    """Journeys (of `journey_facts`) that bring a fan to a match in time.

    For all matches at once. Every match is listed under each arrival date of its
    window, so the join is an equi join on (city, date) and a popular host city is
    spread over its dates; what is still uneven is split by AQE's skew join. The
    exact bounds are checked on the joined row.

    The pairs grow with the product of journeys and matches, so they are made by the
    last join and neither stored nor shuffled: a journey, with what is shown of it, goes
    through one shuffle. A journey without a key takes no part.
    """
    key = journeys.columns[0]
    shown = [c for c in journeys.columns if c not in ("end_city", "end_time")]
    j = _leaving(journeys, origin).filter(F.col(key).isNotNull()).withColumns(
        {"_city": F.lower("end_city"), "_day": F.col("end_time").cast("date")})
    day = F.col("match_date").cast("date")
    m = matches.select(
        "match_id", "match_date",
        F.lower("city").alias("_city"),
        F.explode(F.sequence(F.date_sub(day, days), day)).alias("_day"),
    )
    return (
        j.join(m, ["_city", "_day"])
        .filter(S.arrival_window("match_date", "end_time", days, hours))
        .select(*shown, "match_id", "match_date")
    )


def _leaving(journeys: DataFrame, origin: str | None) -> DataFrame:
    j = journeys.filter(F.col("origin_city").isNotNull())
    return j if origin is None else j.filter(S.equals_ignoring_case("origin_city", F.lit(origin)))


def segment_itineraries(
    segments: DataFrame,
    matches: DataFrame,
    journey: str = "journey_sk",
    origin: str | None = None,
    days: int = 3,
    hours: int = 5,
) -> DataFrame:
    """`itineraries` of all journeys in segments with outer-joined cities, legs included."""
    return itineraries(journey_facts(segments, journey), matches, origin, days, hours)


def qualifying_keys(
    segments: DataFrame, matches: DataFrame, journey: str = "journey_sk", origin: str | None = None
) -> DataFrame:
    """(match_id, journey) pairs, each once."""
    return itineraries(journey_facts(segments, journey, legs=False), matches, origin).select(
        "match_id", journey
    )


def routes(
    journeys: DataFrame,
    matches: DataFrame,
    now: Column,
    stale_days: int = 7,
    by_origin: bool = True,
    days: int = 3,
    hours: int = 5,
) -> DataFrame:
    """(match_id, origin_city, last_update, n_journeys, n_stale): the `itineraries` of each
    match and origin in numbers, without listing them; `by_origin=False` leaves the origin out.

    Matches of one city and time have one window. Of its whole days the journeys' totals
    per city, origin and day count. In its last day the totals up to the bound come from one pass
    in order of time, in which journeys that arrive at the same time are one row. So the work
    grows with journeys, windows and origins, not with the pairs.
    """
    origin = ["origin_city"] if by_origin else []
    sums = [F.max("last_update").alias("last_update"), F.sum("n_journeys").alias("n_journeys"), F.sum("n_stale").alias("n_stale")]
    place, stale = ["_city", *origin, "_day"], S.whole_days(F.col("updated_at"), now) >= stale_days
    arrivals = pinned(
        _leaving(journeys, None).filter(F.col(journeys.columns[0]).isNotNull() & F.col("end_city").isNotNull() & F.col("end_time").isNotNull())
        .select(F.lower("end_city").alias("_city"), *origin, F.col("end_time").cast("date").alias("_day"), F.col("end_time").alias("_at"),
                F.col("updated_at").alias("last_update"), F.lit(1).cast("long").alias("n_journeys"),
                F.when(stale, 1).otherwise(0).cast("long").alias("n_stale"))
        .groupBy(*place, "_at").agg(*sums), "arrivals")
    by_day = pinned(arrivals.groupBy(*place).agg(*sums), "arrival-days")
    held = pinned(
        matches.select("match_id", F.lower("city").alias("_city"), "match_date").filter("_city IS NOT NULL AND match_date IS NOT NULL")
        .groupBy("match_id", "_city", "match_date").agg(F.count(F.lit(1)).alias("_copies")), "held")
    first = F.date_sub(F.col("match_date").cast("date"), days)
    bound = F.col("match_date").cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    windows = held.select("_city", "match_date").distinct().select(
        "_city", "match_date", first.alias("_first"), bound.alias("_bound"), bound.cast("date").alias("_last")).filter("_last >= _first")
    whole = windows.filter("_last > _first").select(
        "_city", "match_date", F.explode(F.sequence("_first", F.date_sub("_last", 1))).alias("_day"))
    shown = ["_city", "match_date", *origin, "last_update", "n_journeys", "n_stale"]
    before = whole.join(by_day, ["_city", "_day"]).select(*shown)
    # Each bound takes its place among the arrivals of its day, behind those of the same moment.
    asked = windows.select("_city", "match_date", F.col("_last").alias("_day"), F.col("_bound").alias("_at")).join(
        by_day.select(*place), ["_city", "_day"])
    told = ["last_update", "n_journeys", "n_stale"]
    ordered = arrivals.unionByName(asked, allowMissingColumns=True)
    upto = W.partitionBy(*place).orderBy("_at", F.col("match_date").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = {"last_update": F.max("last_update"), "n_journeys": F.sum("n_journeys"), "n_stale": F.sum("n_stale")}
    last = ordered.select(*place, "match_date", *[run[c].over(upto).alias(c) for c in told]).filter(
        "match_date IS NOT NULL AND n_journeys IS NOT NULL").select(*shown)
    window = before.unionByName(last).groupBy("_city", "match_date", *origin).agg(*sums)
    # A match listed in several windows is added up; the others need no further shuffle.
    again = held.groupBy("match_id").agg(F.count(F.lit(1)).alias("_windows")).filter("_windows > 1").select(
        F.col("match_id").alias("_again"), F.lit(True).alias("_several"))
    marked = pinned(held.join(again, held["match_id"].eqNullSafe(F.col("_again")), "left").drop("_again"), "held-marked")
    out = marked.join(pinned(window, "windows"), ["_city", "match_date"]).select(
        "match_id", *origin, "last_update", *[(F.col(c) * F.col("_copies")).alias(c) for c in told[1:]], "_several")
    return out.filter("_several IS NULL").drop("_several").unionByName(
        out.filter("_several").groupBy("match_id", *origin).agg(*sums))


# --- match calendar -----------------------------------------------------------

def match_calendar(matches: DataFrame, teams: DataFrame, city: DataFrame) -> DataFrame:
    """Matches with both team names and the city name."""
    side = lambda s: teams.select(
        F.col("id_team").alias(f"id_team_{s}"),
        F.col("team_name").alias(f"name_team_{s}"),
        F.col("flag").alias(f"flag_team_{s}"),
    )
    return (
        matches.join(side("a"), "id_team_a")
        .join(side("b"), "id_team_b")
        .join(city.select("id_city", F.col("city").alias("city_name")), "id_city")
        .select(
            "match_id", "match_date", "id_team_a", "name_team_a", "flag_team_a",
            "id_team_b", "name_team_b", "flag_team_b", "stage", "city_name",
        )
    )


def match_by_id(matches: DataFrame, city: DataFrame, match_id: int) -> DataFrame:
    return matches.filter(F.col("match_id") == match_id).join(
        city.select("id_city", F.col("city").alias("arrival_city")), "id_city"
    ).select("match_id", "match_date", "arrival_city")


def plays(team: str, a: str = "name_team_a", b: str = "name_team_b") -> Column:
    return (F.col(a) == team) | (F.col(b) == team)


def away_from(city: str | None, col: str = "city_name") -> Column:
    """True for matches that are not in the user's own city."""
    return ~F.col(col).eqNullSafe(F.lit(city))


def filter_matches(
    calendar: DataFrame,
    now: Column,
    team: str | None = None,
    bucket: str = "all",
    home_city: str | None = None,
) -> DataFrame:
    """Team, date and own-city filters; a missing one filters nothing."""
    out = calendar.filter(S.date_bucket("match_date", bucket, now))
    if home_city is not None:
        out = out.filter(away_from(home_city))
    if team is not None:
        out = out.filter(plays(team))
    return out


def filter_in(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(col).isin(values))


# --- city lists -----------------------------------------------------------------

def city_airports(city: DataFrame, airport: DataFrame, hosts_only: bool = True) -> DataFrame:
    """Airport codes per city; a city without one keeps a single null entry."""
    base = city.filter("is_host_city") if hosts_only else city
    rows = base.join(airport.select("id_city", "iata_code"), "id_city", "left")
    return rows.groupBy("id_city", "city", "country").agg(
        F.sort_array(F.transform(F.collect_list(F.struct("iata_code")), lambda s: s["iata_code"]))
        .alias("airport_codes")
    )


def cities_by_country(city: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Sorted city names under each country label; other countries are left out."""
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return (
        city.withColumn("label", F.try_element_at(table, F.col("country")))
        .filter(F.col("label").isNotNull())
        .groupBy("label").agg(F.sort_array(F.collect_set("city")).alias("cities"))
    )


# --- freshness and answers --------------------------------------------------------

def freshness(itins: DataFrame, by: list[str], now: Column, days: int = 7) -> DataFrame:
    """Newest update per answer, and how many of its journeys are stale themselves."""
    age = S.whole_days(F.col("updated_at"), now)
    g = itins.groupBy(*by).agg(
        F.max("updated_at").alias("last_update"),
        F.count(F.lit(1)).alias("n_journeys"),
        F.sum(F.when(age >= days, 1).otherwise(0)).alias("n_stale"),
    )
    return aged(g, now, days)


def aged(answers: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Answers with the age of their newest update."""
    since = S.whole_days(F.col("last_update"), now)
    return answers.select("*", since.alias("days_since_update"), (since >= days).alias("is_stale"))


def route_freshness(journeys: DataFrame, matches: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """`freshness` of all itineraries by match and origin city, from their numbers."""
    return aged(routes(journeys, matches, now, days), now, days)


def answer_meta(itins: DataFrame, matches: DataFrame, model: str | None) -> DataFrame:
    """Header of each answer; matches without an itinerary count zero.

    `itins` lists itineraries, or has their number in `n_journeys`, as `routes` gives it.
    """
    n = F.sum("n_journeys") if "n_journeys" in itins.columns else F.count(F.lit(1))
    counts = itins.groupBy("match_id").agg(n.alias("n"))
    return matches.join(counts, "match_id", "left").select(
        "match_id",
        F.col("city").alias("destination_city"),
        F.date_format("match_date", "yyyy-MM-dd HH:mm").alias("match_date_actual"),
        F.coalesce("n", F.lit(0)).cast("long").alias("results_count"),
        F.lit(model).alias("model_used"),
    )
