"""Itineraries, match calendar, city lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import itinerary as I
from waylark.operators import planning as P
from waylark.operators import upsert as U
from waylark.plans import domain as D
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import pinned

NOW = "1998-06-01 09:30:00"
ASKED = "2001-12-31 00:00:00"


def located(spark, sf):
    return I.with_endpoints(D.segments(spark, sf), I.airport_cities(D.airport(spark, sf), D.city(spark, sf)), "left")


def journeys(spark, sf, legs=True):
    return I.journey_facts(located(spark, sf), legs=legs)


# Journey qualification written the long way: key sets joined, then the details.
_ITIN = f"""
WITH {views("segments", "airport_city", "matches")},
dep AS (SELECT DISTINCT journey_sk, city AS origin_city FROM segments JOIN airport_city ON departure_airport_code = iata_code WHERE pos = 0),
arr AS (SELECT journey_sk, city, arrival_airport_time FROM segments s
        JOIN airport_city ON arrival_airport_code = iata_code
        WHERE pos = (SELECT max(pos) FROM segments z WHERE z.journey_sk = s.journey_sk)),
pairs AS (SELECT DISTINCT m.match_id, m.match_date, arr.journey_sk, origin_city FROM arr JOIN dep USING (journey_sk)
          JOIN matches m ON lower(m.city) = lower(arr.city)
          AND arr.arrival_airport_time BETWEEN m.match_date::DATE - INTERVAL 3 DAY AND m.match_date - INTERVAL 5 HOUR),
detail AS (SELECT s.*, d.city AS departure_city, a.city AS arrival_city FROM segments s
           JOIN airport_city d ON departure_airport_code = d.iata_code
           JOIN airport_city a ON arrival_airport_code = a.iata_code),
assembled AS (
  SELECT journey_sk, arg_min(price, pos) AS price, arg_min(airline, pos) AS airline, arg_min(is_best, pos) AS is_best,
         arg_min(total_journey_duration, pos) AS total_duration,
         arg_min(departure_airport_code, pos) AS departure_airport_code,
         arg_min(departure_airport_time, pos) AS departure_airport_time,
         arg_min(departure_city, pos) AS departure_city, arg_min(updated_at, pos) AS updated_at,
         arg_max(arrival_airport_code, pos) AS arrival_airport_code,
         arg_max(arrival_airport_time, pos) AS arrival_airport_time,
         arg_max(arrival_city, pos) AS arrival_city, (count(*) - 1)::INT AS nb_stops,
         string_agg(pos || ':' || departure_airport_code || '>' || arrival_airport_code || ' ' || airline, '; ' ORDER BY pos) AS segments
  FROM detail GROUP BY 1),
itins AS (SELECT p.match_id, p.match_date, p.origin_city, x.* FROM pairs p JOIN assembled x USING (journey_sk))"""


def show_legs(df):
    text = F.transform("segments", lambda s: F.concat(
        s["pos"].cast("string"), F.lit(":"), s["departure_airport_code"], F.lit(">"),
        s["arrival_airport_code"], F.lit(" "), s["airline"]))
    return df.withColumn("segments", F.array_join(text, "; "))


@query("itineraries_to_match", _ITIN + " SELECT * FROM itins")
def itineraries_to_match(spark, sf):
    return show_legs(I.segment_itineraries(located(spark, sf), D.matches(spark, sf)))


@query("qualifying_journeys", _ITIN + " SELECT match_id, journey_sk FROM pairs")
def qualifying_journeys(spark, sf):
    cities = I.airport_cities(D.airport(spark, sf), D.city(spark, sf))
    return I.qualifying_keys(I.with_endpoints(D.segments(spark, sf), cities, "left"), D.matches(spark, sf))


@query("itineraries_from_city", _ITIN + """
SELECT match_id, journey_sk, price, nb_stops FROM itins WHERE lower(origin_city) = lower('nation_7')""")
def itineraries_from_city(spark, sf):
    found = I.itineraries(journeys(spark, sf, False), D.matches(spark, sf), origin="nation_7")
    return found.select("match_id", "journey_sk", "price", "nb_stops")


@query("assemble_journeys", _ITIN + """
SELECT journey_sk, price, airline, is_best, total_duration, departure_airport_code, departure_city,
       arrival_airport_code, arrival_airport_time, arrival_city, nb_stops, segments FROM assembled""")
def assemble_journeys(spark, sf):
    cities = I.airport_cities(D.airport(spark, sf), D.city(spark, sf))
    done = I.assemble_journeys(I.with_endpoints(D.segments(spark, sf), cities))
    return show_legs(done).select(
        "journey_sk", "price", "airline", "is_best", "total_duration", "departure_airport_code",
        "departure_city", "arrival_airport_code", "arrival_airport_time", "arrival_city", "nb_stops", "segments")


@query("journey_ends", f"""
WITH {views("segments")}
SELECT journey_sk, min(pos) AS first_pos, arg_min(departure_airport_code, pos) AS departure_airport_code,
       arg_min(departure_airport_time, pos) AS departure_airport_time, max(pos) AS last_pos,
       arg_max(arrival_airport_code, pos) AS arrival_airport_code,
       arg_max(arrival_airport_time, pos) AS arrival_airport_time, count(*)::INT AS n_segments
FROM segments GROUP BY 1""")
def journey_ends(spark, sf):
    return I.journey_ends(D.segments(spark, sf))


@query("segments_with_cities", f"""
WITH {views("segments", "airport_city")}
SELECT d.city AS departure_city, a.city AS arrival_city, count(*) AS n, sum(duration)::BIGINT AS minutes
FROM segments JOIN airport_city d ON departure_airport_code = d.iata_code
              JOIN airport_city a ON arrival_airport_code = a.iata_code GROUP BY ALL""")
def segments_with_cities(spark, sf):
    cities = I.airport_cities(D.airport(spark, sf), D.city(spark, sf))
    s = I.with_endpoints(D.segments(spark, sf), cities)
    return s.groupBy("departure_city", "arrival_city").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("minutes"))


_CALENDAR = f"""
WITH {views("matches", "teams")}, calendar AS (
  SELECT match_id, match_date, id_team_a, a.team_name AS name_team_a, id_team_b, b.team_name AS name_team_b,
         stage, city AS city_name
  FROM matches JOIN teams a ON id_team_a = a.id_team JOIN teams b ON id_team_b = b.id_team)"""


def calendar(spark, sf):
    return I.match_calendar(
        D.matches(spark, sf).drop("city"), D.teams(spark), D.city(spark, sf))


@query("match_calendar", _CALENDAR + " SELECT * FROM calendar")
def match_calendar(spark, sf):
    return calendar(spark, sf).drop("flag_team_a", "flag_team_b").orderBy("match_date", "match_id")


@query("match_filters", _CALENDAR + f"""
SELECT match_id, name_team_a, name_team_b, city_name FROM calendar
WHERE city_name IS DISTINCT FROM 'NATION_3' AND (name_team_a = 'Team 7' OR name_team_b = 'Team 7')""")
def match_filters(spark, sf):
    kept = I.filter_matches(calendar(spark, sf), S.local_ts(NOW), team="Team 7", home_city="NATION_3")
    return kept.select("match_id", "name_team_a", "name_team_b", "city_name")


@query("match_date_buckets", _CALENDAR + """
SELECT match_id, match_date, match_date >= DATE '1998-06-01' AND match_date < DATE '1998-06-02' AS today,
       match_date >= DATE '1998-06-02' AND match_date < DATE '1998-06-03' AS tomorrow
FROM calendar WHERE match_date >= DATE '1998-06-01' AND match_date < DATE '1998-06-08'""")
def match_date_buckets(spark, sf):
    now = S.local_ts(NOW)
    week = I.filter_matches(calendar(spark, sf), now, bucket="week")
    return week.select("match_id", "match_date", *[
        S.date_bucket("match_date", b, now).alias(b) for b in ("today", "tomorrow")])


@query("match_by_id", f"WITH {views('matches')} SELECT match_id, match_date, city AS arrival_city FROM matches WHERE match_id = (SELECT min(match_id) FROM matches)")
def match_by_id(spark, sf):
    m = D.matches(spark, sf)
    first = m.agg(F.min("match_id")).first()[0]
    return I.match_by_id(m.drop("city"), D.city(spark, sf), first)


@query("city_airports", f"""
WITH {views("segments", "city", "airport")}, used AS (
  SELECT DISTINCT code FROM (SELECT departure_airport_code AS code FROM segments
                             UNION ALL SELECT arrival_airport_code FROM segments)),
a AS (SELECT iata_code, id_city FROM airport JOIN used ON iata_code = code)
SELECT c.id_city, c.city, c.country, count(iata_code) AS n_airports,
       coalesce(string_agg(coalesce(iata_code, '?'), ',' ORDER BY iata_code), '?') AS airport_codes
FROM city c LEFT JOIN a ON c.id_city = a.id_city WHERE is_host_city GROUP BY ALL""")
def city_airports(spark, sf):
    """Airports in use per host city; a city without one shows `?` for its null."""
    used = U.distinct_codes(D.segments(spark, sf), ["departure_airport_code", "arrival_airport_code"], "iata_code")
    a = D.airport(spark, sf).join(used, "iata_code", "left_semi")
    listed = I.city_airports(D.city(spark, sf), a)
    return listed.select(
        "id_city", "city", "country",
        F.size(F.array_compact("airport_codes")).cast("long").alias("n_airports"),
        F.array_join("airport_codes", ",", "?").alias("airport_codes"),
    )


@query("cities_by_country", f"""
WITH {views("city")}, lived AS (SELECT DISTINCT c_nationkey FROM customer)
SELECT CASE country WHEN 'AMERICA' THEN 'Americas' WHEN 'EUROPE' THEN 'Europe' ELSE 'Asia' END AS label,
       string_agg(city, ',' ORDER BY city) AS cities
FROM city JOIN lived ON id_city = c_nationkey WHERE country IN ('AMERICA', 'EUROPE', 'ASIA') GROUP BY 1""")
def cities_by_country(spark, sf):
    """Cities with customers, under three country labels."""
    lived = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id_city")).distinct()
    c = D.city(spark, sf).join(lived, "id_city", "left_semi")
    labels = {"AMERICA": "Americas", "EUROPE": "Europe", "ASIA": "Asia"}
    return I.cities_by_country(c, labels).withColumn("cities", F.array_join("cities", ","))


@query("freshness", _ITIN + f"""
SELECT match_id, origin_city, last_update, n_journeys, n_stale, days_since_update,
       days_since_update >= 7 AS is_stale
FROM (SELECT match_id, origin_city, max(updated_at) AS last_update, count(*) AS n_journeys,
             sum(CASE WHEN floor(epoch(TIMESTAMP '{NOW}' - updated_at) / 86400.0) >= 7 THEN 1 ELSE 0 END)::BIGINT AS n_stale,
             floor(epoch(TIMESTAMP '{NOW}' - max(updated_at)) / 86400.0)::INT AS days_since_update
      FROM itins GROUP BY ALL)""")
def freshness(spark, sf):
    return I.route_freshness(journeys(spark, sf, False), D.matches(spark, sf), S.local_ts(NOW))


@query("answer_meta", _ITIN + """
SELECT m.match_id, m.city AS destination_city, strftime(m.match_date, '%Y-%m-%d %H:%M') AS match_date_actual,
       count(i.journey_sk) AS results_count, 'boosted_trees' AS model_used
FROM matches m LEFT JOIN itins i USING (match_id) GROUP BY ALL""")
def answer_meta(spark, sf):
    m = D.matches(spark, sf)
    found = I.routes(journeys(spark, sf, False), m, S.local_ts(NOW), by_origin=False)
    return I.answer_meta(found, m, "boosted_trees")


# --- planning -----------------------------------------------------------------

def route_requests(spark, sf):
    """One question per match, from the city numbered `id_origin`."""
    c = D.city(spark, sf).select(F.col("id_city").alias("id_origin"), F.col("city").alias("origin_city"))
    return D.matches(spark, sf).join(c, "id_origin").select("match_id", "origin_city")


_REQ = "route_requests AS (SELECT match_id, o.city AS origin_city FROM matches JOIN city o ON id_origin = o.id_city)"


@query("search_plan", f"""
WITH {views("matches", "airport_city")}, {_REQ}
SELECT r.match_id, origin_city, d.iata_code AS departure_id, a.iata_code AS arrival_id,
       strftime(match_date::DATE - k, '%Y-%m-%d') AS outbound_date
FROM route_requests r JOIN matches m USING (match_id) JOIN airport_city d ON d.city = origin_city
     JOIN airport_city a ON a.city = m.city, (VALUES (1), (2)) v(k)
WHERE match_id % 5 <> 0""")
def search_plan(spark, sf):
    """Searches for every route that is not marked as already asked."""
    r = route_requests(spark, sf)
    cities = I.airport_cities(D.airport(spark, sf), D.city(spark, sf))
    plan = P.search_plan(r, D.matches(spark, sf), cities, skip=r.filter("match_id % 5 = 0"))
    return plan.withColumn("outbound_date", F.date_format("outbound_date", "yyyy-MM-dd"))


def _found(spark, sf):
    return I.route_freshness(journeys(spark, sf, False), D.matches(spark, sf), S.local_ts(NOW))


def _ledger(spark, sf, found):
    """Routes asked before: every fifth match, and those with any itinerary."""
    r = route_requests(spark, sf)
    old = r.filter("match_id % 5 = 0").select(
        *P.ROUTE_KEYS, F.lit(0).cast("long").alias("n_results"), S.local_ts(ASKED).alias("asked_at"))
    answered = found.select(*P.ROUTE_KEYS, F.col("n_journeys").alias("n_results"))
    return P.route_ledger(old, answered, S.local_ts("2002-01-01"))


_LEDGER = f""", {_REQ}, found AS (SELECT match_id, origin_city, count(*) AS n_results FROM itins GROUP BY ALL),
old AS (SELECT match_id, origin_city FROM route_requests WHERE match_id % 5 = 0),
ledger AS (SELECT match_id, origin_city, 0::BIGINT AS n_results, TIMESTAMP '{ASKED}' AS asked_at FROM old
  UNION ALL SELECT f.match_id, f.origin_city, n_results, TIMESTAMP '2002-01-01' FROM found f
  ANTI JOIN old o ON o.match_id = f.match_id AND o.origin_city = f.origin_city)"""


@query("route_ledger", _ITIN + _LEDGER + " SELECT * FROM ledger")
def route_ledger(spark, sf):
    return _ledger(spark, sf, _found(spark, sf))


_OUTCOMES = _ITIN + _LEDGER + f""", state AS (
  SELECT match_id, origin_city, floor(epoch(TIMESTAMP '{NOW}' - max(updated_at)) / 86400.0) >= 7 AS is_stale
  FROM itins GROUP BY ALL),
asked AS (SELECT match_id, origin_city FROM route_requests
          UNION SELECT match_id, origin_city FROM state),
outcomes AS (SELECT a.match_id, a.origin_city, CASE WHEN is_stale THEN 'stale' WHEN is_stale IS NOT NULL THEN 'hit'
         WHEN l.match_id IS NOT NULL THEN 'negative' ELSE 'miss' END AS outcome
  FROM asked a LEFT JOIN state s ON s.match_id = a.match_id AND s.origin_city = a.origin_city
               LEFT JOIN ledger l ON l.match_id = a.match_id AND l.origin_city = a.origin_city)"""


def _outcomes(spark, sf):
    state = pinned(_found(spark, sf), "routes")
    asked = route_requests(spark, sf).unionByName(state.select(*P.ROUTE_KEYS)).distinct()
    return P.cache_outcomes(asked, state, _ledger(spark, sf, state))


@query("cache_outcomes", _OUTCOMES + " SELECT * FROM outcomes")
def cache_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("cache_report", _OUTCOMES + """
SELECT count(*) AS n_requests, count(*) FILTER (outcome = 'hit') AS n_hit, count(*) FILTER (outcome = 'stale') AS n_stale,
       count(*) FILTER (outcome = 'negative') AS n_negative, count(*) FILTER (outcome = 'miss') AS n_miss,
       round(count(*) FILTER (outcome IN ('hit', 'negative')) / count(*), 6) AS hit_ratio FROM outcomes""")
def cache_report(spark, sf):
    return P.cache_report(_outcomes(spark, sf)).withColumn("hit_ratio", F.round("hit_ratio", 6))
