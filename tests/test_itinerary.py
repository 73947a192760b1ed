import random

from conftest import rows
from pyspark.sql import functions as F

from waylark.functions.scalars import local_ts
from waylark.operators import itinerary as I
from waylark.operators import planning as P

SEG = ("journey_sk string, pos int, departure_airport_code string, departure_airport_time string, "
       "arrival_airport_code string, arrival_airport_time string, price double, airline string, is_best boolean, "
       "total_journey_duration int, updated_at string")


def segments(spark, *data):
    df = spark.createDataFrame([(*d, 100.0, "AA", True, 300, "2026-09-01 00:00:00") for d in data], SEG)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in
                           ("departure_airport_time", "arrival_airport_time", "updated_at")})


def cities(spark):
    return spark.createDataFrame(
        [("MIA", 1, "Miami", "US"), ("FLL", 1, "Miami", "US"), ("ATL", 2, "Atlanta", "US"), ("LAX", 3, "Los Angeles", "US")],
        "iata_code string, id_city int, city string, country string")


def matches(spark):
    df = spark.createDataFrame([(1, "2026-09-13 18:00:00", "miami"), (2, "2026-09-14 18:00:00", "Miami")],
                               "match_id int, match_date string, city string")
    return df.withColumn("match_date", F.col("match_date").cast("timestamp_ntz"))


def found(spark, *data, **kw):
    ends = I.with_endpoints(segments(spark, *data), cities(spark), "left")
    got = I.itineraries(I.journey_facts(ends), matches(spark), **kw)
    # Keys first and legs last gives the same rows.
    assert rows(I.segment_itineraries(ends, matches(spark), **kw).select(got.columns)) == rows(got)
    return got


DIRECT = ("j1", 0, "ATL", "2026-09-12 08:00:00", "MIA", "2026-09-12 10:00:00")


def test_direct_journey_reaches_both_matches(spark):
    got = found(spark, DIRECT)
    assert rows(got.select("match_id", "journey_sk", "origin_city", "arrival_city", "nb_stops")) == [
        (1, "j1", "Atlanta", "Miami", 0), (2, "j1", "Atlanta", "Miami", 0)]
    assert found(spark, DIRECT, origin="ATLANTA").count() == 2
    assert found(spark, DIRECT, origin="Boston").count() == 0


def test_window_is_inclusive(spark):
    late = ("j2", 0, "ATL", "2026-09-13 08:00:00", "FLL", "2026-09-13 13:00:00")
    too_late = ("j3", 0, "ATL", "2026-09-13 08:00:00", "FLL", "2026-09-13 13:00:01")
    early = ("j4", 0, "ATL", "2026-09-09 20:00:00", "FLL", "2026-09-10 00:00:00")
    got = found(spark, late, too_late, early).filter("match_id = 1")
    assert rows(got.select("journey_sk")) == [("j2",), ("j4",)]


def test_first_leg_must_be_position_zero_and_last_leg_the_highest(spark):
    tail_only = ("j5", 1, "ATL", "2026-09-12 08:00:00", "MIA", "2026-09-12 10:00:00")
    onwards = [DIRECT, ("j1", 1, "MIA", "2026-09-12 12:00:00", "LAX", "2026-09-12 15:00:00")]
    assert found(spark, tail_only).count() == 0
    assert found(spark, *onwards).count() == 0


def test_legs_at_unknown_airports_are_not_shown(spark):
    via = [("j6", 0, "ATL", "2026-09-12 06:00:00", "QQQ", "2026-09-12 07:00:00"),
           ("j6", 1, "QQQ", "2026-09-12 08:00:00", "LAX", "2026-09-12 08:30:00"),
           ("j6", 2, "LAX", "2026-09-12 09:00:00", "MIA", "2026-09-12 10:00:00")]
    got = found(spark, *via).filter("match_id = 1").first()
    assert (got.origin_city, got.departure_city, got.nb_stops, len(got.segments)) == ("Atlanta", "Los Angeles", 0, 1)


def test_hot_city_and_date_give_every_pair(spark):
    data = [(f"h{i}", 0, "ATL", "2026-09-12 08:00:00", "MIA", "2026-09-12 10:00:00") for i in range(300)]
    data += [(f"c{i}", 0, "MIA", "2026-09-12 08:00:00", "LAX", "2026-09-12 10:00:00") for i in range(600)]
    assert found(spark, *data).count() == 600


def test_city_without_airport_keeps_a_null(spark):
    city = spark.createDataFrame([(1, "Miami", "US", True), (9, "Nowhere", "CA", True), (5, "Lyon", "FR", False)],
                                 "id_city int, city string, country string, is_host_city boolean")
    got = I.city_airports(city, cities(spark).select("iata_code", "id_city"))
    assert rows(got.select("city", "airport_codes")) == [("Miami", ["FLL", "MIA"]), ("Nowhere", [None])]
    labels = {"US": "USA", "MX": "Mexico", "CA": "Canada"}
    assert rows(I.cities_by_country(city, labels)) == [("Canada", ["Nowhere"]), ("USA", ["Miami"])]


def test_freshness_edges(spark):
    now = local_ts("2026-09-08 00:00:00")
    df = spark.createDataFrame(
        [(1, "2026-09-01 01:00:00"), (1, "2026-08-01 00:00:00"), (2, "2026-09-01 00:00:00")], "m int, u string"
    ).select("m", F.col("u").cast("timestamp_ntz").alias("updated_at"))
    got = I.freshness(df, ["m"], now).select("m", "n_journeys", "n_stale", "days_since_update", "is_stale")
    assert rows(got) == [(1, 2, 1, 6, False), (2, 1, 1, 7, True)]


def test_search_plan_and_ledger(spark):
    req = spark.createDataFrame([(1, " ATLANTA"), (2, "Boston")], "match_id int, origin_city string")
    plan = P.search_plan(req, matches(spark), cities(spark))
    assert rows(plan.select("departure_id", "arrival_id", F.col("outbound_date").cast("string"))) == [
        ("ATL", "FLL", "2026-09-11"), ("ATL", "FLL", "2026-09-12"),
        ("ATL", "MIA", "2026-09-11"), ("ATL", "MIA", "2026-09-12")]
    asked = req.withColumn("n_results", F.lit(0))
    ledger = P.route_ledger(asked.limit(0).withColumn("asked_at", local_ts("2026-01-01")), asked, local_ts("2026-02-01"))
    assert P.search_plan(req, matches(spark), cities(spark), skip=ledger).count() == 0
    assert P.search_plan(req, matches(spark), cities(spark), skip=ledger, force=True).count() == 4
    state = spark.createDataFrame([(1, " ATLANTA", True)], "match_id int, origin_city string, is_stale boolean")
    more = req.union(spark.createDataFrame([(3, "Rome")], "match_id int, origin_city string"))
    out = P.cache_outcomes(more, state, ledger)
    assert rows(out.select("match_id", "outcome")) == [(1, "stale"), (2, "negative"), (3, "miss")]
    r = P.cache_report(out).first()
    assert (r.n_requests, r.n_hit, r.n_stale, r.n_negative, r.n_miss) == (3, 0, 1, 1, 1)


def test_match_filters(spark):
    cal = matches(spark).withColumns({"name_team_a": F.lit("France"), "name_team_b": F.lit("Maroc"),
                                      "city_name": F.when(F.col("match_id") == 1, "Miami")})
    now = local_ts("2026-09-13 09:00:00")
    assert I.filter_matches(cal, now).count() == 2
    assert I.filter_matches(cal, now, team="Maroc", bucket="today", home_city="Boston").count() == 1
    assert I.filter_matches(cal, now, home_city="Miami").count() == 1
    assert I.filter_matches(cal, now, team="Chili").count() == 0


def test_routes_equal_listed_itineraries(spark):
    """Numbers from totals per day and up to the bound, without a list of the pairs."""
    r = random.Random(5)
    at = lambda: f"2026-09-{r.randint(8, 15):02d} {r.choice(['00:00:00', '04:59:59', '13:00:00', '13:00:01', '21:30:00'])}"
    legs = [(None if i == 3 else f"j{i}", 0, r.choice(["ATL", "LAX", "MIA"]), "2026-09-08 00:00:00", r.choice(["MIA", "FLL", "ATL", "XXX"]), at())
            for i in range(300)]
    updated = F.when(F.col("origin_city") == "Los Angeles", F.lit("2026-08-20 10:00:00")).otherwise("2026-08-29 00:00:00").cast("timestamp_ntz")
    facts = I.journey_facts(I.with_endpoints(segments(spark, *legs), cities(spark), "left"), legs=False).withColumn("updated_at", updated)
    games = [(1, "2026-09-13 18:00:00", "miami"), (1, "2026-09-13 18:00:00", "Miami"), (1, "2026-09-11 02:00:00", "Atlanta"),
             (2, "2026-09-12 05:00:00", "Miami"), (3, "2026-09-12 04:59:59", "Miami"), (None, "2026-09-12 09:59:59", "MIAMI"),
             (None, "2026-09-14 00:00:00", "Atlanta"), (4, None, "Miami"), (5, "2026-09-14 18:00:00", None), (6, "2027-01-01 18:00:00", "Miami")]
    games = spark.createDataFrame(games, "match_id int, match_date string, city string").withColumn("match_date", F.col("match_date").cast("timestamp_ntz"))
    now, keys = local_ts("2026-09-01 09:00:00"), ["match_id", "origin_city"]
    listed = I.itineraries(facts, games)
    want = rows(I.freshness(listed, keys, now))
    assert len(want) > 8 and {r[-1] for r in want} == {True, False}
    assert rows(I.route_freshness(facts, games, now).select(I.freshness(listed, keys, now).columns)) == want
    assert rows(I.answer_meta(I.routes(facts, games, now, by_origin=False), games, "m")) == rows(I.answer_meta(listed, games, "m"))


def test_pairs_are_neither_stored_nor_shuffled(spark):
    """Behind the join with matches no exchange follows; the journeys go through one."""
    facts = I.journey_facts(I.with_endpoints(segments(spark, DIRECT), cities(spark), "left"))
    plan = I.itineraries(facts, matches(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") - plan.count("LeftOuter") == 1
