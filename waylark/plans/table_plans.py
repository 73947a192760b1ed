"""Deduplication, upserts, set operations and checks on keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import enrich as E
from waylark.operators import itinerary as I
from waylark.operators import losses as L
from waylark.operators import nested as N
from waylark.operators import upsert as U
from waylark.plans import domain as D
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import new_shared_path
from waylark.sources import schemas

OLD, NOW = "2002-01-01 00:00:00", "2002-02-01 00:00:00"


@query("dedupe_segments", f"""
WITH {views("segments")}
SELECT journey_sk, pos, flight_number, price, is_best, departure_airport_time FROM segments""")
def dedupe_segments(spark, sf):
    raw = D.segments(spark, sf, unique=False)
    return U.dedupe(raw, ["journey_sk", "pos"], D.copy_order()).select(
        "journey_sk", "pos", "flight_number", "price", "is_best", "departure_airport_time"
    )


def _target_source(spark, sf):
    """Stored rows: all but every third order. Arriving rows: every second order and those not stored."""
    s = D.legs(spark, sf).select(
        "journey_sk", "pos", "price", "departure_airport_time", "arrival_airport_time", "is_delayed")
    stored = s.filter("journey_sk % 3 <> 0").withColumns(
        {"created_at": S.local_ts(OLD), "updated_at": S.local_ts(OLD)})
    shift = F.timestamp_add("HOUR", F.lit(2), F.col("departure_airport_time"))
    arriving = s.filter("journey_sk % 2 = 0 OR journey_sk % 3 = 0").withColumns({
        "price": F.round(F.col("price") + 10, 2), "departure_airport_time": shift,
        "arrival_airport_time": F.timestamp_add("HOUR", F.lit(2), F.col("arrival_airport_time")),
    })
    return stored, arriving


_UPSERT = """
SELECT journey_sk, pos,
       CASE WHEN arrives THEN round(price + 10, 2) ELSE price END AS price,
       CASE WHEN arrives THEN departure_airport_time + INTERVAL 2 HOUR ELSE departure_airport_time END AS departure_airport_time,
       CASE WHEN arrives AND NOT known THEN arrival_airport_time + INTERVAL 2 HOUR ELSE arrival_airport_time END AS arrival_airport_time,
       is_delayed,
       CASE WHEN known THEN TIMESTAMP '{old}' ELSE TIMESTAMP '{now}' END AS created_at,
       CASE WHEN arrives THEN TIMESTAMP '{now}' ELSE TIMESTAMP '{old}' END AS updated_at
FROM (SELECT *, journey_sk % 3 <> 0 AS known, journey_sk % 2 = 0 OR journey_sk % 3 = 0 AS arrives FROM legs)"""


@query("upsert_fact", f"WITH {views('legs')} " + _UPSERT.format(old=OLD, now=NOW))
def upsert_fact(spark, sf):
    stored, arriving = _target_source(spark, sf)
    return U.upsert(stored, arriving, ["journey_sk", "pos"], ["price", "departure_airport_time", "is_delayed"],
                    S.local_ts(NOW))


@query("upsert_bucketed_fact", f"WITH {views('legs')} " + _UPSERT.format(old=OLD, now=NOW))
def upsert_bucketed_fact(spark, sf):
    """The same upsert on a fact stored in buckets of its key."""
    part = (F.col("journey_sk") % 4).alias("part")
    stored, arriving = (d.select("*", part) for d in _target_source(spark, sf))
    path = new_shared_path(spark, "bucketed-fact")
    name, keys = path.rsplit("/", 1)[-1].replace("-", "_"), ["journey_sk", "pos"]
    buckets = U.buckets_for(D.table(spark, sf, "lineitem").count(), 8)
    U.bucketed_table(spark, name, path, stored.schema, keys, "part", buckets)
    stored.repartition(buckets, *keys).write.insertInto(name)
    U.upsert_bucketed(spark, name, arriving, keys, ["price", "departure_airport_time", "is_delayed"], S.local_ts(NOW),
                      "part", new_shared_path(spark, "bucketed-staging"), [F.col("price").asc()])
    return spark.table(name).drop("part")


@query("upsert_composite_key", f"""
WITH {views("matches")}, m AS (
  SELECT match_date, id_city, min(id_team_a) AS id_team_a, min(stage) AS stage FROM matches GROUP BY ALL)
SELECT strftime(match_date, '%Y-%m-%d %H:%M') AS match_date, id_city,
       CASE WHEN id_city % 2 = 0 THEN (id_team_a + 1) % 48 ELSE id_team_a END AS id_team_a, stage
FROM m""")
def upsert_composite_key(spark, sf):
    """Calendar upsert on (match_date, id_city): even cities get another team."""
    m = D.matches(spark, sf).groupBy("match_date", "id_city").agg(
        F.min("id_team_a").alias("id_team_a"), F.min("stage").alias("stage"))
    stored = m.filter("id_city % 4 <> 0")
    arriving = m.filter("id_city % 2 = 0").withColumn("id_team_a", (F.col("id_team_a") + 1) % 48)
    out = U.upsert(stored, arriving, ["match_date", "id_city"], ["id_team_a", "stage"], S.local_ts(NOW),
                   created_col=None, updated_col=None)
    return out.withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd HH:mm"))


@query("insert_ignore", f"""
WITH {views("legs")}
SELECT journey_sk, pos, CASE WHEN journey_sk % 3 <> 0 THEN price ELSE round(price + 10, 2) END AS price
FROM legs""")
def insert_ignore(spark, sf):
    """Arriving rows come twice, the second time dearer; the cheaper one is inserted."""
    stored, arriving = _target_source(spark, sf)
    cols = ["journey_sk", "pos", "price"]
    again = arriving.select("journey_sk", "pos", (F.col("price") + 1).alias("price"))
    return U.insert_ignore(stored.select(*cols), again.unionByName(arriving.select(*cols)), ["journey_sk", "pos"])


@query("mark_processed", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-02-01' END AS processed_at
FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus = 'F'""")
def mark_processed(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    ledger = o.filter("id % 4 = 0").select("id", S.local_ts(OLD).alias("processed_at"))
    return U.mark_processed(ledger, o.filter("o_orderstatus = 'F'"), "id", S.local_ts(NOW))


@query("pending_jobs", """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1""")
def pending_jobs(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return U.pending(o, o.filter("id % 4 = 0"), "id").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("pending_pairs", f"""
WITH {views("obs_flights")}
SELECT DISTINCT dest, strftime(flight_date, '%Y-%m-%d') AS flight_date FROM obs_flights WHERE l_linenumber > 2""")
def pending_pairs(spark, sf):
    f = D.obs_flights(spark, sf)
    pairs = U.pending_pairs(f, ["dest", "flight_date"], F.col("l_linenumber") <= 2)
    return pairs.withColumn("flight_date", F.date_format("flight_date", "yyyy-MM-dd"))


@query("unknown_codes", f"""
WITH {views("segments", "airport")}
SELECT DISTINCT code FROM (SELECT departure_airport_code AS code FROM segments
                           UNION ALL SELECT arrival_airport_code FROM segments)
WHERE code NOT IN (SELECT iata_code FROM airport)""")
def unknown_codes(spark, sf):
    s = D.segments(spark, sf)
    return U.unknown_codes(s, ["departure_airport_code", "arrival_airport_code"], D.airport(spark, sf), "iata_code")


@query("enrich_codes", f"""
WITH {views("segments")}, codes AS (
  SELECT DISTINCT code FROM (SELECT departure_airport_code AS code FROM segments
                             UNION ALL SELECT arrival_airport_code FROM segments)),
ref AS (SELECT 'A' || s_nationkey AS code, min(s_suppkey) AS k FROM supplier WHERE s_nationkey <> 20 GROUP BY 1)
SELECT codes.code AS iata_code, CASE WHEN k IS NULL THEN codes.code ELSE 'Airport ' || k END AS name,
       CASE WHEN k IS NULL OR k % 3 = 0 THEN 'Unknown' ELSE 'Saint-Supplier#' || lpad(k::VARCHAR, 9, '0') END AS city,
       CASE WHEN k IS NULL THEN 'Unknown' ELSE 'ISO' || k % 7 END AS country
FROM codes LEFT JOIN ref ON codes.code = ref.code""")
def enrich_codes(spark, sf):
    """Codes in use looked up in a reference with padding, case and blank fields."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    reference = D.table(spark, sf, "supplier").filter("s_nationkey <> 20").select(
        k.alias("row_id"),
        F.concat(F.lit(" a"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("iata_code"),
        F.concat(F.lit("Airport "), text).alias("name"),
        F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("SAINT-"), F.lower("s_name"))).alias("municipality"),
        F.concat(F.lit(" iso"), (k % 7).cast("string")).alias("iso_country"),
    )
    codes = U.distinct_codes(D.segments(spark, sf), ["departure_airport_code", "arrival_airport_code"])
    return E.enrich_airports(codes, reference)


@query("resolve_fk", """
SELECT k AS natural_key, CASE WHEN k < 40 THEN k END::INT AS id_team, n FROM (
  SELECT o_custkey % 48 AS k, count(*) AS n FROM orders GROUP BY 1)""")
def resolve_fk(spark, sf):
    """Team ids by name; names from 40 on are not in the dimension."""
    o = D.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 48).alias("natural_key"),
        F.concat(F.lit("Team "), (F.col("o_custkey") % 48).cast("string")).alias("team"),
    )
    dim = D.teams(spark).filter("id_team < 40")
    return E.resolve_fk(o, dim, ("team", "team_name"), "id_team", "id_team").groupBy("natural_key", "id_team").agg(
        F.count(F.lit(1)).alias("n"))


@query("load_losses", f"""
WITH {views("segments")}, docs AS (SELECT journey_sk, count(*) AS legs FROM segments GROUP BY 1),
x AS (SELECT *, journey_sk % 11 = 0 AS broken, journey_sk % 13 = 0 AS blank FROM docs),
team AS (SELECT count(*) AS n, count(*) FILTER (o_custkey % 48 >= 40) AS lost FROM orders)
SELECT 'documents' AS step, 'rows' AS measure, count(*) AS n FROM x
UNION ALL SELECT 'documents', 'blank', count(*) FILTER (blank) FROM x
UNION ALL SELECT 'documents', 'unreadable', count(*) FILTER (broken AND NOT blank) FROM x
UNION ALL SELECT 'journeys', 'rows', count(*) FILTER (NOT broken AND NOT blank) FROM x
UNION ALL SELECT 'journeys', 'without_legs', 0 * count(*) FROM x
UNION ALL SELECT 'id_team', 'rows', n FROM team
UNION ALL SELECT 'id_team', 'unresolved', lost FROM team""")
def load_losses(spark, sf):
    """Blank and broken documents and names without an id, counted while the tables are written."""
    watch, id_ = L.Watch(), F.col("id")
    docs = D.responses(spark, sf).withColumn("json_data", F.when(id_ % 13 == 0, " ").when(id_ % 11 == 0, "{broken").otherwise(F.col("json_data")))
    N.flatten_responses(docs, watch=watch).write.parquet(new_shared_path(spark, "flattened"))
    o = D.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Team "), (F.col("o_custkey") % 48).cast("string")).alias("team"))
    dim = D.teams(spark).filter("id_team < 40")
    E.resolve_fk(o, dim, ("team", "team_name"), "id_team", "id_team", watch).write.parquet(new_shared_path(spark, "resolved"))
    return watch.report(spark)


@query("unresolved_keys", """
SELECT 'Team ' || (o_custkey % 48) AS team, count(*) AS n FROM orders WHERE o_custkey % 48 >= 40 GROUP BY 1""")
def unresolved_keys(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.concat(F.lit("Team "), (F.col("o_custkey") % 48).cast("string")).alias("team"))
    r = E.resolve_fk(o, D.teams(spark).filter("id_team < 40"), ("team", "team_name"), "id_team", "id_team")
    return E.unresolved(r, "id_team", "team")


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return schemas.duplicate_keys(D.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ensure_columns", """
SELECT o_orderstatus, weather_enriched, temperature_c, count(*) AS n
FROM (SELECT *, FALSE AS weather_enriched, NULL::DOUBLE AS temperature_c FROM orders) GROUP BY ALL""")
def ensure_columns(spark, sf):
    o = schemas.ensure_columns(D.table(spark, sf, "orders"), {
        "weather_enriched": ("boolean", False), "temperature_c": ("double", None), "o_orderstatus": ("string", "?"),
    })
    return o.groupBy("o_orderstatus", "weather_enriched", "temperature_c").agg(F.count(F.lit(1)).alias("n"))


@query("filter_destinations", f"""
WITH {views("obs_flights")}
SELECT dest, count(*) AS n FROM obs_flights WHERE dest IN ('A1', 'A2', 'A3', 'A5', 'A8', 'A13', 'A21') GROUP BY 1""")
def filter_destinations(spark, sf):
    kept = I.filter_in(D.obs_flights(spark, sf), "dest", ["A1", "A2", "A3", "A5", "A8", "A13", "A21"])
    return kept.groupBy("dest").agg(F.count(F.lit(1)).alias("n"))
