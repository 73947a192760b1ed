"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import features as FE
from waylark.operators import models as M
from waylark.plans import domain as D
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import pinned

NOW = "1998-06-01 09:30:00"


@query("scalar_hour_overnight_dow", f"""
WITH {views("obs_flights")}
SELECT l_orderkey, l_linenumber, hour_of_day, day_of_week,
       CASE WHEN hour_of_day >= 21 OR hour_of_day <= 5 THEN 1 ELSE 0 END AS is_overnight
FROM (SELECT l_orderkey, l_linenumber,
             CASE WHEN crs_dep_time IS NULL THEN 12 ELSE least(23, crs_dep_time // 100) END::INT AS hour_of_day,
             (isodow(flight_date) - 1)::INT AS day_of_week FROM obs_flights)""")
def hour_overnight_dow(spark, sf):
    hour = S.hhmm_hour("crs_dep_time")
    return D.obs_flights(spark, sf).select(
        "l_orderkey", "l_linenumber", hour.alias("hour_of_day"),
        S.day_of_week("flight_date").alias("day_of_week"), S.is_overnight(hour).alias("is_overnight"),
    )


@query("duration_proxy_half_even", """
SELECT l_orderkey, l_linenumber, round_even((l_quantity * 50 + 3.5::DOUBLE) / 7.0::DOUBLE, 0) AS duration,
       round_even((l_quantity * 3.5::DOUBLE) / 7.0::DOUBLE, 0) AS half_duration FROM lineitem""")
def duration_proxy(spark, sf):
    q = F.col("l_quantity")
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.duration_proxy(q * 50 + 3.5).alias("duration"),
        S.duration_proxy(q * 3.5).alias("half_duration"),
    )


@query("weather_risk_score", """
SELECT k AS weather_code, CASE WHEN k IN (51, 53, 61, 80) THEN 1
            WHEN k IN (45, 48, 55, 63, 65, 71, 73, 81, 82) THEN 2
            WHEN k IN (75, 95, 96, 99) THEN 3 ELSE 0 END AS weather_risk_score, count(*) AS n
FROM (SELECT CASE WHEN event_id % 17 <> 0 THEN json_extract_string(props, '$.k')::INT END AS k FROM events)
GROUP BY ALL""")
def weather_risk_score(spark, sf):
    k = F.when(F.col("event_id") % 17 != 0, F.get_json_object("props", "$.k").cast("int"))
    return (
        D.table(spark, sf, "events").select(k.alias("weather_code"))
        .groupBy("weather_code", S.weather_risk("weather_code").alias("weather_risk_score"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("booking_status", f"""
WITH {views("matches")}
SELECT match_id, d AS days, CASE WHEN d > 0 AND d <= 30 THEN 'open' WHEN d > 30 THEN 'upcoming' ELSE 'passed' END AS status,
       CASE WHEN d > 30 THEN d - 30 END AS opens_in
FROM (SELECT match_id, ceil(epoch(match_date - TIMESTAMP '{NOW}') / 86400.0)::INT AS d FROM matches)""")
def booking_status(spark, sf):
    s = S.booking_status("match_date", S.local_ts(NOW))
    return D.matches(spark, sf).select("match_id", s.alias("s")).select("match_id", "s.*")


@query("risk_band", """
SELECT band, pct, count(*) AS n FROM (
  SELECT floor(l_discount * 10 * 100 / 3 + 0.5)::INT AS pct,
         CASE WHEN floor(l_discount * 10 * 100 / 3 + 0.5) < 20 THEN 'low'
              WHEN floor(l_discount * 10 * 100 / 3 + 0.5) < 50 THEN 'moderate' ELSE 'high' END AS band
  FROM lineitem) GROUP BY ALL""")
def risk_band(spark, sf):
    p = F.col("l_discount") * 10 / 3
    return (
        D.table(spark, sf, "lineitem")
        .groupBy(S.risk_band(p).alias("band"), F.floor(p * 100 + 0.5).cast("int").alias("pct"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("elapsed_minutes", """
SELECT event_id, floor((epoch_us(ts) - epoch_us(ts::DATE::TIMESTAMP)) / 60000000.0 + 0.5)::INT AS minutes FROM events""")
def elapsed_minutes(spark, sf):
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    return D.table(spark, sf, "events").select("event_id", S.elapsed_minutes(day, "ts").alias("minutes"))


@query("days_ahead", f"""
SELECT o_orderkey, floor(epoch(o_orderdate - TIMESTAMP '{NOW}') / 86400.0)::INT AS days_ahead FROM orders""")
def days_ahead(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", S.whole_days(S.local_ts(NOW), F.col("o_orderdate")).alias("days_ahead")
    )


@query("coerce_numbers", """
SELECT o_orderpriority, count(*) AS n, count(x) AS n_readable, sum(x)::BIGINT AS total FROM (
  SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey::DOUBLE END AS x FROM orders)
GROUP BY 1""")
def coerce_numbers(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))
    ).otherwise(F.when(F.col("o_orderkey") % 2 == 0, "abc").otherwise("NaN"))
    return (
        D.table(spark, sf, "orders").select("o_orderpriority", S.to_number(text).alias("x"))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_readable"),
             F.sum("x").cast("long").alias("total"))
    )


@query("normalised_names", """
SELECT lower(trim(upper(c_mktsegment) || ' ')) AS name, count(*) AS n,
       count(*) FILTER (c_mktsegment = 'BUILDING') AS n_building FROM customer GROUP BY 1""")
def normalised_names(spark, sf):
    c = D.table(spark, sf, "customer")
    padded = F.concat(F.col("c_mktsegment"), F.lit(" "))
    same = S.equals_ignoring_case(padded, F.lit("building"), trim=True)
    return c.groupBy(S.norm_text(padded).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("n_building")
    )


@query("decide_scores", """
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, p)), 4) AS delay_probability,
       greatest(0.0, least(1.0, p)) >= 0.5 AS delay_prediction
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 40.0::DOUBLE - 0.1::DOUBLE AS p FROM lineitem)""")
def decide_scores(spark, sf):
    p = F.col("l_quantity") / 40.0 - 0.1
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *[c.alias(n) for n, c in M.decide(p).items()]
    )


@query("encode_categories", f"""
WITH {views("obs_flights")}, codes AS (
  SELECT airline, (row_number() OVER (ORDER BY airline) - 1)::INT AS code
  FROM (SELECT DISTINCT airline FROM obs_flights WHERE airline <> 'C3'))
SELECT f.airline, coalesce(code, -1)::INT AS airline_code, count(*) AS n
FROM obs_flights f LEFT JOIN codes c ON f.airline = c.airline GROUP BY ALL""")
def encode_categories(spark, sf):
    f = D.obs_flights(spark, sf).select("airline")
    codes = pinned(FE.fit_category_codes(f.filter("airline <> 'C3'"), ["airline"]), "codes")
    return FE.encode(f, codes, {"airline": "airline_code"}).groupBy("airline", "airline_code").agg(
        F.count(F.lit(1)).alias("n")
    )
