"""Views that give the generated tables the shape of the travel domain.

Each view exists twice: as a DataFrame and, under the same name, as a SQL common
table expression for the comparison runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.upsert import dedupe

Spark = SparkSession


def table(spark: Spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- dimensions ---------------------------------------------------------------

def city(spark: Spark, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id_city"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
        (F.col("n_nationkey") % 3 == 0).alias("is_host_city"),
    )


def airport(spark: Spark, sf: str) -> DataFrame:
    """Two per city, none for every seventh; some without coordinates."""
    k = F.col("n_nationkey")
    located = k % 5 != 4
    return table(spark, sf, "nation").filter(k % 7 != 6).select(
        F.explode(F.array(*[F.concat(F.lit(x), k.cast("string")) for x in "AB"])).alias("iata_code"),
        k.alias("id_city"),
        F.when(located, k * 1.5 - 10).alias("latitude"),
        F.when(located, k * 2.0 - 30).alias("longitude"),
    )


def teams(spark: Spark) -> DataFrame:
    return spark.range(48).select(
        F.col("id").cast("int").alias("id_team"),
        F.concat(F.lit("Team "), F.col("id").cast("string")).alias("team_name"),
        F.lit(None).cast("string").alias("flag"),
    )


# --- matches ------------------------------------------------------------------

def matches(spark: Spark, sf: str) -> DataFrame:
    """One match per order, in the customer's city at 18:00."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    cities = city(spark, sf).select("id_city", "city")
    m = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("match_id"),
        F.timestamp_add("HOUR", F.lit(18), F.col("o_orderdate")).alias("match_date"),
        (F.col("o_custkey") % 48).cast("int").alias("id_team_a"),
        ((F.col("o_custkey") + 7) % 48).cast("int").alias("id_team_b"),
        F.col("o_orderstatus").alias("stage"),
        F.col("c_nationkey").alias("id_city"),
        ((F.col("o_custkey") + 7) % 25).cast("int").alias("id_origin"),
    )
    return m.join(cities, "id_city")


# --- segments -----------------------------------------------------------------

def copy_order() -> list:
    """Total order of the copies of a segment; the listed columns decide every tie
    that could show in a result."""
    return [
        (F.col("l_returnflag") == "A").desc(),
        *[F.col(c).asc() for c in (
            "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )],
    ]


def lines(spark: Spark, sf: str) -> DataFrame:
    """lineitem with one row per (order, line)."""
    return dedupe(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], copy_order())


def _leg_columns() -> dict:
    airline = F.concat(F.lit("C"), (F.col("l_suppkey") % 15).cast("string"))
    departs = F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate"))
    return {
        "journey_sk": F.col("l_orderkey"),
        "pos": F.col("l_linenumber") - 1,
        "departure_airport_time": departs,
        "arrival_airport_time": F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), departs),
        "duration": (F.col("l_quantity") * 60).cast("int"),
        "flight_number": F.concat(airline, F.lit(" "), F.col("l_partkey").cast("string")),
        "layover_duration": F.when(
            F.col("l_linenumber") % 3 != 0, (F.col("l_partkey") % 240).cast("int")
        ),
        "price": F.col("l_extendedprice"),
        "airline": airline,
        "is_best": F.col("l_returnflag") == "A",
        "is_delayed": F.when(F.col("l_linestatus") == "O", True),
    }


def legs(spark: Spark, sf: str) -> DataFrame:
    """Segment columns that need nothing but lineitem, one row per (journey, pos)."""
    return lines(spark, sf).select(*[c.alias(n) for n, c in _leg_columns().items()])


def segments(spark: Spark, sf: str, unique: bool = True) -> DataFrame:
    """lineitem with its order's customer (departure) and supplier (arrival)."""
    li = lines(spark, sf) if unique else table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    joined = (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
    )
    return joined.select(
        *[c_.alias(n) for n, c_ in _leg_columns().items()],
        F.concat(F.lit("A"), F.col("c_nationkey").cast("string")).alias("departure_airport_code"),
        F.concat(F.lit("A"), F.col("s_nationkey").cast("string")).alias("arrival_airport_code"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("total_journey_duration"),
        F.col("o_orderdate").alias("updated_at"),
        *([] if unique else ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount",
                             "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"]),
    )


def responses(spark: Spark, sf: str) -> DataFrame:
    """One search document per journey, as JSON text.

    A document holds the legs of one order, at most seven after deduplication.
    """
    stop = lambda code, ts: F.struct(
        F.col(code).alias("id"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("time"))
    leg = F.struct(
        "pos",
        stop("departure_airport_code", "departure_airport_time").alias("departure_airport"),
        stop("arrival_airport_code", "arrival_airport_time").alias("arrival_airport"),
        "duration", "airline", "flight_number",
        F.col("is_delayed").alias("often_delayed_by_over_30_min"),
        F.coalesce(F.col("layover_duration"), F.lit(45)).alias("stop_minutes"),
        "is_best", "price", "total_journey_duration",
    )
    docs = segments(spark, sf).groupBy("journey_sk").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    first = F.get("legs", F.lit(0))
    shown = ["departure_airport", "arrival_airport", "duration", "airline", "flight_number",
             "often_delayed_by_over_30_min"]
    flights = F.transform("legs", lambda x: F.struct(*[x[c].alias(c) for c in shown]))
    stops = F.transform(
        F.slice("legs", 1, F.size("legs") - 1), lambda x: F.struct(x["stop_minutes"].alias("duration"))
    )
    journey = F.struct(
        flights.alias("flights"),
        F.when(F.size("legs") > 1, stops).alias("layovers"),
        first["total_journey_duration"].alias("total_duration"),
        first["price"].alias("price"),
        F.lit("One way").alias("type"),
    )
    listed = F.array(journey)
    doc = F.struct(
        F.struct(F.lit("EUR").alias("currency")).alias("search_parameters"),
        F.when(first["is_best"], listed).alias("best_flights"),
        F.when(~first["is_best"], listed).alias("other_flights"),
    )
    return docs.select(F.col("journey_sk").alias("id"), F.to_json(F.array(doc)).alias("json_data"))


# --- observed flights and weather -----------------------------------------------

def obs_flights(spark: Spark, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    lag = F.datediff("l_shipdate", "o_orderdate")
    raw = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int")).alias("flight_date"),
        F.concat(F.lit("C"), (supp % 15).cast("string")).alias("airline"),
        F.concat(F.lit("A"), (part % 25).cast("string")).alias("origin"),
        F.concat(F.lit("A"), (supp % 25).cast("string")).alias("dest"),
        F.when(part % 50 != 0, (part % 25) * 100 + part % 60).cast("int").alias("crs_dep_time"),
        ((supp % 24) * 100 + part % 60).cast("int").alias("crs_arr_time"),
        F.when(lag >= 0, lag.cast("double")).alias("arr_delay_min"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), 1.0).otherwise(0.0).alias("cancelled"),
        F.when(F.col("l_tax") != 0.08, F.col("l_quantity") * 50 + 3.5).alias("distance"),
    )
    return raw.withColumn("is_delayed", S.delay_label("arr_delay_min", "cancelled"))


def weather_hourly(spark: Spark, sf: str) -> DataFrame:
    """One row per (airport, day, hour): the earliest event."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        "event_id", "value", k.alias("k"),
        F.concat(F.lit("A"), (F.col("user_id") % 25).cast("string")).alias("airport_code"),
        F.col("ts").cast("date").alias("weather_date"),
        F.hour("ts").alias("weather_hour"),
    )
    g = rows.groupBy("airport_code", "weather_date", "weather_hour").agg(
        F.min_by(F.struct("value", "k"), "event_id").alias("e")
    )
    v, kk = F.col("e.value"), F.col("e.k")
    return g.select(
        "airport_code", "weather_date", "weather_hour",
        F.when(kk % 10 != 0, v).alias("temperature_c"),
        ((kk % 7) * 0.5).alias("precipitation_mm"),
        (kk % 100).alias("weather_code"),
        (kk * 0.5).alias("wind_speed_kmh"),
        (10000.0 - kk * 10).alias("visibility_m"),
        F.when(kk % 3 != 0, kk * 0.25).alias("snowfall_cm"),
    )


def flights_with_weather(spark: Spark, sf: str) -> DataFrame:
    from waylark.operators.weather import join_hourly_weather

    return join_hourly_weather(
        obs_flights(spark, sf), weather_hourly(spark, sf),
        ("dest", "airport_code"), ("flight_date", "weather_date"), S.hhmm_hour("crs_arr_time"),
    )


# --- drift sets and metric streams ------------------------------------------------

DRIFT_SPLIT = "1998-01-01"


def drift_sets(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), 1).otherwise(0).alias("is_delayed"),
    )
    cut = S.local_ts(DRIFT_SPLIT)
    return li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut)


def requests(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("event_type").alias("endpoint"),
        (F.col("event_type") == "error").alias("is_5xx"),
        (F.col("value") / 100).alias("latency_s"),
        F.get_json_object("props", "$.k").cast("int").alias("size"),
    )


def gauges(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "ts", "event_id", (F.col("user_id") % 10).cast("int").alias("name"), "value"
    )


# --- the same views in SQL ---------------------------------------------------------

VIEWS_SQL = {
    "city": """
        SELECT n_nationkey AS id_city, n_name AS city, r_name AS country,
               n_nationkey % 3 = 0 AS is_host_city
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "airport": """
        SELECT x || n_nationkey AS iata_code, n_nationkey AS id_city,
               CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey * 1.5::DOUBLE - 10 END AS latitude,
               CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey * 2.0::DOUBLE - 30 END AS longitude
        FROM nation, (VALUES ('A'), ('B')) v(x) WHERE n_nationkey % 7 <> 6""",
    "airport_city": """
        SELECT iata_code, c.id_city, city, country FROM airport a JOIN city c ON a.id_city = c.id_city""",
    "teams": "SELECT range::INT AS id_team, 'Team ' || range AS team_name FROM range(48)",
    "matches": """
        SELECT o_orderkey AS match_id, o_orderdate + INTERVAL 18 HOUR AS match_date,
               (o_custkey % 48)::INT AS id_team_a, ((o_custkey + 7) % 48)::INT AS id_team_b,
               o_orderstatus AS stage, c_nationkey AS id_city, ((o_custkey + 7) % 25)::INT AS id_origin, city
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN city ON c_nationkey = id_city""",
    "lines": """
        SELECT * FROM lineitem QUALIFY row_number() OVER (
            PARTITION BY l_orderkey, l_linenumber
            ORDER BY (l_returnflag = 'A') DESC, l_extendedprice, l_partkey, l_suppkey, l_shipdate,
                     l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) = 1""",
    "legs": """
        SELECT l_orderkey AS journey_sk, l_linenumber - 1 AS pos,
               l_shipdate + l_linenumber * INTERVAL 1 HOUR AS departure_airport_time,
               l_shipdate + (l_linenumber + l_quantity::INT) * INTERVAL 1 HOUR AS arrival_airport_time,
               (l_quantity * 60)::INT AS duration,
               'C' || (l_suppkey % 15) || ' ' || l_partkey AS flight_number,
               CASE WHEN l_linenumber % 3 <> 0 THEN (l_partkey % 240)::INT END AS layover_duration,
               l_extendedprice AS price, 'C' || (l_suppkey % 15) AS airline,
               l_returnflag = 'A' AS is_best, CASE WHEN l_linestatus = 'O' THEN TRUE END AS is_delayed,
               l_suppkey
        FROM lines""",
    "segments": """
        SELECT l.* EXCLUDE (l_suppkey), 'A' || c_nationkey AS departure_airport_code,
               'A' || s_nationkey AS arrival_airport_code,
               floor(o_totalprice / 100)::INT AS total_journey_duration, o_orderdate AS updated_at
        FROM legs l JOIN orders ON journey_sk = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey""",
    "obs_flights": """
        SELECT *, CASE WHEN coalesce(arr_delay_min > 15, FALSE) OR cancelled = 1 THEN 1 ELSE 0 END AS is_delayed
        FROM (SELECT l_orderkey, l_linenumber,
               DATE '2024-01-01' + (l_orderkey % 30)::INT AS flight_date,
               'C' || (l_suppkey % 15) AS airline, 'A' || (l_partkey % 25) AS origin,
               'A' || (l_suppkey % 25) AS dest,
               CASE WHEN l_partkey % 50 <> 0 THEN ((l_partkey % 25) * 100 + l_partkey % 60)::INT END AS crs_dep_time,
               ((l_suppkey % 24) * 100 + l_partkey % 60)::INT AS crs_arr_time,
               CASE WHEN l_shipdate::DATE - o_orderdate::DATE >= 0
                    THEN (l_shipdate::DATE - o_orderdate::DATE)::DOUBLE END AS arr_delay_min,
               CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0.0 END AS cancelled,
               CASE WHEN l_tax <> 0.08::DOUBLE THEN l_quantity * 50 + 3.5 END AS distance
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "weather_hourly": """
        SELECT airport_code, weather_date, weather_hour,
               CASE WHEN k % 10 <> 0 THEN value END AS temperature_c,
               (k % 7) * 0.5::DOUBLE AS precipitation_mm, k % 100 AS weather_code,
               k * 0.5::DOUBLE AS wind_speed_kmh, 10000.0::DOUBLE - k * 10 AS visibility_m,
               CASE WHEN k % 3 <> 0 THEN k * 0.25::DOUBLE END AS snowfall_cm
        FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k,
                     'A' || (user_id % 25) AS airport_code, ts::DATE AS weather_date,
                     hour(ts)::INT AS weather_hour
              FROM events)
        QUALIFY row_number() OVER (PARTITION BY airport_code, weather_date, weather_hour
                                   ORDER BY event_id) = 1""",
    "flights_with_weather": """
        SELECT f.*,
               CASE WHEN x.airport_code IS NOT NULL THEN x.temperature_c ELSE n.temperature_c END AS temperature_c,
               CASE WHEN x.airport_code IS NOT NULL THEN x.precipitation_mm ELSE n.precipitation_mm END AS precipitation_mm,
               CASE WHEN x.airport_code IS NOT NULL THEN x.weather_code ELSE n.weather_code END AS weather_code,
               CASE WHEN x.airport_code IS NOT NULL THEN x.wind_speed_kmh ELSE n.wind_speed_kmh END AS wind_speed_kmh,
               CASE WHEN x.airport_code IS NOT NULL THEN x.visibility_m ELSE n.visibility_m END AS visibility_m,
               CASE WHEN x.airport_code IS NOT NULL THEN x.snowfall_cm ELSE n.snowfall_cm END AS snowfall_cm,
               CASE WHEN x.airport_code IS NOT NULL THEN 'exact'
                    WHEN n.airport_code IS NOT NULL THEN 'fallback' END AS weather_source
        FROM obs_flights f
        LEFT JOIN weather_hourly x ON x.airport_code = dest AND x.weather_date = flight_date
             AND x.weather_hour = least(23, crs_arr_time // 100)
        LEFT JOIN weather_hourly n ON n.airport_code = dest AND n.weather_date = flight_date
             AND n.weather_hour = 12""",
    "drift_rows": """
        SELECT *, l_shipdate < TIMESTAMP '1998-01-01' AS is_ref,
               CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 1 ELSE 0 END AS is_delayed
        FROM lineitem""",
    "requests": """
        SELECT event_id, ts, event_type AS endpoint, event_type = 'error' AS is_5xx,
               value / 100 AS latency_s, json_extract_string(props, '$.k')::INT AS size FROM events""",
    "gauges": "SELECT ts, event_id, (user_id % 10)::INT AS name, value FROM events",
}

_NEEDS = {
    "airport_city": ["city", "airport"],
    "matches": ["city"],
    "legs": ["lines"],
    "segments": ["legs"],
    "flights_with_weather": ["obs_flights", "weather_hourly"],
}


def views(*names: str) -> str:
    """`name AS (...)` list of the wanted views and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({VIEWS_SQL[n]})" for n in ordered)
