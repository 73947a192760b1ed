"""Sources and sinks: rows derived from the tables, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.operators import enrich as E
from waylark.operators import features as FE
from waylark.plans import domain as D
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import new_shared_path
from waylark.sources import readers, static_dims, writers

# On-time columns that the observed flights have.
_ONTIME = ["FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSArrTime", "ArrDelayMinutes", "Cancelled", "Distance"]
_WANTED = {c: readers.ONTIME_COLUMNS[c] for c in _ONTIME}


@query("read_ontime_csv", f"""
WITH {views("obs_flights")}
SELECT strftime(flight_date, '%Y-%m-%d') AS flight_date, airline, origin, dest, crs_dep_time, crs_arr_time, arr_delay_min, cancelled,
       distance, is_delayed, count(*) AS n
FROM obs_flights WHERE dest IN ('A1', 'A2', 'A3') GROUP BY ALL""")
def read_ontime_csv(spark, sf):
    """Flights as files with the published headers and a column that is not wanted."""
    f = D.obs_flights(spark, sf)
    path = new_shared_path(spark, "ontime")
    named = [F.col(name).cast("string").alias(source) for source, (name, _) in _WANTED.items()]
    writers.write_csv(f.select(*named, F.lit("x").alias("TailNumber")), path)
    back = readers.observed_flights(readers.read_ontime(spark, path, _WANTED), ["A1", "A2", "A3"])
    cols = [name for name, _ in _WANTED.values()]
    return back.withColumn("flight_date", F.date_format("flight_date", "yyyy-MM-dd")).groupBy(*cols, "is_delayed").agg(
        F.count(F.lit(1)).alias("n"))


@query("read_airport_reference", """
SELECT 'A' || s_suppkey AS iata_code, 'Airport ' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'Unknown' ELSE 'Town' END AS city,
       'N' || s_nationkey AS country FROM supplier""")
def read_airport_reference(spark, sf):
    """A reference file with every code twice, the second row being ignored."""
    s = D.table(spark, sf, "supplier")
    code = F.concat(F.lit("A"), F.col("s_suppkey").cast("string"))
    first = s.select(
        F.col("s_suppkey").alias("_o"), F.lit(0).alias("_t"), code.alias("iata_code"), F.concat(F.lit("Airport "), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("town").alias("municipality"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("iso_country"))
    again = first.withColumns({"_t": F.lit(1), "name": F.lit("other"), "municipality": F.lit("else"), "iso_country": F.lit("zz")})
    path = new_shared_path(spark, "airports")
    # Several files; the line number of the published list says which row is first.
    line = (F.col("_t") * 10**12 + F.col("_o")).alias("line")
    writers.write_csv(again.unionByName(first).select("*", line).drop("_t", "_o"), path)
    return E.enrich_airports(s.select(code.alias("code")), readers.read_airport_ref(spark, path, "line"))


@query("load_static_dims", """
SELECT FALSE AS is_host_city, count(*) - 1 AS n, min(c_custkey) + 1 AS first_id, max(c_custkey) AS last_id FROM customer
UNION ALL SELECT TRUE, 16, min(c_custkey), max(c_custkey) + 15 FROM customer""")
def load_static_dims(spark, sf):
    """The host cities merged into stored ones, of which one is already there under its name."""
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("id_city"), "c_name")
    least = c.agg(F.min("id_city")).first()[0]
    stored = c.select(
        "id_city", F.when(F.col("id_city") == least, "Boston").otherwise(F.col("c_name")).alias("city"), F.lit("Elsewhere").alias("country"),
        F.lit(None).cast("string").alias("flag"), F.lit(False).alias("is_host_city"))
    city = static_dims.load_dims(spark, {"city": stored})["city"]
    return city.groupBy("is_host_city").agg(
        F.count(F.lit(1)).alias("n"), F.min("id_city").alias("first_id"), F.max("id_city").alias("last_id"))

@query("read_landed_json", f"""
WITH {views("segments")} SELECT count(DISTINCT journey_sk) AS n_documents, count(DISTINCT journey_sk) > 0 AS has_source FROM segments""")
def read_landed_json(spark, sf):
    """Documents as text files; each file is read as a whole."""
    path = new_shared_path(spark, "landing")
    writers.write_documents(D.responses(spark, sf).select("json_data"), path)
    landed = readers.land_json(spark, path)
    n = F.size(F.filter(F.split("json_data", "\n"), lambda x: F.trim(x) != ""))
    return landed.agg(F.sum(n).cast("long").alias("n_documents"), F.bool_and(F.col("source") != "").alias("has_source"))


@query("read_raw_parquet", f"""
WITH {views("segments")} SELECT DISTINCT journey_sk AS id FROM segments WHERE journey_sk IN (1, 2, 3, 5, 8, 13, 21, 34, 55)""")
def read_raw_parquet(spark, sf):
    """Raw documents of a list of jobs from a landing folder."""
    path = new_shared_path(spark, "raw")
    writers.write_table(D.responses(spark, sf), path)
    return readers.read_raw(spark, path, [1, 2, 3, 5, 8, 13, 21, 34, 55]).filter(F.col("json_data").isNotNull()).select("id")


@query("write_staging_twice", f"""
WITH {views("legs")} SELECT journey_sk, count(*) AS n, round(sum(price), 2) AS price FROM legs GROUP BY 1""")
def write_staging_twice(spark, sf):
    """The second write replaces the first."""
    path = new_shared_path(spark, "staging")
    legs = D.legs(spark, sf).select("journey_sk", "pos", "price")
    writers.write_staging(legs.withColumn("price", F.lit(0.0)), path)
    writers.write_staging(legs, path)
    return readers.read_table(spark, path).groupBy("journey_sk").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("full_refresh_twice", f"""
WITH {views("obs_flights")} SELECT dest, count(*) AS n, sum(is_delayed)::BIGINT AS n_delayed FROM obs_flights GROUP BY 1""")
def full_refresh_twice(spark, sf):
    """A reload with other rows before does not show."""
    path = new_shared_path(spark, "observed")
    f = D.obs_flights(spark, sf).select("dest", "flight_date", "is_delayed")
    writers.full_refresh(f.unionByName(f), path)
    writers.full_refresh(f, path)
    return readers.read_table(spark, path).groupBy("dest").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_delayed").alias("n_delayed"))


@query("write_partitioned_table", f"""
WITH {views("obs_flights")} SELECT airline, dest, count(*) AS n FROM obs_flights GROUP BY ALL""")
def write_partitioned_table(spark, sf):
    path = new_shared_path(spark, "partitioned")
    writers.write_table(D.obs_flights(spark, sf).select("airline", "dest", "distance"), path, ["airline"])
    return readers.read_table(spark, path, "dest string, distance double, airline string").groupBy("airline", "dest").agg(
        F.count(F.lit(1)).alias("n"))


@query("codes_saved_and_loaded", f"""
WITH {views("obs_flights")} SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY airline) - 1 AS airline_code FROM obs_flights""")
def codes_saved_and_loaded(spark, sf):
    f = D.obs_flights(spark, sf).select("l_orderkey", "l_linenumber", "airline")
    path = new_shared_path(spark, "codes")
    FE.save_codes(FE.fit_category_codes(f, ["airline"]), path)
    coded = FE.encode(f, FE.load_codes(spark, path), {"airline": "airline_code"})
    return coded.select("l_orderkey", "l_linenumber", F.col("airline_code").cast("long").alias("airline_code"))
