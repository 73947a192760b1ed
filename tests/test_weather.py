import pytest
from conftest import rows
from pyspark.sql import functions as F

from waylark.functions.scalars import local_ts
from waylark.operators import planning as P
from waylark.operators import weather as WX
from waylark.operators.lookup import lookup_join

W_SCHEMA = "a string, d string, weather_hour int, temperature_c double, weather_code int"


def weather(spark, *data):
    return spark.createDataFrame(list(data), W_SCHEMA).withColumn("d", F.to_date("d"))


def flights(spark, *data):
    return spark.createDataFrame(list(data), "id int, dest string, day string, h int").withColumn("day", F.to_date("day"))


def test_hour_then_noon_then_nothing(spark):
    w = weather(spark, ("MIA", "2025-06-15", 9, None, None), ("MIA", "2025-06-15", 12, 30.0, 2),
                ("ATL", "2025-06-15", 8, 25.0, 1))
    f = flights(spark, (1, "MIA", "2025-06-15", 9), (2, "MIA", "2025-06-15", 10), (3, "ATL", "2025-06-15", 9),
                (4, "MIA", "2025-06-16", 12), (5, None, None, 12))
    got = WX.join_hourly_weather(f, w, ("dest", "a"), ("day", "d"), F.col("h"))
    assert rows(got.select("id", "temperature_c", "weather_source")) == [
        (1, None, "exact"), (2, 30.0, "fallback"), (3, None, None), (4, None, None), (5, None, None)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookup_join_small_and_large(spark, threshold):
    """A third of the rows share one key, some have none; broadcast or shuffled, the result is the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    big = spark.range(3000).select(
        F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 != 1, F.col("id") % 50).alias("k"))
    look = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = {(v, 7 if v % 3 == 0 else v % 50 if v % 100 != 1 else None) for v in range(3000)}
    try:
        got = rows(lookup_join(big, look, ["k"]).select("v", "k", "w"))
        matched = lookup_join(big, look, ["k"], "inner").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(((v, k, 2 * k if k is not None and k < 40 else None) for v, k in want), key=repr)
    assert matched == sum(k is not None and k < 40 for _, k in want)


def cascade(spark, segs, forecast, stored):
    s = spark.createDataFrame(segs, "k int, dest string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    st = spark.createDataFrame(stored, "k int, temperature_c double, weather_code int")
    got = WX.weather_cascade(s, weather(spark, *forecast), st, ["k"], ("dest", "a"), "t",
                             local_ts("2026-09-01 12:00:00"), day="d")
    return rows(got.select("k", "temperature_c", "weather_code", "weather_source"))


def test_cascade_is_row_wise(spark):
    got = cascade(
        spark,
        [(1, "MIA", "2026-09-17 13:00:00"), (2, "MIA", "2026-09-18 13:00:00"), (3, "MIA", "2026-09-01 11:00:00"),
         (4, "ATL", "2026-09-02 13:00:00"), (5, "LAX", "2026-09-02 13:00:00")],
        [("MIA", "2026-09-17", 13, 31.0, None), ("MIA", "2026-09-18", 13, 32.0, 3), ("MIA", "2026-09-01", 11, 33.0, 3),
         ("ATL", "2026-09-02", 13, None, 95)],
        [(1, 1.0, 61), (2, 2.0, 61), (3, None, 63), (4, 4.0, None)],
    )
    assert got == [
        (1, 31.0, 0, "forecast"),   # 16 days ahead counts; the forecast's missing code is not taken from the stored row
        (2, 2.0, 61, "stored"),     # 17 days ahead does not
        (3, 20.0, 63, "stored"),    # an hour ago is day -1; the stored row's missing temperature takes the default
        (4, 4.0, 0, "stored"),      # a forecast without temperature does not count
        (5, 20.0, 0, "default"),
    ]


def test_seasonal_on_leap_day(spark):
    s = spark.createDataFrame([(1, "MIA", "2028-02-29 09:00:00"), (2, "MIA", "2028-03-01 12:00:00")], "k int, dep string, t string")
    s = s.withColumn("t", F.col("t").cast("timestamp_ntz"))
    w = weather(spark, ("MIA", "2027-02-28", 9, 10.0, 1), ("MIA", "2027-03-01", 11, 11.0, 1))
    got = WX.seasonal_weather(s, w, ("dep", "a"), "t", day="d")
    assert rows(got.select("k", F.col("weather_date").cast("string"), "temperature_c")) == [
        (1, "2027-02-28", 10.0), (2, "2027-03-01", None)]


def test_missing_weather_and_plan(spark):
    air = spark.createDataFrame([("MIA", 1.0, 2.0), ("XXX", None, None)], "iata_code string, latitude double, longitude double")
    seg = spark.createDataFrame([(1, "MIA"), (2, "MIA"), (3, "XXX"), (4, "QQQ")], "k int, departure_airport_code string")
    stored = spark.createDataFrame([(2,)], "k int")
    assert rows(WX.missing_weather(seg, air, stored, ["k"]).select("k")) == [(1,)]
    f = flights(spark, (1, "MIA", "2025-06-15", 9), (2, "MIA", "2025-06-15", 10), (3, "XXX", "2025-06-15", 1), (4, "MIA", "2025-06-16", 1))
    plan = P.weather_plan(f, "dest", "day", air, F.col("id") == 4)
    assert rows(plan.select("airport", "fetchable")) == [("MIA", True), ("XXX", False)]


def test_enriched_mark(spark):
    air = spark.createDataFrame([("MIA", 1.0), ("XXX", None)], "iata_code string, latitude double")
    f = flights(spark, (1, "MIA", "2025-06-15", 9), (2, "MIA", "2025-06-16", 9), (3, "XXX", "2025-06-16", 9), (4, "QQQ", "2025-06-16", 9))
    w = weather(spark, ("MIA", "2025-06-15", 3, 20.0, 1))
    got = WX.enrich_flights(f, w, air, ("dest", "a"), ("day", "d"), F.col("h"))
    assert rows(got.select("id", "temperature_c", "weather_enriched")) == [
        (1, None, True), (2, None, False), (3, None, True), (4, None, True)]


def test_null_and_repeated_hours(spark):
    w = spark.createDataFrame(
        [("A", "d", None, 9.0), ("A", "d", 5, None), ("A", "d", 5, 3.0), ("A", "d", 5, 4.0)],
        "airport string, day string, hour int, temperature_c double")
    f = spark.createDataFrame([(1, "A", "d", 5), (2, "A", None, 5), (3, None, "d", 5)], "id int, a string, d string, h int")
    out = WX.join_hourly_weather(f, w, ("a", "airport"), ("d", "day"), F.col("h"), "hour")
    assert {r.id: (r.temperature_c, r.weather_source) for r in out.collect()} == {1: (3.0, "exact"), 2: (None, None), 3: (None, None)}
