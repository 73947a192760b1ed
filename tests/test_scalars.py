import pytest
from conftest import rows
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.functions.pvalues import _chi2_tail, kolmogorov_tail


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("value,hour", [(None, 12), ("2400", 23), ("abc", 12), ("5", 0), ("1745", 17), ("NaN", 12), ("59", 0)])
def test_hhmm_hour(spark, value, hour):
    assert one(spark, S.hhmm_hour(F.lit(value))) == hour


@pytest.mark.parametrize("hour,flag", [(5, 1), (6, 0), (20, 0), (21, 1), (0, 1)])
def test_overnight(spark, hour, flag):
    assert one(spark, S.is_overnight(F.lit(hour))) == flag


@pytest.mark.parametrize("miles,minutes", [(17.5, 2.0), (24.5, 4.0), (70.0, 10.0)])
def test_duration_ties_go_to_even(spark, miles, minutes):
    assert one(spark, S.duration_proxy(F.lit(miles))) == minutes


@pytest.mark.parametrize("delay,cancelled,label", [
    (15.0, 0.0, 0), (16.0, 0.0, 1), (None, 0.0, 0), (None, 1.0, 1), (None, None, 0), (3.0, 1.0, 1)])
def test_delay_label(spark, delay, cancelled, label):
    c = S.delay_label(F.lit(delay).cast("double"), F.lit(cancelled).cast("double"))
    assert one(spark, c) == label


@pytest.mark.parametrize("code,risk", [(0, 0), (75, 3), (99, 3), (55, 2), (80, 1), (7, 0), (None, 0)])
def test_weather_risk(spark, code, risk):
    assert one(spark, S.weather_risk(F.lit(code).cast("int"))) == risk


@pytest.mark.parametrize("text,want", [
    ("saint-denis", "Saint-Denis"), ("new   york", "New   York"), ("o'HARE", "O'Hare"), ("ÉVRY", "Évry"), ("2nd st", "2Nd St")])
def test_title_case(spark, text, want):
    assert one(spark, S.title_case(F.lit(text))) == want == text.title()


@pytest.mark.parametrize("arrival,inside", [
    ("2026-09-10 00:00:00", True), ("2026-09-09 23:59:59", False),
    ("2026-09-13 13:00:00", True), ("2026-09-13 13:00:01", False)])
def test_arrival_window_bounds(spark, arrival, inside):
    c = S.arrival_window(S.local_ts("2026-09-13 18:00:00"), S.local_ts(arrival))
    assert one(spark, c) is inside


@pytest.mark.parametrize("p,band", [(0.194, "low"), (0.195, "moderate"), (0.494, "moderate"), (0.495, "high"), (None, None)])
def test_risk_band(spark, p, band):
    assert one(spark, S.risk_band(F.lit(p).cast("double"))) == band


@pytest.mark.parametrize("match,want", [
    ("2026-09-01 12:00:00", (1, "open", None)), ("2026-08-31 12:00:00", (0, "passed", None)),
    ("2026-09-30 12:00:00", (30, "open", None)), ("2026-09-30 12:01:00", (31, "upcoming", 1)),
    ("2026-08-01 12:00:00", (-30, "passed", None))])
def test_booking_status(spark, match, want):
    c = S.booking_status(S.local_ts(match), S.local_ts("2026-08-31 12:00:00"))
    assert tuple(one(spark, c)) == want


def test_whole_days_floor(spark):
    now = S.local_ts("2026-01-10 12:00:00")
    assert one(spark, S.whole_days(now, S.local_ts("2026-01-10 00:00:00"))) == -1
    assert one(spark, S.whole_days(S.local_ts("2026-01-03 13:00:00"), now)) == 6
    assert one(spark, S.whole_days(S.local_ts("2026-01-03 12:00:00"), now)) == 7


def test_missing_probability_stays_missing(spark):
    assert one(spark, S.clamp_probability(F.lit(None).cast("double"))) is None
    assert one(spark, S.clamp_probability(F.lit(1.5))) == 1.0
    assert one(spark, S.clamp_probability(F.lit(-0.5))) == 0.0


def test_number_and_nan(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert rows(df.select(S.to_number("v"))) == [(1.5,), (None,), (None,), (None,)]


def test_date_buckets(spark):
    now = S.local_ts("2026-09-13 10:00:00")
    df = spark.createDataFrame(
        [("2026-09-13 00:00:00",), ("2026-09-14 00:00:00",), ("2026-09-19 23:59:59",), ("2026-09-20 00:00:00",)], "t string"
    ).select(F.col("t").cast("timestamp_ntz").alias("t"))
    counts = {b: df.filter(S.date_bucket("t", b, now)).count() for b in ("today", "tomorrow", "week", "all")}
    assert counts == {"today": 1, "tomorrow": 1, "week": 3, "all": 4}
    with pytest.raises(ValueError):
        S.date_bucket("t", "month", now)


@pytest.mark.parametrize("x,df,p", [
    # table values of the chi-square distribution
    (3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05),
    (6.634897, 1, 0.01), (0.0, 5, 1.0)])
def test_chi2_tail(x, df, p):
    assert _chi2_tail(x, df) == pytest.approx(p, abs=1e-6)


def test_kolmogorov_tail(spark):
    # lambda = 1.358 is the 5 % point, 1.628 the 1 % point of the limit law
    for lam, p in ((1.3581, 0.05), (1.6276, 0.01)):
        stat = lam / (1000 * 1000 / 2000) ** 0.5
        got = one(spark, kolmogorov_tail(F.lit(stat), F.lit(1000), F.lit(1000)))
        assert got == pytest.approx(p, abs=2e-4)
    assert one(spark, kolmogorov_tail(F.lit(0.0), F.lit(10), F.lit(10))) == 1.0
