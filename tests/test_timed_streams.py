import random
import time
from datetime import timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_streaming import SAMPLE, T0, collect_stream, stream_of

from waylark.operators import rules as R
from waylark.streaming import alerts, timed

STAMPS = ["started_at", "fired_at", "last_breach_at", "resolved_at"]


@pytest.fixture(autouse=True)
def state_store(spark):
    """Each test leaves the session's state store as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def samples(spark):
    """Two services with breaches of different length; the last row is far later and moves the watermark."""
    data = []
    for s, name in enumerate("ab"):
        for i in range(900):
            m = i * 20 / 60
            bad = 20 <= m < 60 or 100 <= m < 104 or 150 <= m < 200 + 50 * s or m >= 285
            data.append((T0 + timedelta(seconds=20 * i + s), name, 9.0 if bad and i % 3 else 0.1))
    data.sort()
    return data, [*data, (T0 + timedelta(days=3), "z", 0.0)]


def compared(spark, live, batch):
    got = timed.latest_episodes(live.where("name <> 'z'"), ["name"])
    want = batch.select("name", *[F.col(c).cast("timestamp").alias(c) for c in STAMPS])
    done = lambda d: rows(d.where("resolved_at IS NOT NULL").select("name", *STAMPS))
    fired = lambda d: rows(d.select("name", "started_at", "fired_at"))
    assert done(got) == done(want) and fired(got) == fired(want)
    return len(done(got)), len(fired(got))


def ntz(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_error_ratio_with_hold_in_one_query(spark, tmp_path):
    data, sent = samples(spark)
    s = stream_of(spark, sent, SAMPLE, tmp_path / "m", 6)
    err = F.col("value") > 5
    live = collect_stream(spark, timed.error_ratio_alert_stream(s, "ts", err, ["name"]), "held_ratio")
    batch = R.error_ratio_alert(ntz(spark.createDataFrame(data, SAMPLE)), "ts", err, ["name"])
    assert compared(spark, live, batch) == (6, 8)


def test_latency_with_hold_in_one_query(spark, tmp_path):
    data, sent = samples(spark)
    bounds = [0.5, 1.0, 5.0, 10.0]
    s = stream_of(spark, sent, SAMPLE, tmp_path / "l", 3)
    live = collect_stream(spark, timed.latency_alert_stream(s, "ts", "value", bounds, ["name"]), "held_latency")
    batch = R.latency_alert(ntz(spark.createDataFrame(data, SAMPLE)), "ts", "value", bounds, ["name"])
    assert min(compared(spark, live, batch)) >= 4


def test_samples_with_hold_in_one_query(spark, tmp_path):
    data = [(T0 + timedelta(seconds=10 * i), "x", 9.0 if 60 <= i < 180 else 0.0) for i in range(600)]
    s = stream_of(spark, [*data, (T0 + timedelta(days=1), "z", 0.0)], SAMPLE, tmp_path / "e", 5)
    live = collect_stream(spark, timed.sample_alert_stream(s, ["name"], "ts", F.col("value") > 5, hold=600), "held_samples")
    start, fired, last, end = (T0 + timedelta(minutes=m) for m in (11, 21, 30, 31))
    assert rows(live) == sorted([("x", start, fired, fired, None), ("x", start, fired, last, end)], key=repr)


def test_a_stream_that_stops_is_told(spark, tmp_path):
    """Nothing arrives any more, from nobody: the clock tells it; one series comes back."""
    folder = tmp_path / "s"
    data = [(T0 + timedelta(seconds=i), n, 1.0) for i in range(3) for n in "xy"]
    s = stream_of(spark, data, SAMPLE, folder, 1)
    q = timed.silence_by_clock(s, ["name"], "ts", 2).writeStream.format("memory").queryName("clock").option(
        "checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        def wait(n):
            for _ in range(240):
                assert q.exception() is None
                if spark.table("clock").count() >= n:
                    return
                time.sleep(0.5)
            raise AssertionError(spark.table("clock").collect())

        wait(2)
        spark.createDataFrame([(T0 + timedelta(seconds=9), "y", 1.0)], SAMPLE).coalesce(1).write.mode("append").parquet(str(folder))
        wait(4)
    finally:
        q.stop()
    got = [(r.name, r.kind, r.last_seen) for r in spark.table("clock").orderBy("noticed_at", "name").collect()]
    at = lambda i: T0 + timedelta(seconds=i)
    assert got == [("x", "silent", at(2)), ("y", "silent", at(2)), ("y", "back", at(2)), ("y", "silent", at(9))]
    assert alerts.SILENCE_STATE  # the form on the samples' own time stays


def out_of_order(seed):
    """Samples that arrive up to four minutes late, with equal times and a counter that is reset."""
    rng = random.Random(seed)
    data, level = [], {"a": 0.0, "b": 5.0}
    for i in range(400):
        for name in "ab":
            level[name] = 0.0 if rng.random() < 0.03 else level[name] + rng.choice([0, 0, 1, 2.5])
            if rng.random() < 0.8 and not 120 <= i < 170:
                data.append((T0 + timedelta(seconds=20 * i + (7 if name == "b" else 0)), name, level[name]))
    arrival = sorted(data, key=lambda r: r[0].timestamp() + rng.uniform(0, 240))
    assert arrival != data
    return data, [*arrival, (T0 + timedelta(days=3), "z", 0.0)]


@pytest.mark.parametrize("files", [1, 9])
def test_changes_and_rates_put_samples_in_order(spark, tmp_path, files):
    data, sent = out_of_order(files)
    batch = ntz(spark.createDataFrame(data, SAMPLE))
    stamp = lambda d: d.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})
    s = stream_of(spark, sent, SAMPLE, tmp_path / "c", files)
    live = collect_stream(spark, timed.changes_stream(s, ["name"], "ts", "value", 600, 60), f"changes_{files}")
    want = stamp(R.changes_rule(batch, ["name"], ["ts"], "value", 600, 60)).withColumn("n_changes", F.col("n_changes").cast("bigint"))
    assert rows(live) == rows(want.select(live.columns)) and live.count() > 200
    assert {r.is_firing for r in live.collect()} == {True, False}
    s = stream_of(spark, sent, SAMPLE, tmp_path / "r", files)
    live = collect_stream(spark, timed.counter_rate_stream(s, ["name"], "ts", "value", 600, 60), f"rates_{files}")
    assert rows(live) == rows(stamp(R.counter_rate(batch, ["name"], ["ts"], "value", 600, 60)).select(live.columns))


def test_samples_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    data = [(at(0), "a", 1.0), (at(1), "a", 3.0), (at(60), "a", 4.0), (at(2), "a", 9.0), (at(61), "a", 6.0), (at(600), "z", 0.0)]
    s = stream_of(spark, data, SAMPLE, tmp_path / "late", len(data))
    live = collect_stream(spark, timed.counter_rate_stream(s, ["name"], "ts", "value", 120, 60), "late_rates")
    assert [(r.window_start, r.increase) for r in live.orderBy("window_start").collect()] == [(at(0), 2.0), (at(60), 2.0)]
