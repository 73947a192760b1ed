import json
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_nested import DIRECT, ONE_STOP

from waylark.functions.scalars import local_ts
from waylark.operators import rules as R
from waylark.sources import schemas
from waylark.streaming import alerts, ingest

T0 = datetime(2026, 9, 1)


def put(folder, name, doc):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(doc))


def fact(spark, path):
    return spark.read.schema(schemas.SEGMENT).parquet(str(path))


def run(spark, base, month, **kw):
    q = ingest.ingest_stream(spark, str(base / "in"), str(base / "fact"), str(base / "ckpt"),
                             now=local_ts(f"2026-{month:02d}-01"), **kw)
    q.awaitTermination()
    assert q.exception() is None


def test_documents_arrive_in_two_runs(spark, tmp_path):
    put(tmp_path / "in", "1.json", {"best_flights": [DIRECT], "other_flights": [DIRECT | {"price": 1}, ONE_STOP]})
    run(spark, tmp_path, 1)
    first = {r.flight_sk: r for r in fact(spark, tmp_path / "fact").collect()}
    assert len(first) == 3 and float(first["dac2162568fd6e31c2e96a6aca9cac9a"].price) == 239.0  # the best offer wins
    put(tmp_path / "in", "2.json", {"best_flights": [DIRECT | {"price": 300, "total_duration": 1}]})
    run(spark, tmp_path, 2)
    run(spark, tmp_path, 3)  # nothing new
    second = {r.flight_sk: r for r in fact(spark, tmp_path / "fact").collect()}
    assert len(second) == 3
    changed = second["dac2162568fd6e31c2e96a6aca9cac9a"]
    assert (float(changed.price), changed.total_journey_duration) == (300.0, 165)
    assert (changed.created_at.month, changed.updated_at.month) == (1, 2)
    assert {r.updated_at.month for k, r in second.items() if k != changed.flight_sk} == {1}


@pytest.mark.parametrize("once", [None, "1 hour"])
def test_a_document_delivered_twice_is_parsed_once(spark, tmp_path, once):
    old, new = {"best_flights": [DIRECT]}, {"best_flights": [DIRECT | {"price": 300}]}
    for month, (name, doc) in enumerate([("1.json", old), ("2.json", new), ("3.json", old)], 1):
        put(tmp_path / "in", name, doc)
        (tmp_path / "in" / f"{month}.txt").write_text("no document")
        run(spark, tmp_path, month, once_within=once)
    (r,) = fact(spark, tmp_path / "fact").collect()
    assert (float(r.price), r.updated_at.month) == ((300.0, 2) if once else (239.0, 3))
    assert spark.read.text(str(tmp_path / "ckpt/rejected/*")).count() == (1 if once else 3)


def test_a_failed_batch_is_repeated(spark, tmp_path):
    put(tmp_path / "in", "1.json", {"best_flights": [DIRECT]})

    def die(batch_id):
        raise RuntimeError("lost the driver")

    q = ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "fact"), str(tmp_path / "ckpt"),
                             now=local_ts("2026-01-01"), after=die)
    with pytest.raises(Exception):
        q.awaitTermination()
    run(spark, tmp_path, 2)
    assert rows(fact(spark, tmp_path / "fact").select(F.month("created_at"))) == [(1,)]


def test_partition_must_follow_from_the_key(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.upsert_documents(spark.createDataFrame([], "value string"), "x", "y", partition="pos")


def stream_of(spark, data, schema, folder, files=3, select=None):
    """The rows as files that arrive one after the other, oldest first."""
    step = -(-len(data) // files)
    for k in range(0, len(data), step):
        part = spark.createDataFrame(data[k:k + step], schema)
        (part.select(*select) if select else part).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stored = spark.read.parquet(str(folder))
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def collect_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


SAMPLE = "ts timestamp, name string, value double"


def test_windowed_rules_equal_their_batch_form(spark, tmp_path):
    data = [(T0 + timedelta(seconds=20 * i), "ab"[i % 2], float(i % 9)) for i in range(300)]
    df = spark.createDataFrame(data, SAMPLE)
    s = stream_of(spark, data, SAMPLE, tmp_path / "m")
    err = F.col("value") == 0
    live = collect_stream(spark, alerts.error_ratio_stream(s, "ts", err), "ratios")
    batch = R.error_ratio(df, "ts", err)
    pick = lambda d: rows(d.select(F.col("window_start").cast("timestamp_ntz"), "n_errors", "n_requests"))
    # windows that the watermark has passed, and no others
    assert 80 < len(pick(live)) and set(pick(live)) <= set(pick(batch))
    bounds = [1.0, 4.0, 7.0]
    live = collect_stream(spark, alerts.latency_quantile_stream(s, "ts", "value", bounds, by=["name"]), "quantiles")
    batch = R.latency_quantile(df, "ts", "value", bounds, by=["name"])
    pick = lambda d: rows(d.select("name", F.col("window_start").cast("timestamp_ntz"), F.round("quantile", 9)))
    assert 160 < len(pick(live)) and set(pick(live)) <= set(pick(batch))


def test_hold_on_a_stream(spark, tmp_path):
    data = [(T0 + timedelta(minutes=m), "x", 9.0 if 10 <= m < 25 or 40 <= m < 43 else 0.0) for m in range(60)]
    s = stream_of(spark, data, SAMPLE, tmp_path / "h", 5,
                  ["name", (F.col("value") > 5).alias("on"), F.unix_micros("ts").alias("at")])
    got = collect_stream(spark, alerts.hold_stream(s, 600), "holds")
    start, fired, end = (T0 + timedelta(minutes=m) for m in (10, 20, 25))
    assert rows(got) == sorted([("x", start, fired, None), ("x", start, fired, end)], key=repr)


def test_hold_after_evaluation_per_interval(spark, tmp_path):
    data = [(T0 + timedelta(seconds=10 * i), "x", 9.0 if 60 <= i < 180 else 0.0) for i in range(600)]
    s = stream_of(spark, data, SAMPLE, tmp_path / "e", 5)
    checks = alerts.evaluations(s, "name", "ts", F.col("value") > 5, "1 minute", "1 minute")
    out = str(tmp_path / "checks")
    checks.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True).start().awaitTermination()
    again = spark.readStream.schema("name string, on boolean, at bigint").parquet(out)
    got = collect_stream(spark, alerts.hold_stream(again, 600), "evaluated")
    start, fired, end = (T0 + timedelta(minutes=m) for m in (11, 21, 31))
    assert rows(got) == sorted([("x", start, fired, None), ("x", start, fired, end)], key=repr)


def test_grouped_notices_equal_their_batch_form(spark, tmp_path):
    """The last event is far later, so that every notice before it has fallen due."""
    spans = [(0, 400), (20, 50), (100, 5 * 3600), (6 * 3600, 6 * 3600 + 10), (7 * 3600, 7 * 3600 + 1800),
             (7 * 3600 + 900, 7 * 3600 + 1000), (30 * 3600, 30 * 3600 + 60)]
    at = lambda s: T0 + timedelta(seconds=s)
    batch = R.group_alerts(spark.createDataFrame(
        [("x", "s", at(a), at(b)) for a, b in spans],
        "name string, service string, fired_at timestamp_ntz, resolved_at timestamp_ntz"), ["name", "service"])
    events = sorted([(at(a), "x", "s", "firing") for a, _ in spans] + [(at(b), "x", "s", "resolved") for _, b in spans])
    s = stream_of(spark, events, "ts timestamp, name string, service string, kind string", tmp_path / "g", 4)
    live = collect_stream(spark, alerts.group_stream(s, "ts"), "notices")
    want = {tuple(r) for r in batch.collect()}
    got = rows(live)
    assert len(got) == len(set(got)) and set(got) == want


def test_silence_is_told_by_a_timer(spark, tmp_path):
    """x falls silent and comes back, y sends until the end."""
    at = lambda m: T0 + timedelta(minutes=m)
    data = sorted([(at(m), "x", 1.0) for m in (*range(10), *range(50, 55))] + [(at(m), "y", 1.0) for m in range(80)])
    s = stream_of(spark, data, SAMPLE, tmp_path / "s", 8)
    got = rows(collect_stream(spark, alerts.silence_stream(s, "name", "ts", 300, 300, "1 minute"), "silence"))
    want = [("x", at(9), at(19), "silent"), ("x", at(9), at(50), "back"), ("x", at(54), at(64), "silent")]
    assert got == sorted(want, key=repr)
    quiet = R.last_seen_rule(spark.createDataFrame(data, SAMPLE).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["name"], "ts",
                             local_ts("2026-09-01 01:20:00"), 300, 300)
    assert {r.name for r in quiet.collect() if r.is_firing} == {"x"}


def test_silence_within_one_batch(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    data = [(at(m), "x", 1.0) for m in (*range(10), *range(50, 55), *range(70, 200))]
    s = stream_of(spark, data, SAMPLE, tmp_path / "s", 1)
    got = rows(collect_stream(spark, alerts.silence_stream(s, "name", "ts", 300, 300, "1 minute"), "one_batch"))
    want = [("x", at(9), at(19), "silent"), ("x", at(9), at(50), "back"), ("x", at(54), at(64), "silent"), ("x", at(54), at(70), "back")]
    assert got == sorted(want, key=repr)


def test_unreadable_documents_are_kept_and_staging_is_cleared(spark, tmp_path):
    put(tmp_path / "in", "1.json", {"best_flights": [DIRECT]})
    (tmp_path / "in" / "broken.json").write_text('{"best_flights": [')
    run(spark, tmp_path, 1)
    put(tmp_path / "in", "2.json", {"best_flights": [ONE_STOP]})
    run(spark, tmp_path, 2)
    assert fact(spark, tmp_path / "fact").count() == 3
    rejected = [r.value for r in spark.read.text(str(tmp_path / "ckpt" / "rejected" / "*")).collect()]
    assert rejected == ['{"best_flights": [']
    assert [p.name for p in (tmp_path / "ckpt" / "staged").iterdir() if p.is_dir()] == ["batch-1"]
