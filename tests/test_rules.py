import bisect
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from waylark.operators import ordered as O
from waylark.operators import rules as R

T0 = datetime(2026, 9, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def samples(spark, data):
    """(name, seconds, value) with a running id as tie breaker."""
    rows_ = [(n, at(s), i, float(v)) for i, (n, s, v) in enumerate(data)]
    return spark.createDataFrame(rows_, "name string, ts timestamp_ntz, id int, value double")


@pytest.fixture(scope="module")
def hot(spark):
    """One series holds most rows, nearly all of them within one hour."""
    rnd = random.Random(8)
    data = [("hot", rnd.randrange(1800), rnd.randrange(5)) for _ in range(1500)]
    data += [("hot", rnd.randrange(40 * 3600), rnd.randrange(5)) for _ in range(100)]
    data += [("hot", 777, rnd.randrange(5)) for _ in range(1000)]  # one timestamp holds a third
    data += [(f"s{rnd.randrange(6)}", rnd.randrange(40 * 3600), rnd.randrange(5)) for _ in range(400)]
    return data, samples(spark, data)


def by_series(data):
    out = {}
    for i, (n, s, v) in enumerate(data):
        out.setdefault(n, []).append((s, i, float(v)))
    return {n: sorted(x) for n, x in out.items()}


def test_previous_row_over_slices(hot):
    data, df = hot
    got = {r.id: r.prev_value for r in O.with_previous(df, ["name"], ["ts", "id"], ["value"]).collect()}
    want = {}
    for series in by_series(data).values():
        for before, now in zip([None, *series], series):
            want[now[1]] = before and before[2]
    assert got == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_max_over_slices(hot, inclusive):
    data, df = hot
    got = {r.id: r.top for r in O.with_running_max(df, ["name"], ["ts", "id"], "value", "top", inclusive).collect()}
    want = {}
    for series in by_series(data).values():
        top = None
        for _, i, v in series:
            new = v if top is None else max(top, v)
            want[i] = new if inclusive else top
            top = new
    assert got == want


def test_parts_cut_a_hot_hour_and_a_hot_timestamp(hot):
    _, df = hot
    placed = O.in_parts(df, ["name", "ts", "id"], "placed", parts=64)
    sizes = [r["count"] for r in placed.groupBy("name", O.PART).count().collect()]
    assert max(sizes) < 200 and sum(sizes) == df.count()
    ends = placed.groupBy(O.PART).agg(F.min(F.struct("name", "ts", "id")), F.max(F.struct("name", "ts", "id"))).orderBy(O.PART).collect()
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("parts", [1, 9, 64])
def test_parts_carry_over(hot, parts):
    """Rows that come with ranges keep them; a series goes through many."""
    data, df = hot
    placed = O.in_parts(df, ["name", "ts", "id"], "placed", parts)
    p = O.with_previous(placed, ["name"], ["ts", "id"], ["value"])
    got = {r.id: (r.prev_value, r.top) for r in O.with_running_max(p, ["name"], ["ts", "id"], "value", "top").collect()}
    numbers = {r.id: r.k for r in O.numbered(df, ["name"], ["ts", "id"], "k", parts).collect()}
    for series in by_series(data).values():
        top = None
        for k, (before, (_, i, v)) in enumerate(zip([None, *series], series)):
            top = v if top is None else max(top, v)
            assert got[i] == (before and before[2], top) and numbers[i] == k


def test_hold_shorter_and_longer(spark):
    data = [("a", 0, 9), ("a", 60, 9), ("a", 119, 1), ("a", 200, 9), ("a", 260, 9), ("a", 320, 9), ("a", 400, 0), ("b", 0, 9), ("b", 120, 9)]
    got = R.threshold_rule(samples(spark, data), ["name"], "ts", F.col("value") > 5, 120, ["id"])
    assert rows(got) == [("a", at(200), at(320), at(320), at(400)), ("b", at(0), at(120), at(120), None)]


def test_hold_against_a_walk(hot):
    data, df = hot
    want = []
    for n, series in by_series(data).items():
        start = fired = last = None
        for s, _, v in series:
            if v >= 2:
                start = s if start is None else start
                last = s
                if fired is None and s - start >= 30:
                    fired = s
            elif start is not None:
                if fired is not None:
                    want.append((n, at(start), at(fired), at(last), at(s)))
                start = fired = None
        if fired is not None:
            want.append((n, at(start), at(fired), at(last), None))
    got = R.threshold_rule(df, ["name"], "ts", F.col("value") >= 2, 30, ["id"])
    assert rows(got) == sorted(want, key=repr)


def test_silence(spark):
    df = samples(spark, [("a", 0, 1), ("a", 100, 1), ("b", 10, 1)])
    got = R.last_seen_rule(df, ["name"], "ts", F.lit(at(165)), 60, 60)
    assert rows(got.select("name", "is_silent", "is_firing")) == [("a", True, False), ("b", True, True)]


def test_changes_count_pairs_inside_the_window(spark):
    df = samples(spark, [("a", 0, 1), ("a", 30, 2), ("a", 70, 3), ("a", 80, 3)])
    got = R.changes_rule(df, ["name"], ["ts", "id"], "value", 120, 60, 1)
    assert rows(got.select("window_start", "n_changes", "is_firing")) == [(at(-60), 1, False), (at(0), 2, True), (at(60), 0, False)]


def test_counter_reset(spark):
    df = samples(spark, [("a", 0, 100), ("a", 20, 130), ("a", 40, 10), ("a", 50, 15)])
    got = R.counter_rate(df, ["name"], ["ts", "id"], "value", 60, 60)
    assert rows(got.select("increase", "rate")) == [(45.0, 0.75)]


@pytest.mark.parametrize("q,want", [(0.05, 0.05), (0.5, 0.3), (0.95, 1.0), (1.0, 1.0)])
def test_quantile_in_first_middle_and_open_bucket(spark, q, want):
    bounds = [0.1, 0.5, 1.0]
    cumulative = F.array(*[F.lit(n) for n in (10, 70, 80, 100)])
    got = spark.range(1).select(R.bucket_quantile(q, bounds, cumulative).alias("v")).first().v
    ranks = {0.05: 0.1 * 5 / 10, 0.5: 0.1 + 0.4 * 40 / 60}
    assert got == pytest.approx(ranks.get(q, want))
    table = spark.createDataFrame([("x", b, n) for b, n in zip([*bounds, float("inf")], (10, 70, 80, 100))], "k string, le double, n long")
    assert R.histogram_quantile(table, ["k"], "le", "n", q).first()["quantile"] == pytest.approx(got)


def test_quantile_without_observations(spark):
    none = F.array(*[F.lit(0)] * 4)
    assert spark.range(1).select(R.bucket_quantile(0.95, [0.1, 0.5, 1.0], none).alias("v")).first().v is None


def test_error_ratio_windows(spark):
    df = samples(spark, [("a", 10, 1), ("a", 70, 0), ("a", 80, 0)])
    got = R.error_ratio(df, "ts", F.col("value") == 1, 120, 60)
    assert rows(got.select("window_start", "n_errors", "n_requests")) == [(at(-60), 1, 1), (at(0), 1, 3), (at(60), 0, 2)]


def test_alert_notifications(spark):
    alerts = spark.createDataFrame(
        [("x", at(0), at(400)), ("x", at(20), at(50)), ("x", at(100), at(5 * 3600)), ("x", at(6 * 3600), at(6 * 3600 + 10))],
        "name string, fired_at timestamp_ntz, resolved_at timestamp_ntz")
    got = R.group_alerts(alerts, ["name"])
    first, second = at(0), at(6 * 3600)
    assert sorted(tuple(r) for r in got.collect()) == sorted([
        ("x", first, at(30), "firing", 2),
        ("x", first, at(330), "firing", 1),
        ("x", first, at(330 + 4 * 3600), "repeat", 0),
        ("x", first, at(30 + 60 * 300), "resolved", 0),
        ("x", second, at(6 * 3600 + 30), "firing", 1),
        ("x", second, at(6 * 3600 + 330), "resolved", 0),
    ])


def test_routes(spark):
    df = spark.createDataFrame([("critical",), ("warning",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(R.route_of(F.col("s"))).collect()] == [
        "critical-with-remediation", "email-default", "email-default", "email-default"]


PANE_ROWS = "ts timestamp_ntz, endpoint string, seconds double, size int"


def test_rollup_merges_panes_within_the_rank_error(spark):
    """Windows merged from panes: exact below k observations, within the error bound beyond it."""
    n, k = 60_000, 200
    raw = spark.range(n).select(
        F.timestamp_add("SECOND", (F.col("id") % 7200).cast("int"), F.lit("2026-09-01").cast("timestamp_ntz")).alias("ts"),
        F.lit("e").alias("endpoint"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("seconds"), F.lit(2).alias("size"))
    panes = R.endpoint_panes(raw, "ts", "endpoint", "seconds", "size", 300, k)
    assert panes.count() == 24
    got = R.endpoint_rollup(panes, 300, 7200).collect()
    assert len(got) == 1 and got[0].n_requests == n and got[0].mean_size == 2.0
    values = sorted(r.seconds for r in raw.collect())
    for name, q in R.PERCENTILES.items():
        rank = bisect.bisect_right(values, got[0][name]) / n
        assert abs(rank - q) < 2.3 / k ** 0.9
    exact = R.endpoint_rollup(R.endpoint_panes(raw.where("seconds < 50000"), "ts", "endpoint", "seconds", "size", 300), 300, 7200).first()
    few = [v for v in values if v < 50000]
    assert len(few) < R.KLL_K
    assert [exact[p] for p in R.PERCENTILES] == [few[-(-int(q * 100) * len(few) // 100) - 1] for q in R.PERCENTILES.values()]


def test_rollup_of_missing_values_and_gaps(spark):
    data = [(T0, "a", None, None), (T0, "a", float("nan"), 4), (T0, "b", 1.0, None), (T0 + timedelta(seconds=600), "b", 3.0, 8),
            (T0, None, 2.0, 1)]
    raw = spark.createDataFrame(data, PANE_ROWS)
    panes = R.endpoint_panes(raw, "ts", "endpoint", "seconds", "size", 60)
    got = {(r.endpoint, r.window_start): tuple(r)[2:] for r in R.endpoint_rollup(panes, 60, 1800).collect()}
    assert got == {
        ("a", T0): (2, 2 / 1800, None, None, None, 4.0), ("b", T0): (2, 2 / 1800, 1.0, 3.0, 3.0, 8.0),
        (None, T0): (1, 1 / 1800, 2.0, 2.0, 2.0, 1.0)}
    assert R.endpoint_rollup(panes, 60, 120, 300).count() == 4  # two minutes of each five
    assert R.endpoint_rollup(panes.limit(0), 60, 1800).count() == 0
    with pytest.raises(ValueError):
        R.endpoint_rollup(panes, 60, 90)
