"""Service-metric rules in batch form.

Series can be very uneven (one endpoint may hold most requests), so nothing here
sorts a whole series in one task; see `ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.ordered import in_parts, sliding_windows, time_bucket, with_previous, with_running_max
from waylark.session import pinned

# Thresholds and timings of the rules (seconds, bytes, shares).
ERROR_RATIO_LIMIT = 0.05
LATENCY_LIMIT_SECONDS = 1.0
MEMORY_LIMIT_BYTES = 500_000_000
HOLD_SECONDS = 300
MEMORY_HOLD_SECONDS = 600
SILENCE_SECONDS = 60
RESTARTS_LIMIT = 3
GROUP_WAIT = 30
GROUP_INTERVAL = 300
REPEAT_INTERVAL = 4 * 3600
ROUTES = {"critical": "critical-with-remediation", "warning": "email-default"}
DEFAULT_ROUTE = "email-default"


def error_ratio(df: DataFrame, ts: str, is_error: Column, window: int = 300, slide: int = 60,
                by: list[str] | None = None) -> DataFrame:
    """Errors, requests and their ratio per sliding window."""
    w = sliding_windows(df, ts, window, slide, by or [], {
        "n_errors": F.when(is_error, 1).otherwise(0), "n_requests": F.lit(1),
    })
    return w.withColumn("error_ratio", F.try_divide(F.col("n_errors").cast("double"), F.col("n_requests")))


def bucket_quantile(q: float, bounds: list[float], cumulative: Column) -> Column:
    """Quantile from cumulative histogram counts, linear inside the bucket.

    `cumulative` is an array as long as `bounds` plus one for the open bucket,
    whose answer is the highest finite bound. No observations: null.
    """
    total = F.get(cumulative, F.lit(len(bounds)))
    rank = F.lit(q) * total
    out = None
    for i, upper in enumerate(bounds):
        have = F.get(cumulative, F.lit(i))
        before = F.get(cumulative, F.lit(i - 1)) if i else F.lit(0)
        lower = bounds[i - 1] if i else 0.0
        inside = F.lit(lower) + F.lit(upper - lower) * (rank - before) / (have - before)
        hit = (have >= rank) & (have > before)
        out = F.when(total == 0, F.lit(None).cast("double")).when(hit, inside) if out is None else out.when(hit, inside)
    return out.otherwise(F.when(total > 0, F.lit(float(bounds[-1]))))


def latency_quantile(df: DataFrame, ts: str, seconds: str, bounds: list[float], q: float = 0.95,
                     window: int = 300, slide: int = 60, by: list[str] | None = None) -> DataFrame:
    """Quantile per sliding window from histogram buckets over `bounds`."""
    sums = {f"le{i}": F.when(F.col(seconds) <= b, 1).otherwise(0) for i, b in enumerate(bounds)}
    w = sliding_windows(df, ts, window, slide, by or [], sums | {"n_requests": F.lit(1)})
    cumulative = F.array(*[F.col(c) for c in sums], F.col("n_requests"))
    return w.select(
        *(by or []), "window_start", "window_end", "n_requests",
        bucket_quantile(q, bounds, cumulative).alias("quantile"),
    )


def histogram_quantile(df: DataFrame, by: list[str], le: str, count: str, q: float) -> DataFrame:
    """Quantile from rows of cumulative bucket counts labelled by their bound.

    The open bucket has an infinite bound. Counts are summed per bound first, so
    the list per group is as long as there are distinct bounds.
    """
    per = df.groupBy(*by, F.col(le).cast("double").alias("_le")).agg(F.sum(count).cast("double").alias("_n"))
    g = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_le", "_n"))).alias("b"))
    rank = F.lit(q) * F.element_at("b", -1)["_n"]
    g = g.withColumn("_rank", rank)
    hit = F.get(F.filter("b", lambda x: x["_n"] >= F.col("_rank")), F.lit(0))
    below = F.filter("b", lambda x: x["_n"] < F.col("_rank"))
    last = F.get(below, F.size(below) - 1)
    lower = F.coalesce(last["_le"], F.lit(0.0))
    seen = F.coalesce(last["_n"], F.lit(0.0))
    inside = lower + (hit["_le"] - lower) * F.try_divide(F.col("_rank") - seen, hit["_n"] - seen)
    open_ended = hit["_le"] == F.lit(float("inf"))
    value = F.when(F.col("_rank") > 0, F.when(open_ended, lower).otherwise(inside))
    return g.select(*by, value.alias("quantile"))


def threshold_rule(df: DataFrame, series: list[str], ts: str, breach: Column, hold: int,
                   tie: list[str] | None = None) -> DataFrame:
    """Episodes in which `breach` held for at least `hold` seconds.

    (series, started_at, fired_at, last_breach_at, resolved_at); `resolved_at` is
    the first sample without breach, null while the episode is open.
    """
    order = [ts, *(tie or [])]
    # The helpers read their input twice, so each gets a stored one: the source is read once.
    once = pinned(df.select(*series, *order, F.coalesce(breach, F.lit(False)).alias("_on")), "samples")
    rows = in_parts(once, [*series, *order], "series")
    p = with_previous(rows, series, order, ["_on"])
    starts = F.col("_on") & ~F.coalesce("prev__on", F.lit(False))
    marked = pinned(p.withColumn("_start", F.when(starts, F.col(ts))).drop("prev__on"), "starts")
    run = with_running_max(marked, series, order, "_start", "started_at")
    held = S.seconds_between("started_at", ts) >= hold
    return (
        run.filter(F.col("started_at").isNotNull())
        .groupBy(*series, "started_at")
        .agg(
            F.min(F.when(F.col("_on") & held, F.col(ts))).alias("fired_at"),
            F.max(F.when(F.col("_on"), F.col(ts))).alias("last_breach_at"),
            F.min(F.when(~F.col("_on"), F.col(ts))).alias("resolved_at"),
        )
        .filter(F.col("fired_at").isNotNull())
    )


def error_ratio_alert(df: DataFrame, ts: str, is_error: Column, by: list[str], limit: float = ERROR_RATIO_LIMIT,
                      window: int = 300, slide: int = 60, hold: int = HOLD_SECONDS) -> DataFrame:
    """Episodes in which more than `limit` of the requests of a window failed, long enough."""
    w = error_ratio(df, ts, is_error, window, slide, by)
    return threshold_rule(w, by, "window_end", F.col("error_ratio") > limit, hold)


def latency_alert(df: DataFrame, ts: str, seconds: str, bounds: list[float], by: list[str],
                  limit: float = LATENCY_LIMIT_SECONDS, q: float = 0.95, window: int = 300, slide: int = 60,
                  hold: int = HOLD_SECONDS) -> DataFrame:
    """Episodes in which a latency quantile of the window stayed over `limit` long enough."""
    w = latency_quantile(df, ts, seconds, bounds, q, window, slide, by)
    return threshold_rule(w, by, "window_end", F.col("quantile") > limit, hold)


def memory_alert(df: DataFrame, series: list[str], ts: str, size: str, limit: float = MEMORY_LIMIT_BYTES,
                 hold: int = MEMORY_HOLD_SECONDS, tie: list[str] | None = None) -> DataFrame:
    """Episodes in which a series used more than `limit` bytes long enough."""
    return threshold_rule(df, series, ts, F.col(size) > limit, hold, tie)


def last_seen_rule(df: DataFrame, series: list[str], ts: str, now: Column,
                   silence: int = SILENCE_SECONDS, hold: int = 60) -> DataFrame:
    """Last sample per series and whether its silence has lasted long enough."""
    g = df.groupBy(*series).agg(F.max(ts).alias("last_seen"))
    quiet = S.seconds_between("last_seen", now)
    return g.select(
        *series, "last_seen", quiet.alias("silent_seconds"),
        (quiet > silence).alias("is_silent"), (quiet > silence + hold).alias("is_firing"),
    )


def _between_samples(df: DataFrame, series: list[str], order: list[str], value: str, amount: Column,
                     window: int, slide: int, name: str) -> DataFrame:
    """Sum per sliding window of an amount that belongs to a pair of neighbours.

    A pair counts for the windows that contain both samples. Pairs are summed per
    (pane of the first, pane of the second) before they are spread over windows.
    """
    per_window = window // slide
    ts = order[0]
    take = pinned(df.select(*series, *order, value, F.col(ts).alias("_at")), "samples")
    p = with_previous(take, series, order, [value, "_at"])
    pairs = p.filter(F.col("prev__at").isNotNull()).select(
        *series, time_bucket("prev__at", slide).alias("_a"), time_bucket("_at", slide).alias("_b"),
        amount.alias("_x"),
    ).filter((F.col("_b") - F.col("_a")) < per_window)
    panes = pairs.groupBy(*series, "_a", "_b").agg(F.sum("_x").alias("_x"))
    spread = panes.select(
        *series, "_x", F.explode(F.sequence(F.col("_b") - (per_window - 1), F.col("_a"))).alias("_s")
    )
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    begin = F.timestamp_add("SECOND", F.col("_s") * slide, origin)
    return spread.groupBy(*series, "_s").agg(F.sum("_x").alias(name)).select(
        *series, begin.alias("window_start"),
        F.timestamp_add("SECOND", F.lit(window), begin).alias("window_end"), name,
    )


def changes_rule(df: DataFrame, series: list[str], order: list[str], value: str, window: int = 900,
                 slide: int = 60, limit: int = RESTARTS_LIMIT) -> DataFrame:
    """Value changes per sliding window, and whether they exceed the limit."""
    changed = F.when(F.col(value).eqNullSafe(F.col(f"prev_{value}")), 0).otherwise(1)
    w = _between_samples(df, series, order, value, changed, window, slide, "n_changes")
    return w.withColumn("is_firing", F.col("n_changes") > limit)


def counter_rate(df: DataFrame, series: list[str], order: list[str], value: str, window: int = 300,
                 slide: int = 60) -> DataFrame:
    """Increase per second of a counter; after a reset the new value is the increase."""
    prev = F.col(f"prev_{value}")
    step = F.when(F.col(value) >= prev, F.col(value) - prev).otherwise(F.col(value))
    w = _between_samples(df, series, order, value, step, window, slide, "increase")
    return w.withColumn("rate", F.col("increase") / F.lit(float(window)))


def endpoint_stats(df: DataFrame, ts: str, endpoint: str, seconds: str, size: str, window: int,
                   accuracy: int = 10_000) -> DataFrame:
    """Requests per second, latency percentiles and mean size per endpoint and window.

    Percentiles come from a mergeable sketch with a stated accuracy: groups of up
    to that many values are exact.
    """
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    g = df.groupBy(F.col(endpoint).alias("endpoint"), time_bucket(ts, window).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.percentile_approx(seconds, [0.5, 0.95, 0.99], accuracy).alias("_p"),
        F.avg(size).alias("mean_size"),
    )
    return g.select(
        "endpoint", F.timestamp_add("SECOND", F.col("_w") * window, origin).alias("window_start"),
        "n_requests", (F.col("n_requests") / F.lit(float(window))).alias("requests_per_second"),
        *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))],
        "mean_size",
    )


# Values that a sketch of latencies keeps exactly; beyond that its rank error is about 2.3 / KLL_K ** 0.9.
KLL_K = 4096
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def pane_columns(seconds: str, size: str, k: int = KLL_K) -> list[Column]:
    """Aggregates of a pane: requests, sizes, and a mergeable KLL sketch of the latencies. Null and NaN
    latencies are no observations."""
    seen = F.col(seconds).cast("double")
    return [
        F.count(F.lit(1)).alias("n_requests"), F.sum(F.col(size).cast("double")).alias("total_size"), F.count(size).alias("n_sizes"),
        F.kll_sketch_agg_double(F.when(~F.isnan(seen), seen), k).alias("sketch")]


def endpoint_panes(df: DataFrame, ts: str, endpoint: str, seconds: str, size: str, pane: int = 60,
                   k: int = KLL_K) -> DataFrame:
    """endpoint, pane (seconds since 1970 by the pane's length), n_requests, total_size, n_sizes, sketch.

    The raw rows are read once, for this; store it. `endpoint_rollup` answers any window from it.
    A pane's row has a bounded size, and is aggregated before the shuffle.
    """
    return df.groupBy(F.col(endpoint).alias("endpoint"), time_bucket(ts, pane).alias("pane")).agg(*pane_columns(seconds, size, k))


def endpoint_rollup(panes: DataFrame, pane: int, window: int, slide: int | None = None) -> DataFrame:
    """Requests per second, latency percentiles and mean size per endpoint and window, by merging panes.

    Window and slide are multiples of the pane. Percentiles are the smallest value whose share
    reaches them; exact as long as a window has at most k observations, else within the
    sketch's rank error. Without observations they are null.
    """
    slide = slide or window
    if window % pane or slide % pane:
        raise ValueError("window and slide must be multiples of the pane")
    step, length = slide // pane, window // pane
    last = F.floor(F.col("pane") / step).cast("bigint")
    first = F.floor((F.col("pane") - length) / step).cast("bigint") + 1
    spread = panes.withColumn("_s", F.explode(F.sequence(first, last)) if step < length else last)
    if step > length:  # windows with gaps between them
        spread = spread.where(F.col("pane") - F.col("_s") * step < length)
    g = spread.groupBy("endpoint", "_s").agg(
        F.sum("n_requests").alias("n_requests"), F.sum("total_size").alias("_t"), F.sum("n_sizes").alias("_n"),
        F.kll_merge_agg_double("sketch").alias("_k"))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seen = F.kll_sketch_get_n_double("_k") > 0
    return g.select(
        "endpoint", F.timestamp_add("SECOND", F.col("_s") * slide, origin).alias("window_start"), "n_requests",
        (F.col("n_requests") / F.lit(float(window))).alias("requests_per_second"),
        *[F.when(seen, F.kll_sketch_get_quantile_double("_k", F.lit(q))).alias(n) for n, q in PERCENTILES.items()],
        F.try_divide("_t", "_n").alias("mean_size"))


# --- notifications -----------------------------------------------------------------

def route_of(severity: Column) -> Column:
    table = F.create_map(*[F.lit(v) for p in ROUTES.items() for v in p])
    return F.coalesce(F.try_element_at(table, severity), F.lit(DEFAULT_ROUTE))


def group_alerts(alerts: DataFrame, by: list[str], start: str = "fired_at", end: str = "resolved_at",
                 tie: list[str] | None = None, wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL,
                 repeat: int = REPEAT_INTERVAL) -> DataFrame:
    """Notifications of alert groups.

    Alerts of a group that overlap in time form one episode. Its first notice goes
    out `wait` seconds after the first alert, further ones on ticks of `interval`
    when new alerts came in, a reminder every `repeat` seconds without news, and
    a resolved notice on the first tick after the last alert ended.
    (by..., episode_start, notified_at, kind, n_alerts)
    """
    order = [start, *(tie or [])]
    rows = in_parts(pinned(alerts.select(*by, *order, end), "alerts"), [*by, *order], "series")
    seen = with_running_max(rows, by, order, end, "_open_until", False)
    opens = F.col("_open_until").isNull() | (F.col(start) > F.col("_open_until"))
    marked = pinned(seen.withColumn("_start", F.when(opens, F.col(start))).drop("_open_until"), "openings")
    ep = with_running_max(marked, by, order, "_start", "episode_start")
    episode = [*by, "episode_start"]

    def tick(at: Column) -> Column:
        late = (S.seconds_between("episode_start", at) - wait) / interval
        return F.greatest(F.lit(0), F.ceil(late)).cast("long")

    # Ticks with news: already reduced to one row per tick of the episode.
    news = pinned(ep.groupBy(*episode, tick(F.col(start)).alias("_tick")).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.max(end).alias("_end")
    ), "alert-ticks")
    ends = news.groupBy(*episode).agg(F.max("_end").alias("_end"))
    closing = ends.select(*episode, F.greatest(tick(F.col("_end")), F.lit(1)).alias("_tick"),
                          F.lit("resolved").alias("kind"), F.lit(0).cast("long").alias("n_alerts"))
    told = news.select(*episode, "_tick", F.lit("firing").alias("kind"), "n_alerts").unionByName(closing)

    # Reminders fill gaps between one notice and the next.
    at = lambda t: F.timestamp_add(
        "SECOND", F.lit(wait) + t * interval, F.col("episode_start"))
    timed = told.withColumn("_at", at(F.col("_tick"))).withColumn(
        "_rank", F.when(F.col("kind") == "firing", 0).otherwise(1))
    p = with_previous(timed, episode, ["_at", "_rank"], ["_tick"])
    steps = -(-repeat // interval)
    gap = F.col("_tick") - F.col("prev__tick")
    n_repeat = F.floor((gap - 1) / steps)
    repeats = p.filter(n_repeat >= 1).select(
        *episode,
        F.explode(F.transform(F.sequence(F.lit(1), n_repeat.cast("int")),
                              lambda k: F.col("prev__tick") + k * steps)).alias("_tick"),
        F.lit("repeat").alias("kind"), F.lit(0).cast("long").alias("n_alerts"),
    )
    out = told.unionByName(repeats)
    return out.select(*episode, at(F.col("_tick")).alias("notified_at"), "kind", "n_alerts")
