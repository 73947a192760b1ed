"""Metric rules on streams.

Windowed rules are plain watermarked aggregations; late rows beyond the watermark
are dropped and show in the query progress. Rules with a hold time keep one small
state per series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waylark.operators.rules import (
    GROUP_INTERVAL, GROUP_WAIT, KLL_K, REPEAT_INTERVAL, SILENCE_SECONDS, bucket_quantile, pane_columns,
)

WATERMARK = "10 minutes"
SECOND = 1_000_000


def _bounds(df: DataFrame, by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*by, "window")]
    return df.select(
        *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def error_ratio_stream(df: DataFrame, ts: str, is_error: Column, window: str = "5 minutes",
                       slide: str = "1 minute", by: list[str] | None = None, watermark: str = WATERMARK) -> DataFrame:
    g = df.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), *(by or [])).agg(
        F.sum(F.when(is_error, 1).otherwise(0)).alias("n_errors"), F.count(F.lit(1)).alias("n_requests")
    )
    ratio = F.try_divide(F.col("n_errors").cast("double"), F.col("n_requests"))
    return _bounds(g.withColumn("error_ratio", ratio), by or [])


def latency_quantile_stream(df: DataFrame, ts: str, seconds: str, bounds: list[float], q: float = 0.95,
                            window: str = "5 minutes", slide: str = "1 minute", by: list[str] | None = None,
                            watermark: str = WATERMARK) -> DataFrame:
    """One stateful aggregation: the bucket counts of a window are its columns."""
    n = len(bounds)
    g = df.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), *(by or [])).agg(
        *[F.sum(F.when(F.col(seconds) <= b, 1).otherwise(0)).alias(f"le{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("n_requests"),
    )
    cumulative = F.array(*[F.col(f"le{i}") for i in range(n)], F.col("n_requests"))
    valued = g.withColumn("quantile", bucket_quantile(q, bounds, cumulative))
    return _bounds(valued.drop(*[f"le{i}" for i in range(n)]), by or [])


# --- hold times ------------------------------------------------------------------

HOLD_OUTPUT = "name string, started_at timestamp, fired_at timestamp, resolved_at timestamp"
HOLD_STATE = "started bigint, last bigint, fired bigint"


def _hold_step(hold_us: int):
    """Advance one series through its samples, oldest first."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, fired = state.get if state.exists else (-1, -1, -1)
        out = []
        # One row per evaluation interval: few, however busy the series is.
        steps = pd.concat(list(chunks)).sort_values("at")
        for at, on in steps.loc[steps["at"] > last, ["at", "on"]].itertuples(index=False):
            last = at
            if on and started < 0:
                started = at
            if on and fired < 0 and at - started >= hold_us:
                fired = at
                out.append((key[0], started, fired, None))
            if not on:
                if fired >= 0:
                    out.append((key[0], started, fired, at))
                started, fired = -1, -1
        state.update((int(started), int(last), int(fired)))
        stamps = ["started_at", "fired_at", "resolved_at"]
        frame = pd.DataFrame(out, columns=["name", *stamps])
        for c in stamps:
            frame[c] = pd.to_datetime(pd.array(frame[c], dtype="Int64"), unit="us")
        yield frame

    return step


def evaluations(df: DataFrame, name: str, ts: str, breach: Column, every: str, watermark: str = WATERMARK) -> DataFrame:
    """Per series and evaluation interval: whether its latest sample breaches.

    The aggregation combines map-side, so a series with a large share of the
    samples reaches the stateful step as one row per interval. Spark allows no
    custom state behind a streaming aggregation, so this is a query of its own:
    write it to a table and let `hold_stream` read that table as a stream.
    """
    g = df.withWatermark(ts, watermark).groupBy(F.window(ts, every), F.col(name).cast("string").alias("name")).agg(
        F.max_by(F.coalesce(breach, F.lit(False)), ts).alias("on")
    )
    return g.select("name", "on", F.unix_micros(F.col("window.end").cast("timestamp")).alias("at"))


def hold_stream(evaluated: DataFrame, hold_seconds: int) -> DataFrame:
    """A row when a breach has held for `hold_seconds`, another when it ends.

    `evaluated` is a stream of (name, at, on) as `evaluations` writes it. Rows that
    are older than the last one seen of their series are left out.
    """
    return evaluated.groupBy("name").applyInPandasWithState(
        _hold_step(hold_seconds * 1_000_000), HOLD_OUTPUT, HOLD_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- silence -----------------------------------------------------------------------

SILENCE_OUTPUT = "name string, last_seen timestamp, noticed_at timestamp, kind string"
SILENCE_STATE = "last bigint, told bigint"


def _joined(spans: list[tuple[int, int]], at: np.ndarray, quiet_us: int) -> list[tuple[int, int]]:
    """Spans (first, last) of samples that are no further apart, with more samples, sorted."""
    if not len(at):
        return spans
    cuts = np.flatnonzero(np.diff(at) > quiet_us)
    more = zip(at[[0, *(cuts + 1)]].tolist(), at[[*cuts, len(at) - 1]].tolist(), strict=True)
    out: list[tuple[int, int]] = []
    for low, high in sorted([*spans, *more]):
        if out and low <= out[-1][1] + quiet_us:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _silence_step(quiet_us: int):
    """Watch one series: told once when it has been quiet, and once when it is back."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (-1, 0)
        out = []
        if state.hasTimedOut:
            if not told:
                out.append((last, last + quiet_us, "silent"))
            state.update((int(last), 1))
        else:
            spans: list[tuple[int, int]] = []
            for chunk in chunks:  # what is kept of a batch are its spans without silence
                at = np.sort(chunk["at"].to_numpy("int64"))
                spans = _joined(spans, at[at > last] if last >= 0 else at, quiet_us)
            for low, high in spans:
                if last >= 0 and low > last + quiet_us and not told:
                    out.append((last, last + quiet_us, "silent"))
                    told = 1
                if told:
                    out.append((last, low, "back"))
                    told = 0
                last = high
            state.update((int(last), int(told)))
            state.setTimeoutTimestamp(max((last + quiet_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["last_seen", "noticed_at", "kind"])
        for c in ("last_seen", "noticed_at"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="us")
        frame.insert(0, "name", str(key[0]))
        yield frame

    return step


def silence_stream(samples: DataFrame, name: str, ts: str, silence: int = SILENCE_SECONDS, hold: int = SILENCE_SECONDS,
                   watermark: str = WATERMARK) -> DataFrame:
    """A row when a series has sent nothing for `silence` + `hold` seconds, another when it is back.

    A timer of the event time: it fires when the watermark has passed the last sample by
    that much. Gaps within one batch of a series are told as well.
    """
    shaped = samples.withWatermark(ts, watermark).select(
        ts, F.col(name).cast("string").alias("name"), F.unix_micros(F.col(ts)).alias("at"))
    return shaped.groupBy("name").applyInPandasWithState(
        _silence_step((silence + hold) * SECOND), SILENCE_OUTPUT, SILENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


# --- notifications -----------------------------------------------------------------

NOTICE_OUTPUT = "name string, service string, episode_start timestamp, notified_at timestamp, kind string, n_alerts bigint"
NOTICE_STATE = "start bigint, active bigint, pending bigint, due bigint, last bigint"


def _notice_step(wait: int, interval: int, repeat: int):
    """Advance one alert group through its events, oldest first; times in microseconds."""
    reminder = -(-repeat // interval) * interval * SECOND

    def tick_at(start: int, at: int) -> int:
        late = -(-(at - start - wait * SECOND) // (interval * SECOND))
        return start + wait * SECOND + max(0, late) * interval * SECOND

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, active, pending, due, last = state.get if state.exists else (-1, 0, 0, -1, -1)
        out = []

        def tell(upto: int) -> None:
            """Notices of the open episode that fall due up to a time."""
            nonlocal pending, due, last
            while start >= 0:
                again = last + reminder if last >= 0 else None
                if pending and due <= upto and (again is None or due <= again):
                    out.append((start, due, "firing", pending))
                    last, pending = due, 0
                elif again is not None and again <= upto and (not pending or again < due):
                    out.append((start, again, "repeat", 0))
                    last = again
                else:
                    return

        # A group is one alert name of one service: few events per batch.
        events = pd.concat(list(chunks), ignore_index=True) if not state.hasTimedOut else None
        if events is not None:
            events = events.assign(_r=(events["kind"] != "firing").astype(int)).sort_values(["at", "_r"])
            for at, kind in events[["at", "kind"]].itertuples(index=False):
                tell(at - 1)
                if kind == "firing":
                    if start < 0:
                        start, active, last = at, 0, -1
                    active += 1
                    here = tick_at(start, at)
                    if pending and here != due:
                        tell(due)
                    pending, due = pending + 1, here
                elif active:
                    active -= 1
                    if not active:
                        end = max(tick_at(start, at), start + (wait + interval) * SECOND)
                        tell(end if pending and due == end else end - 1)
                        out.append((start, end, "resolved", 0))
                        start, pending, due, last = -1, 0, -1, -1
        else:
            tell(state.getCurrentWatermarkMs() * 1000)
        state.update(tuple(int(v) for v in (start, active, pending, due, last)))
        if start >= 0:
            following = due if pending else last + reminder
            state.setTimeoutTimestamp(max(following // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["episode_start", "notified_at", "kind", "n_alerts"])
        for c in ("episode_start", "notified_at"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="us")
        frame.insert(0, "service", str(key[1]))
        frame.insert(0, "name", str(key[0]))
        yield frame

    return step


def group_stream(events: DataFrame, ts: str, wait: int = GROUP_WAIT, interval: int = GROUP_INTERVAL,
                 repeat: int = REPEAT_INTERVAL, watermark: str = WATERMARK) -> DataFrame:
    """Grouped notifications of a stream of alert events, as `group_alerts` gives them.

    `events` has name, service, kind (`firing` or `resolved`) and the event time.
    A notice is emitted when a later event of the group or the watermark has passed
    its time; `notified_at` is the time it stands for.
    """
    shaped = events.withWatermark(ts, watermark).select(
        ts, F.col("name").cast("string").alias("name"), F.col("service").cast("string").alias("service"),
        "kind", F.unix_micros(F.col(ts)).alias("at"),
    )
    return shaped.groupBy("name", "service").applyInPandasWithState(
        _notice_step(wait, interval, repeat), NOTICE_OUTPUT, NOTICE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def endpoint_panes_stream(df: DataFrame, ts: str, endpoint: str, seconds: str, size: str, pane: int = 60,
                          k: int = KLL_K, watermark: str = WATERMARK) -> DataFrame:
    """`rules.endpoint_panes` on a stream: a row for each pane once the watermark has passed it.

    Appended to a table, it answers any window by `rules.endpoint_rollup`, whatever has come in since.
    """
    g = df.withWatermark(ts, watermark).groupBy(F.window(ts, f"{pane} seconds"), F.col(endpoint).alias("endpoint")).agg(
        *pane_columns(seconds, size, k))
    start = F.unix_seconds(F.col("window.start").cast("timestamp"))
    return g.select("endpoint", F.floor(start / pane).cast("bigint").alias("pane"), "n_requests", "total_size", "n_sizes", "sketch")
