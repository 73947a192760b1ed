"""Rules with hold times, silences, changes and counter rates in one streaming query each.

State behind a windowed aggregation, and timers that go off although nothing arrives,
come from `transformWithStateInPandas`. It keeps its state in RocksDB, which
`use_rocksdb` sets up for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waylark.operators.rules import ERROR_RATIO_LIMIT, HOLD_SECONDS, LATENCY_LIMIT_SECONDS, RESTARTS_LIMIT, SILENCE_SECONDS
from waylark.streaming.alerts import WATERMARK, error_ratio_stream, latency_quantile_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPISODE = ("started_at", "fired_at", "last_breach_at", "resolved_at")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and several state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _stamped(rows: list[tuple], keys: list[str], stamps: Iterable[str]) -> pd.DataFrame:
    """Rows of keys and clock values in microseconds as a frame with timestamps."""
    stamps = list(stamps)
    frame = pd.DataFrame(rows, columns=[*keys, *stamps])
    for c in stamps:
        frame[c] = pd.to_datetime(pd.array(frame[c], dtype="Int64"), unit="us")
    return frame


class _Hold(StatefulProcessor):
    """Walks the windows of a series in order; state: start of the breach, last breach, first time held, last window."""

    def __init__(self, keys: list[str], hold_us: int):
        self.keys, self.hold_us = keys, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breach", "started bigint, last_on bigint, fired bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, last_on, fired, seen = self.state.get() if self.state.exists() else (-1, -1, -1, -1)
        # A row for each window that closed: as many as the trigger's time has windows.
        windows = sorted((int(a), bool(o)) for chunk in rows for a, o in zip(chunk["at"], chunk["on"], strict=True))
        out = []
        for at, on in windows:
            if at <= seen:
                continue
            seen = at
            if on:
                started, last_on = (at if started < 0 else started), at
                if fired < 0 and at - started >= self.hold_us:
                    fired = at
                    out.append((*key, started, fired, at, None))
            elif started >= 0:
                if fired >= 0:
                    out.append((*key, started, fired, last_on, at))
                started = last_on = fired = -1
        self.state.update((started, last_on, fired, seen))
        yield _stamped(out, self.keys, EPISODE)


def held(windows: DataFrame, by: list[str], breach: Column, hold_seconds: int = HOLD_SECONDS) -> DataFrame:
    """by..., started_at, fired_at, last_breach_at, resolved_at: a row when a breach has held long enough,
    another when it ends.

    `windows` is a streaming aggregation by window with `window_end`, in append mode, so each
    window arrives once, when the watermark has passed it, and later windows in later batches.
    """
    use_rocksdb(windows.sparkSession)
    rows = windows.select(
        *by, F.unix_micros(F.col("window_end").cast("timestamp")).alias("at"), F.coalesce(breach, F.lit(False)).alias("on"))
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(c, T.TimestampType()) for c in EPISODE]])
    return rows.groupBy(*by).transformWithStateInPandas(
        _Hold(by, hold_seconds * 1_000_000), schema, "append", "none")


def error_ratio_alert_stream(df: DataFrame, ts: str, is_error: Column, by: list[str], limit: float = ERROR_RATIO_LIMIT,
                             window: str = "5 minutes", slide: str = "1 minute", hold: int = HOLD_SECONDS,
                             watermark: str = WATERMARK) -> DataFrame:
    """`rules.error_ratio_alert` as one query on a stream."""
    return held(error_ratio_stream(df, ts, is_error, window, slide, by, watermark), by, F.col("error_ratio") > limit, hold)


def latency_alert_stream(df: DataFrame, ts: str, seconds: str, bounds: list[float], by: list[str],
                         limit: float = LATENCY_LIMIT_SECONDS, q: float = 0.95, window: str = "5 minutes",
                         slide: str = "1 minute", hold: int = HOLD_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """`rules.latency_alert` as one query on a stream."""
    w = latency_quantile_stream(df, ts, seconds, bounds, q, window, slide, by, watermark)
    return held(w, by, F.col("quantile") > limit, hold)


def sample_alert_stream(df: DataFrame, series: list[str], ts: str, breach: Column, every: str = "1 minute",
                        hold: int = HOLD_SECONDS, watermark: str = WATERMARK) -> DataFrame:
    """A hold rule on samples, evaluated once an interval by its latest sample; one query.

    Samples are reduced per series and interval map-side, so a busy series is no hot key.
    """
    g = df.withWatermark(ts, watermark).groupBy(F.window(ts, every), *series).agg(
        F.max_by(F.coalesce(breach, F.lit(False)), ts).alias("_on"))
    return held(g.withColumn("window_end", F.col("window.end")), series, F.col("_on"), hold)


def latest_episodes(told: DataFrame, by: list[str]) -> DataFrame:
    """One row per episode from the rows that `held` wrote: as the batch rules give it, except that an open
    episode's last breach is that of its last row."""
    return told.groupBy(*by, "started_at").agg(
        F.min("fired_at").alias("fired_at"), F.max("last_breach_at").alias("last_breach_at"), F.max("resolved_at").alias("resolved_at"))


class _Silence(StatefulProcessor):
    """A timer on the clock for each series; state: its last sample, when it arrived, whether silence was told."""

    def __init__(self, keys: list[str], silence_ms: int):
        self.keys, self.silence_ms = keys, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last bigint, arrived bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, _, told = self.state.get() if self.state.exists() else (-1, -1, False)
        newest = max(int(chunk["at"].max()) for chunk in rows)
        now = timerValues.getCurrentProcessingTimeInMs()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.silence_ms)
        out = [(*key, "back", last, now * 1000)] if told else []
        self.state.update((max(last, newest), now, False))
        yield _stamped(out, [*self.keys, "kind"], ["last_seen", "noticed_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, arrived, told = self.state.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        if not told and now - arrived >= self.silence_ms:
            out.append((*key, "silent", last, now * 1000))
            self.state.update((last, arrived, True))
        yield _stamped(out, [*self.keys, "kind"], ["last_seen", "noticed_at"])


def silence_by_clock(df: DataFrame, series: list[str], ts: str, silence: int = SILENCE_SECONDS) -> DataFrame:
    """series..., kind, last_seen, noticed_at: 'silent' when nothing has arrived from a series for `silence`
    seconds of the clock, 'back' when it sends again.

    The timers go off with the trigger, data or no data, so a stream that stops as a whole
    is told as well; `alerts.silence_stream` judges by the samples' own time instead. Only the newest
    sample of a series in a partition is kept of a batch.
    """
    use_rocksdb(df.sparkSession)
    rows = df.select(*series, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    schema = T.StructType([
        *[rows.schema[c] for c in series], T.StructField("kind", T.StringType()),
        T.StructField("last_seen", T.TimestampType()), T.StructField("noticed_at", T.TimestampType())])
    return rows.groupBy(*series).transformWithStateInPandas(
        _Silence(series, silence * 1000), schema, "append", "processingTime")


Amounts = Callable[[np.ndarray, np.ndarray], np.ndarray]
_SAMPLES = np.dtype([("at", "<i8"), ("tie", "<i8"), ("value", "<f8")])
_PANES = np.dtype([("a", "<i8"), ("b", "<i8"), ("x", "<f8")])


def changes(before: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 where two neighbours differ; missing values (NaN) are equal."""
    return np.where((before == value) | (np.isnan(before) & np.isnan(value)), 0.0, 1.0)


def increases(before: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a counter grew by; after a reset its new value."""
    return np.where(value >= before, value - before, value)


class _Between(StatefulProcessor):
    """Puts a series in the order of its own time; state: samples that wait for the watermark, in pieces, the last one
    released, sums of pairs per (pane of the first, pane of the second) that open windows still need."""

    def __init__(self, keys: list[str], amounts: Amounts, window: int, slide: int):
        self.keys, self.amounts, self.per, self.pane_us = keys, amounts, window // slide, slide * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "samples binary")
        self.state = handle.getValueState("done", "last binary, panes binary, released bigint")

    def _done(self) -> tuple[np.ndarray, np.ndarray, int]:
        last, panes, released = self.state.get() if self.state.exists() else (b"", b"", -(1 << 62))
        return np.frombuffer(last, _SAMPLES), np.frombuffer(panes, _PANES), released

    def _wake(self, samples: list[np.ndarray], panes: np.ndarray, released: int) -> None:
        """A timer for the first window still to be told."""
        ends = [(int(s["at"].min()) // self.pane_us + 1) * self.pane_us for s in samples if len(s)]
        if len(panes):
            told = released // self.pane_us - self.per  # the last window that was complete
            first = np.maximum(panes["b"] - self.per + 1, told + 1)
            ends.append(int(first.min() + self.per) * self.pane_us)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ends:
            self.handle.registerTimer(min(ends) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, panes, released = self._done()
        there = [np.frombuffer(bytes(s), _SAMPLES) for (s,) in self.waiting.get()] if self.waiting.exists() else []
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = mark if mark > 0 else released  # before the first watermark it is 0
        for chunk in rows:
            new = np.empty(len(chunk), _SAMPLES)
            for c in _SAMPLES.names:
                new[c] = chunk[c].to_numpy()
            new = new[new["at"] >= passed]
            if len(new):
                self.waiting.appendValue((new.tobytes(),))
                there.append(new)
        self._wake(there, panes, released)
        yield _windows([], self.keys)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        last, panes, released = self._done()
        samples = np.concatenate([np.zeros(0, _SAMPLES), *(
            np.frombuffer(bytes(s), _SAMPLES) for (s,) in (self.waiting.get() if self.waiting.exists() else []))])
        samples = samples[np.lexsort((samples["tie"], samples["at"]))]
        ready = int(np.searchsorted(samples["at"], mark))
        later, ordered = samples[ready:], np.concatenate([last, samples[:ready]])
        if len(ordered) > 1:
            pairs = np.empty(len(ordered) - 1, _PANES)
            pairs["a"], pairs["b"] = ordered["at"][:-1] // self.pane_us, ordered["at"][1:] // self.pane_us
            pairs["x"] = self.amounts(ordered["value"][:-1], ordered["value"][1:])
            panes = _summed(np.concatenate([panes, pairs[pairs["b"] - pairs["a"] < self.per]]))
        told, upto = released // self.pane_us - self.per, mark // self.pane_us - self.per
        sums: dict[int, float] = {}
        for a, b, x in panes.tolist():
            for s in range(max(b - self.per + 1, told + 1), min(a, upto) + 1):
                sums[s] = sums.get(s, 0.0) + x
        panes = panes[panes["a"] > upto]
        self.waiting.clear()
        if len(later):
            self.waiting.appendValue((later.tobytes(),))
        self.state.update((ordered[-1:].tobytes(), panes.tobytes(), mark))
        self._wake([later], panes, mark)
        yield _windows([(*key, s * self.pane_us, (s + self.per) * self.pane_us, x) for s, x in sorted(sums.items())], self.keys)


def _summed(panes: np.ndarray) -> np.ndarray:
    """One row for each (a, b); missing amounts (NaN) add nothing."""
    places, which = np.unique(panes[["a", "b"]], return_inverse=True)
    out = np.empty(len(places), _PANES)
    out["a"], out["b"] = places["a"], places["b"]
    out["x"] = np.bincount(which.ravel(), np.nan_to_num(panes["x"]), len(places))
    return out


def _windows(rows: list[tuple], keys: list[str]) -> pd.DataFrame:
    frame = _stamped([r[:-1] for r in rows], keys, ["window_start", "window_end"])
    frame["amount"] = pd.array([r[-1] for r in rows], "float64")
    return frame


def between_samples(df: DataFrame, series: list[str], ts: str, value: str, amounts: Amounts, window: int, slide: int,
                    tie: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """series..., window_start, window_end, amount: per sliding window the sum of an amount of neighbouring samples.

    Samples may come in any order as long as the watermark has not passed them: they wait in
    state until it does, are then put in the order of ts and tie, and each pair counts for
    the windows that hold both. A window is told once, when the watermark has passed its end;
    samples behind the watermark are dropped. Held of a series are the samples between
    watermark and newest one and a window's pane sums. Samples without a time are left out.
    """
    use_rocksdb(df.sparkSession)
    rows = df.where(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        *series, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        (F.coalesce(F.col(tie).cast("bigint"), F.lit(-(1 << 63))) if tie else F.lit(0).cast("bigint")).alias("tie"),
        F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))
    schema = T.StructType([
        *[rows.schema[c] for c in series], T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()), T.StructField("amount", T.DoubleType())])
    return rows.groupBy(*series).transformWithStateInPandas(
        _Between(series, amounts, window, slide), schema, "append", "eventTime")


def changes_stream(df: DataFrame, series: list[str], ts: str, value: str, window: int = 900, slide: int = 60,
                   limit: int = RESTARTS_LIMIT, tie: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """`rules.changes_rule` on a stream whose samples come in any order; values are numbers."""
    w = between_samples(df, series, ts, value, changes, window, slide, tie, watermark)
    return w.select(*series, "window_start", "window_end", F.col("amount").cast("bigint").alias("n_changes"),
                    (F.col("amount") > limit).alias("is_firing"))


def counter_rate_stream(df: DataFrame, series: list[str], ts: str, value: str, window: int = 300, slide: int = 60,
                        tie: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """`rules.counter_rate` on a stream whose samples come in any order; an increase that is unknown counts as 0."""
    w = between_samples(df, series, ts, value, increases, window, slide, tie, watermark)
    return w.withColumnRenamed("amount", "increase").withColumn("rate", F.col("increase") / F.lit(float(window)))
