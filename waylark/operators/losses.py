"""What a load lost, counted in the pass that loads: no second scan.

A stage that Spark repeats because its shuffle files were lost may count its rows again;
counts can then be too high, never too low.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REPORT = "step string, measure string, n long"
# Spark tells counts a moment after the action that found them; so many seconds are given for that.
TOLD_S = 3.0


class Watch:
    """Counts at named steps of one load. Pass it to the operators that lose rows, run the
    load, then ask for the report."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, list[str], Observation]] = []

    def over(self, df: DataFrame, step: str, **lost: Column) -> DataFrame:
        """df as it is; its rows and those that meet each condition are counted when it is read the first time."""
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self._steps.append((step, ["rows", *lost], seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in lost.items()])

    def counts(self) -> list[tuple[str, str, int | None]]:
        """(step, measure, n); n is null for a step that no action has run to its end."""
        out = []
        until = time.monotonic() + TOLD_S
        for step, names, seen in self._steps:
            while seen._jo is not None and not seen._jo.future().isCompleted() and time.monotonic() < until:
                time.sleep(0.01)
            found = seen.get if seen._jo is not None and seen._jo.future().isCompleted() else {}
            out += [(step, n, found.get(n)) for n in names]
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), REPORT)


def watched(df: DataFrame, watch: Watch | None, step: str, **lost: Column) -> DataFrame:
    """df, counted if there is a watch."""
    return df if watch is None else watch.over(df, step, **lost)


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped because they came behind the watermark, over the
    batches whose progress Spark still holds (`spark.sql.streaming.numRecentProgressUpdates`)."""
    batches = {p["batchId"]: p for p in query.recentProgress}
    return sum(int(o["numRowsDroppedByWatermark"]) for p in batches.values() for o in p["stateOperators"])
