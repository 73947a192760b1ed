"""Order-dependent computations that stay spread over the cluster.

A window without a partition, or one partitioned by a key that holds a large
share of the rows, sends those rows to one task. The helpers here deal the rows out
by ranges of the whole order, work inside the ranges, and carry a small summary for
each (group, range) across. Spark's range partitioning finds the ranges by sampling;
they are stored with the rows, so every branch and every retried task sees the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waylark.functions.scalars import epoch_micros, nan_to_null, to_number
from waylark.session import pinned


# The column with the number of a row's range.
PART = "_part"


def parts_for(rows: int) -> int:
    """Into how many ranges an order of so many rows is cut.

    Both the ranges and the rows in one grow with the root of the rows, so neither the
    summaries nor the work on one range becomes the bottleneck: 4 for ten thousand rows,
    32 for a million, 32 000 for a million millions.
    """
    return max(1, math.ceil(math.sqrt(rows) / 32))


def in_parts(df: DataFrame, order: list[str], label: str, parts: int | None = None) -> DataFrame:
    """df dealt out by ascending ranges of `order`, with the range's number in `_part`, stored.

    Rows that are equal in all of `order` share a range, so it should end with what tells
    rows apart. `df` is read three times (count, sample, rows) and should be a stored table.
    """
    parts = parts or parts_for(df.count())
    return pinned(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), label)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df, a stored table, with the number of each row in its group, from 0, in order.

    However many rows a group has, they are sorted range by range.
    """
    placed = in_parts(df, [*group, *order], "numbered", parts)
    cell = [*group, PART]
    before = W.partitionBy(*group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).select(
        *[F.col(g).alias(f"_of_{g}") for g in cell], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = placed.withColumn("_own", F.row_number().over(W.partitionBy(*cell).orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in cell]
    return local.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_own") - 1).alias(name))


# --- values: running totals over sorted values --------------------------------

def running_totals(
    counted: DataFrame, group: str, value: str, sums: list[str],
    descending: bool = False, parts: int | None = None,
) -> DataFrame:
    """Add `cum_<s>` (inclusive) and `tot_<s>` per group in order of `value`.

    `counted` holds each (group, value) once, for example counts per distinct
    value; null and NaN values have no place in the order and are left out. It is
    written to the shared folder first: the ranges, their totals and the rows
    themselves all come from that one computation.
    """
    once = pinned(counted.filter(nan_to_null(value).isNotNull()).select(group, value, *sums), "counted")
    placed = in_parts(once, [group, value], "ranges", parts)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per_part = placed.groupBy(group, PART).agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    before = W.partitionBy(group).orderBy(direction(PART)).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        group, PART,
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(W.partitionBy(group)).alias(f"tot_{s}") for s in sums],
    )
    inside = W.partitionBy(group, PART).orderBy(direction(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select("*", *[F.sum(s).over(inside).alias(f"_loc_{s}") for s in sums])
    return local.join(offsets, [group, PART]).select(
        group, value, *sums,
        *[(F.col(f"_loc_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"tot_{s}" for s in sums],
    )


def unpivot(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) rows for the columns as numbers.

    Nulls, NaN and texts that are no number are left out.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), to_number(c).alias("value")) for c in cols])
    return df.select(*(keep or []), F.inline(pairs)).filter(F.col("value").isNotNull())


# The quantiles that bracket a median, and the accuracy of the sketch: its rank error is a
# tenth of what lies between, so the median is inside.
BRACKET = (0.499, 0.501)
SKETCH_ACCURACY = 10_000


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median) for several columns at once; columns without a number have no row.

    Exact, like a sort in memory would give. A first pass brackets each median by
    approximate quantiles (two numbers per column come to the driver). A second pass
    counts what lies below and orders only the values inside the bracket, some
    thousandths of the rows. So `df` is read twice and should be a stored table.
    """
    numbers = df.select(*[to_number(c).alias(c) for c in cols])
    row = numbers.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(c, list(BRACKET), SKETCH_ACCURACY).alias(f"q{i}") for i, c in enumerate(cols)],
    ).first()
    found = [(c, row[f"n{i}"], *row[f"q{i}"]) for i, c in enumerate(cols) if row[f"n{i}"]]
    totals = df.sparkSession.createDataFrame([(c, n) for c, n, *_ in found], "feature string, n_all bigint")
    if not found:
        return totals.select("feature", F.lit(None).cast("double").alias("median"))
    # Values below the bracket lose their value, so each task sends one row for them.
    parts = F.array(*[
        F.when(F.col(c) <= high, F.struct(
            F.lit(c).alias("feature"), F.when(F.col(c) >= low, F.col(c)).alias("value")))
        for c, _, low, high in found
    ])
    counted = pinned(
        numbers.select(F.inline(F.filter(parts, lambda p: p.isNotNull())))
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "bracket")
    below = counted.filter("value IS NULL").select("feature", F.col("n").alias("n_below"))
    run = running_totals(counted, "feature", "value", ["n"])
    # One row per column on the right.
    placed = run.join(F.broadcast(totals), "feature").join(F.broadcast(below), "feature", "left")
    start = F.coalesce("n_below", F.lit(0)) + F.col("cum_n") - F.col("n")
    hit = lambda rank: F.max(F.when((start <= rank) & (rank < start + F.col("n")), F.col("value")))
    low, high = F.floor((F.col("n_all") - 1) / 2), F.floor(F.col("n_all") / 2)
    return placed.groupBy("feature").agg(((hit(low) + hit(high)) / 2).alias("median"))


# --- time series: previous row and running maximum ------------------------------

def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000))


def _placed(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """df with the ranges of (series, order) that it has, or with new ones."""
    return df if PART in df.columns else in_parts(df, [*series, *order], "series")


def with_previous(df: DataFrame, series: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Add `prev_<c>` for each taken column: its value in the row before.

    `order[0]` is the timestamp, the rest breaks ties. Rows are sorted within
    (series, range); the last row of each range is handed to the next range
    of the series, so even one dominant series is worked on by many tasks.
    """
    b = _placed(df, series, order)
    cell = [*series, PART]
    row = F.struct(*take)
    local = b.withColumn("_prev", F.lag(row).over(W.partitionBy(*cell).orderBy(*order)))
    tails = b.groupBy(*cell).agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    carry = tails.select(*cell, F.lag("_tail").over(W.partitionBy(*series).orderBy(PART)).alias("_carry"))
    joined = local.join(carry, cell, "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(
        *df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in take]
    )


def with_running_max(
    df: DataFrame, series: list[str], order: list[str], value: str, name: str, inclusive: bool = True
) -> DataFrame:
    """Add the maximum of `value` over the series up to (and with) each row."""
    b = _placed(df, series, order)
    cell = [*series, PART]
    last = W.currentRow if inclusive else -1
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    local = b.withColumn("_run", F.max(value).over(inside))
    tops = b.groupBy(*cell).agg(F.max(value).alias("_top"))
    across = W.partitionBy(*series).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carry = tops.select(*cell, F.max("_top").over(across).alias("_carry"))
    joined = local.join(carry, cell, "left")
    return joined.select(*df.columns, F.greatest("_run", "_carry").alias(name))


def sliding_windows(
    df: DataFrame, ts: str, window_seconds: int, slide_seconds: int, by: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Sums over sliding windows aligned to the epoch, from non-overlapping panes.

    Rows are first summed per pane of one slide (map-side combined); only the
    pane totals are then repeated for the windows they belong to.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window must be a whole number of slides")
    per_window = window_seconds // slide_seconds
    panes = df.groupBy(*by, time_bucket(ts, slide_seconds).alias("_pane")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    spread = panes.withColumn(
        "_start", F.explode(F.sequence(F.col("_pane") - (per_window - 1), F.col("_pane")))
    )
    total = spread.groupBy(*by, "_start").agg(*[F.sum(n).alias(n) for n in sums])
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    begin = F.timestamp_add("SECOND", F.col("_start") * slide_seconds, origin)
    return total.select(
        *by,
        begin.alias("window_start"),
        F.timestamp_add("SECOND", F.lit(window_seconds), begin).alias("window_end"),
        *sums,
    )
