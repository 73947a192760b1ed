"""Rows in a global order, with the rows before and after each, without one task for all.

The order is cut into ranges, some for each partition. A first pass over the keys alone
finds the first and the last key of every range. The rows are then dealt out by range,
and those at the ends of a range go to the range beside it as well, marked as edges. A
task reads its ranges in order and so sees each row between its neighbours. Where copies
are no neighbours, the nearest row of another content goes there too, from however far.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from waylark.llm.common import partitions, stored, unused

# Ranges for each partition, so that hashing deals them out evenly.
RANGES = 4


def _sortable(key: Iterable) -> tuple:
    """A key that Python orders as Spark does: null first."""
    return tuple((v is not None, v) for v in key)


def _ends(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterable[pa.RecordBatch]:
    """The first row of a range, the last one, and those nearest to them of another content."""
    found: list[dict | None] = [None] * 4
    for batch in batches:
        for row in batch.to_pylist():
            first, last = found[:2]
            if first is None:
                found[0] = row
            elif found[2] is None and row["content"] != first["content"]:
                found[2] = row
            if last is not None and row["content"] != last["content"]:
                found[3] = last
            found[1] = row
    rows = [row | {"which": k} for k, row in enumerate(found) if row is not None]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, out)


def _edges(ranges: list[dict[int, tuple]], apart: bool) -> dict[tuple, list[tuple[int, int]]]:
    """The other ranges, with the role there, that each key goes to; ranges: (key, content) by which."""
    out: dict[tuple, list[tuple[int, int]]] = {}
    for step, role, end, inner in ((1, 1, 0, 2), (-1, -1, 1, 3)):
        for k in range(len(ranges)):
            j = k + step
            if not 0 <= j < len(ranges):
                continue
            key, content = ranges[j][end]
            out.setdefault(key, []).append((k, role))
            while apart and 0 <= j < len(ranges):
                other = ranges[j][end] if ranges[j][end][1] != content else ranges[j].get(inner)
                if other:
                    out.setdefault(other[0], []).append((k, role))
                    break
                j += step
    return out


def in_ranges(df: DataFrame, keys: list[str], ties: list[str], content: Column | None = None) -> tuple[DataFrame, str, str]:
    """df dealt out and sorted by ranges of `keys`, and the names of two added columns.

    The first column is the number of the range, the second says how a row belongs to
    it: -1 the end of the range before, 0 its own, 1 the beginning of the range after;
    2 the first range's beginning, behind the last range. Rows with equal keys are in
    one range, in the order of `ties`, so the keys should tell rows apart. Keys are
    integers or strings, null comes first. With `content`, a number, each side of a range
    also has the nearest row of another content than the end it has. To the driver come
    two keys for each range, or four.
    """
    spark = df.sparkSession
    place, role = unused(df, "range_of_row"), unused(df, "role_in_range")
    n = RANGES * partitions(spark)
    names = [f"key{k}" for k in range(len(keys))]
    slim = df.select(*[F.col(c).alias(k) for c, k in zip(keys, names, strict=True)],
                     (F.lit(0) if content is None else content).cast("bigint").alias("content"))
    if content is not None:
        slim, _ = stored(slim, "contents")
    order = [F.col(k).asc_nulls_first() for k in names]
    slim = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = slim.withColumn("which", F.lit(0)).schema
    arrow = to_arrow_schema(schema)
    ranges: list[dict[int, tuple]] = []
    for r in slim.mapInArrow(lambda batches: _ends(batches, arrow), schema).collect():
        if r["which"] == 0:
            ranges.append({})
        ranges[-1][r["which"]] = (_sortable(r[: len(keys)]), r["content"])
    ranges.sort(key=lambda found: found[0][0])
    firsts = [found[0][0] for found in ranges]
    edges = _edges(ranges, content is not None)

    @F.arrow_udf(f"array<struct<{place}: int, {role}: int>>")
    def deal(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            key = _sortable(row[k] for k in keys)
            places = [{place: bisect_right(firsts, key) - 1, role: 0}]
            places += [{place: k, role: how} for k, how in edges.get(key, ())]
            if key == firsts[0]:
                places.append({place: len(firsts) - 1, role: 2})
            out.append(places)
        return pa.array(out, pa.list_(pa.struct([(place, pa.int32()), (role, pa.int32())])))

    dealt = df.select(*df.columns, F.explode(deal(F.struct(*keys))).alias("dealt")).select(*df.columns, "dealt.*")
    order = [place, F.when(F.col(role) == 2, 1).otherwise(0), *[F.col(k).asc_nulls_first() for k in keys], *ties, role]
    return dealt.repartition(partitions(spark), place).sortWithinPartitions(*order), place, role
