"""Boosted trees by gradient and curvature, with columns and rows sampled for each tree.

Feature values are put into bins once, and rows are stored in blocks: a stored row holds the
values of up to `BLOCK` rows, each column as the bytes of one array. A pass hands blocks from
Spark to numpy, so its cost is that of the sums, not of moving single rows. For each level of a
tree one pass over the stored blocks sums gradient and curvature by (node, feature, bin) inside the tasks; Spark adds up
what the tasks found, and the driver receives these sums, whose number is bounded by
2^depth x features x bins. Sums are whole numbers (units of 2^-20), so a tree does not
depend on how the rows are distributed. Margins are stored with the rows every few trees;
in between, tasks add the trees that are not in yet.

A missing value (null or NaN) counts as smaller than all others, and a threshold of minus
infinity splits it off. Rows without a label are left out. Without rows, or with one class only, the ensemble may have leaves only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.operators.explain import NODE
from waylark.operators.upsert import remove
from waylark.session import new_shared_path

_UNIT = float(1 << 20)
# Rows of a stored block, and blocks that a task works on at once.
BLOCK, AT_ONCE = 256, 64
# Bytes of a row group of stored blocks: small ones are dealt evenly over the tasks.
GROUP_BYTES = 4 << 20
# What a block holds of its rows; bins are in columns bin_0, bin_1...
_KINDS = {"row": np.int64, "label": np.float64, "margin": np.float64}


@dataclass(frozen=True)
class Settings:
    """rows, columns: the shares sampled for each tree; l2: added to curvatures in leaves;
    least_curvature: what either side of a split must have; stored_every: trees between two
    stored tables of margins."""

    rounds: int = 200
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least_curvature: float = 1.0
    bins: int = 256
    seed: int = 42
    stored_every: int = 10


@dataclass
class Tree:
    """Node k has the children 2k + 1 and 2k + 2; a leaf has feature -1. Rows whose bin is above the cut go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def places(self, bins: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The node at which each row ends so far."""
        at = np.zeros(n, np.int64)
        for node in np.flatnonzero(self.feature >= 0):
            here = np.flatnonzero(at == node)
            at[here] = 2 * node + 1 + (bins[int(self.feature[node])][here] > self.cut[node])
        return at


def cuts_of(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 1 thresholds for each feature, from approximate quantiles; minus infinity too where values are missing."""
    shares = [k / bins for k in range(1, bins)]
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    found = rows.agg(*[F.struct(
        F.percentile_approx(value(f), shares, 100 * bins).alias("cuts"), (F.count(F.lit(1)) > F.count(value(f))).alias("missing"),
    ).alias(f"_{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array([*([-np.inf] if c["missing"] else []), *(c["cuts"] or [])], float)) for c in found]


def _values(column: pa.Array) -> np.ndarray:
    v = column.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(v), -np.inf, v)


def _column(values: np.ndarray) -> pa.Array:
    """The bytes of `BLOCK` values each."""
    ends = np.minimum(np.arange(0, len(values) + BLOCK, BLOCK), len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _array(blocks: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(blocks.column(name).to_pylist()), _KINDS.get(name, np.int16))


def _parts(batches):
    for b in batches:
        for k in range(0, b.num_rows, AT_ONCE):
            yield b.slice(k, AT_ONCE)


def binned(rows: DataFrame, features: Sequence[str], label: str, key: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: n, positive (rows with label 1); row (a hash of the key), label, margin and a bin for each feature."""
    wide = rows.where(F.col(label).isNotNull()).select(
        F.xxhash64(*key).alias("row"), F.col(label).cast("double").alias("label"),
        *[F.col(f).cast("double").alias(f"bin_{k}") for k, f in enumerate(features)])
    names = ["row", "label", "margin", *[f"bin_{k}" for k in range(len(features))]]

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            label = b.column("label").to_numpy()
            found = [np.searchsorted(c, _values(b.column(f"bin_{k}"))).astype(np.int16) for k, c in enumerate(cuts)]
            starts = np.arange(0, b.num_rows, BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.diff(starts, append=b.num_rows)), pa.array(np.add.reduceat((label == 1).astype(np.int64), starts)),
                *map(_column, (b.column("row").to_numpy(), label, np.zeros(b.num_rows), *found))], ["n", "positive", *names])

    return wide.mapInArrow(assign, "n long, positive long, " + ", ".join(f"{n} binary" for n in names))


def _stored(blocks: DataFrame) -> str:
    path = new_shared_path(blocks.sparkSession, "binned")
    blocks.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return path


def drawn(rows: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a hash of row, tree and seed decides."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def _used(trees: Sequence[Tree]) -> set[int]:
    return {int(f) for t in trees for f in t.feature if f >= 0}


def _with_margins(table: DataFrame, pending: Sequence[Tree], rate: float) -> DataFrame:
    names, used = table.columns, sorted(_used(pending))

    def add(batches):
        for b in _parts(batches):
            bins = {f: _array(b, f"bin_{f}") for f in used}
            margin = _array(b, "margin")
            margin = margin + sum(rate * t.value[t.places(bins, len(margin))] for t in pending)
            sizes = b.column("n").to_numpy() * margin.itemsize
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            added = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(margin)])
            yield pa.RecordBatch.from_arrays([added if n == "margin" else b.column(n) for n in names], names)

    return table.mapInArrow(add, table.schema)


def level_sums(table: DataFrame, pending: Sequence[Tree], tree: Tree, number: int, level: int, columns: Sequence[int],
               widths: Sequence[int], weight: float, s: Settings) -> DataFrame:
    """(slot, gradient, curvature) in units; a slot is a bin of a feature in a node of the level."""
    width, first, nodes = max(widths), (1 << level) - 1, 1 << level
    used = sorted(set(columns) | _used([*pending, tree]))
    columns = list(columns)

    def sums(batches):
        total = np.zeros((2, nodes * len(columns) * width), np.int64)
        for b in _parts(batches):
            bins = {f: _array(b, f"bin_{f}") for f in used}
            margin = _array(b, "margin")
            margin = margin + sum(s.rate * t.value[t.places(bins, len(margin))] for t in pending)
            at = tree.places(bins, len(margin)) - first
            seen = np.flatnonzero((at >= 0) & drawn(_array(b, "row"), number, s.seed, s.rows))
            y = _array(b, "label")[seen]
            p = 1 / (1 + np.exp(-margin[seen]))
            w = np.where(y == 1, weight, 1.0)
            both = [np.rint(v * _UNIT) for v in (w * (p - y), w * p * (1 - p))]
            for k, f in enumerate(columns):
                slots = (at[seen] * len(columns) + k) * width + bins[f][seen]
                for out, v in zip(total, both, strict=True):
                    out += np.rint(np.bincount(slots, v, total.shape[1])).astype(np.int64)
        slots = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[0][slots]), pa.array(total[1][slots])], ["slot", "g", "h"])

    read = table.select("row", "label", "margin", *[f"bin_{f}" for f in used])
    return read.mapInArrow(sums, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def grow(tree: Tree, level: int, sums: np.ndarray, columns: Sequence[int], widths: Sequence[int], s: Settings) -> bool:
    """Splits the level's nodes where that gains; sums: (gradient or curvature, node, column, bin).
    Whether any was split. Of equal gains the first feature's lowest cut is taken."""
    first, left = (1 << level) - 1, np.cumsum(sums, axis=3)
    whole = left[:, :, 0, -1]
    right = whole[:, :, None, None] - left
    part = lambda x: x[0] ** 2 / np.maximum(x[1] + s.l2, 1e-300)
    gain = part(left) + part(right) - part(whole)[:, None, None]
    least = max(s.least_curvature, 1 / _UNIT)
    allowed = (left[1] >= least) & (right[1] >= least)
    # The last bin of a feature has no cut above it.
    allowed &= (np.arange(sums.shape[3]) < np.array([widths[c] for c in columns])[:, None] - 1)[None]
    gain = np.where(allowed, gain, -np.inf).reshape(len(whole[0]), -1)
    best = gain.argmax(axis=1)
    grown = False
    for node, place in enumerate(best):
        k, at = first + node, np.unravel_index(place, sums.shape[2:])
        if level == 0:
            tree.value[k], tree.cover[k] = -whole[0, node] / max(whole[1, node] + s.l2, 1e-300), whole[1, node]
        if not gain[node, place] > 1e-9:
            continue
        grown = True
        tree.feature[k], tree.cut[k] = columns[at[0]], at[1]
        for child, side in ((2 * k + 1, left), (2 * k + 2, right)):
            g, h = side[0, node][at], side[1, node][at]
            tree.value[child], tree.cover[child] = -g / (h + s.l2), h
    return grown


@dataclass
class Ensemble:
    """features: the columns in the order that the nodes count them; nodes: as in `NODE`, weights included."""

    features: list[str]
    nodes: list[tuple]

    def table(self, spark: SparkSession) -> DataFrame:
        """The nodes as `explain.explained` takes them."""
        return spark.createDataFrame(self.nodes, NODE)

    def save(self, spark: SparkSession, path: str) -> None:
        """The names go last: a folder without them is not complete."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(list(enumerate(self.features)), "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        names = spark.read.parquet(f"{path}/features").collect()
        nodes = [tuple(r) for r in spark.read.schema(NODE).parquet(f"{path}/nodes").collect()]
        return cls([r["feature"] for r in sorted(names)], sorted(nodes, key=lambda r: (r[0], r[2])))


def _nodes(number: int, t: Tree, cuts: list[np.ndarray], rate: float) -> list[tuple]:
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        f = int(t.feature[k])
        inner = f >= 0
        out.append((number, rate, k, 2 * k + 1 if inner else -1, 2 * k + 2 if inner else -1, f,
                    float(cuts[f][t.cut[k]]) if inner else None, float(t.value[k]), float(t.cover[k])))
        todo += [2 * k + 1, 2 * k + 2] if inner else []
    return out


def fit(train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], settings: Settings = Settings(),
        positive_weight: float | None = None) -> Ensemble:
    """An ensemble whose margin is the log odds of label 1. `key` tells rows apart, for sampling.

    positive_weight: of the rows with label 1; negatives per positive if not given.
    """
    s, spark, features = settings, train.sparkSession, list(features)
    cuts = cuts_of(train.where(F.col(label).isNotNull()), features, s.bins)
    widths = [len(c) + 1 for c in cuts]
    path = _stored(binned(train, features, label, key, cuts))
    table = spark.read.parquet(path)
    if positive_weight is None:
        n = table.agg(F.sum("positive").alias("p"), F.sum(F.col("n") - F.col("positive")).alias("q")).first()
        positive_weight = n["q"] / n["p"] if n["p"] and n["q"] else 1.0
    rng = np.random.default_rng(s.seed)
    take = max(1, round(s.columns * len(features)))
    nodes, pending = [], []
    for number in range(s.rounds):
        columns = sorted(int(c) for c in rng.choice(len(features), take, replace=False))
        tree = Tree.empty(s.depth)
        for level in range(s.depth):
            found = level_sums(table, pending, tree, number, level, columns, widths, positive_weight, s).toPandas()
            sums = np.zeros((2, (1 << level) * take * max(widths)))
            for out, c in zip(sums, ("g", "h"), strict=True):
                out[found["slot"].to_numpy(np.int64)] = found[c].to_numpy(float) / _UNIT
            if not grow(tree, level, sums.reshape(2, 1 << level, take, -1), columns, widths, s):
                break
        nodes += _nodes(number, tree, cuts, s.rate)
        pending.append(tree)
        if len(pending) == s.stored_every and number + 1 < s.rounds:
            old, path = path, _stored(_with_margins(table, pending, s.rate))
            table, pending = spark.read.parquet(path), []
            remove(spark, old)
    remove(spark, path)
    return Ensemble(features, nodes)


def margins(nodes: Sequence[tuple], values: np.ndarray) -> np.ndarray:
    """Margins of rows of feature values, missing ones -inf."""
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes:
        trees.setdefault(r[0], {})[r[2]] = r
    out = np.zeros(len(values))
    for tree in trees.values():
        todo = [(0, np.arange(len(values)))]
        while todo:
            at, rows = todo.pop()
            _, weight, _, left, right, feature, threshold, value, _ = tree[at]
            if feature < 0:
                out[rows] += weight * value
                continue
            goes = values[rows, feature] <= threshold
            todo += [(left, rows[goes]), (right, rows[~goes])]
    return out


def predict(model: Ensemble, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep... and the probability of label 1."""
    kept = rows.select(*keep).schema
    names = [f"_feature{k}" for k in range(len(model.features))]
    wide = rows.select(*keep, *[F.col(f).cast("double").alias(n) for f, n in zip(model.features, names, strict=True)])
    shared = rows.sparkSession.sparkContext.broadcast(model.nodes)

    def score(batches):
        for b in batches:
            p = 1 / (1 + np.exp(-margins(shared.value, np.column_stack([_values(b.column(n)) for n in names]))))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(kept))], pa.array(p)], [*kept.names, "probability"])

    return wide.mapInArrow(score, T.StructType([*kept.fields, T.StructField("probability", T.DoubleType())]))
