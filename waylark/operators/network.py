"""A fully connected network with batch normalisation, dropout and a weighted class.

Training is data-parallel. In each round every task walks its stored rows in mini-batches,
starting from the shared state (weights, normalisation, moments of the optimiser); Spark
adds the states up by position, weighted by rows, and their mean is the next shared state.
The driver holds one state, whose size follows from the layers. The loss on held-out rows
decides when to stop; the best state is returned.

Rows should be standardised. A missing value (null or NaN) counts as 0, the mean. Rows
without a label are left out. Without rows the model stays as it began.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.session import pinned

_EPS = 1e-5


@dataclass(frozen=True)
class Settings:
    """hidden: widths of the hidden layers, the first `normed` of which have normalisation and dropout.
    patience: rounds without a better held-out loss before training ends. momentum: of running means."""

    # Published settings of the network.
    hidden: tuple[int, ...] = (128, 64, 32)
    normed: int = 2
    dropout: float = 0.3
    rounds: int = 50
    batch: int = 32
    rate: float = 1e-3
    patience: int = 10
    momentum: float = 0.1
    seed: int = 42


def parts(inputs: int, s: Settings) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of what a state holds; those from `mean` on are not learnt by gradient."""
    widths = [inputs, *s.hidden, 1]
    learnt, kept = [], []
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        learnt += [(f"w{k}", (a, b)), (f"b{k}", (b,))]
        if k < min(s.normed, len(s.hidden)):
            learnt += [(f"scale{k}", (b,)), (f"shift{k}", (b,))]
            kept += [(f"mean{k}", (b,)), (f"var{k}", (b,))]
    return learnt + kept


def views(flat: np.ndarray, inputs: int, s: Settings) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in parts(inputs, s):
        size = math.prod(shape)
        out[name] = flat[at: at + size].reshape(shape)
        at += size
    return out


def sizes(inputs: int, s: Settings) -> tuple[int, int]:
    """Numbers learnt by gradient, and all."""
    count = [(math.prod(shape), name.startswith(("mean", "var"))) for name, shape in parts(inputs, s)]
    return sum(n for n, kept in count if not kept), sum(n for n, _ in count)


def initial(inputs: int, s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    flat = np.zeros(sizes(inputs, s)[1])
    v = views(flat, inputs, s)
    for name, a in v.items():
        if name[0] in "wb":
            reach = 1 / math.sqrt(v[f"w{name[1:]}"].shape[0])
            a[...] = rng.uniform(-reach, reach, a.shape)
        elif name.startswith(("scale", "var")):
            a[...] = 1.0
    return flat


def logits(v: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """With the running means, without dropout."""
    k = 0
    while f"w{k + 1}" in v:
        x = x @ v[f"w{k}"] + v[f"b{k}"]
        if f"scale{k}" in v:
            x = (x - v[f"mean{k}"]) / np.sqrt(v[f"var{k}"] + _EPS) * v[f"scale{k}"] + v[f"shift{k}"]
        x, k = np.maximum(x, 0), k + 1
    return (x @ v[f"w{k}"] + v[f"b{k}"])[:, 0]


def losses(z: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    return weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)


def gradient(v: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: float, masks: Sequence[np.ndarray]):
    """Mean loss of a mini-batch, its gradient by name, and the batch's means and variances.

    masks: for each normalised layer what dropout leaves, already scaled.
    """
    n, k, trace, seen = len(x), 0, [], {}
    while f"w{k + 1}" in v:
        a = x @ v[f"w{k}"] + v[f"b{k}"]
        hat = sd = None
        if f"scale{k}" in v:
            mean, var = a.mean(axis=0), a.var(axis=0)
            sd = np.sqrt(var + _EPS)
            hat = (a - mean) / sd
            a = hat * v[f"scale{k}"] + v[f"shift{k}"]
            seen[f"mean{k}"], seen[f"var{k}"] = mean, var * n / max(n - 1, 1)
        on = a > 0
        trace.append((x, hat, sd, on))
        x, k = a * on * (masks[k] if hat is not None else 1.0), k + 1
    z = (x @ v[f"w{k}"] + v[f"b{k}"])[:, 0]
    p = 1 / (1 + np.exp(-z))
    d = ((p * (weight * y + 1 - y) - weight * y) / n)[:, None]
    out = {f"w{k}": x.T @ d, f"b{k}": d.sum(axis=0)}
    d = d @ v[f"w{k}"].T
    for k in range(len(trace) - 1, -1, -1):
        x, hat, sd, on = trace[k]
        d = d * on * (masks[k] if hat is not None else 1.0)
        if hat is not None:
            out[f"scale{k}"], out[f"shift{k}"] = (d * hat).sum(axis=0), d.sum(axis=0)
            d = d * v[f"scale{k}"]
            d = (d - d.mean(axis=0) - hat * (d * hat).mean(axis=0)) / sd
        out[f"w{k}"], out[f"b{k}"] = x.T @ d, d.sum(axis=0)
        d = d @ v[f"w{k}"].T
    return losses(z, y, weight).mean(), out, seen


def _arrays(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(inputs)]).astype(float)
    return np.nan_to_num(x, nan=0.0), batch.column("label").to_numpy(zero_copy_only=False).astype(float)


def _walk(state: np.ndarray, steps: int, x: np.ndarray, y: np.ndarray, weight: float, rng, s: Settings) -> int:
    """Mini-batches of one Arrow batch, in seeded order; changes the state (learnt, kept, two moments) in place."""
    inputs = x.shape[1]
    n_learnt, n_all = sizes(inputs, s)
    learnt, first, second = state[:n_learnt], state[n_all: n_all + n_learnt], state[n_all + n_learnt:]
    v = views(state[:n_all], inputs, s)
    names = [n for n, _ in parts(inputs, s)]
    for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // s.batch)):
        masks = [(rng.random((len(rows), w)) >= s.dropout) / (1 - s.dropout) for w in s.hidden[: s.normed]]
        _, found, seen = gradient(v, x[rows], y[rows], weight, masks)
        g = np.concatenate([found[n].ravel() for n in names if n in found])
        steps += 1
        first += (g - first) * 0.1
        second += (g * g - second) * 0.001
        learnt -= s.rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        for name, value in seen.items():
            v[name] += s.momentum * (value - v[name])
    return steps


def next_state(table: DataFrame, state: np.ndarray, steps: int, number: int, inputs: int, weight: float, s: Settings) -> tuple[np.ndarray, int]:
    """The mean of the states that the tasks reach in one round, by rows, and the mean of their steps."""
    shared = table.sparkSession.sparkContext.broadcast(state)

    def train(batches):
        own, done, rows = shared.value.copy(), steps, 0
        rng = np.random.default_rng([s.seed, number, TaskContext.get().partitionId()])
        for b in batches:
            if b.num_rows:
                done, rows = _walk(own, done, *_arrays(b, inputs), weight, rng, s), rows + b.num_rows
        if rows:
            sums = np.concatenate([own, [done - steps, 1.0]]) * rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "value"])

    found = table.mapInArrow(train, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    if found.empty:
        return state, steps
    sums = found.sort_values("place")["value"].to_numpy(float)
    mean = sums[:-1] / sums[-1]
    return mean[:-1], steps + max(1, round(mean[-1]))


def mean_loss(table: DataFrame, state: np.ndarray, inputs: int, weight: float, s: Settings) -> float:
    """Weighted loss of held-out rows; 0 without rows."""
    flat = state[: sizes(inputs, s)[1]]

    def add(batches):
        for b in batches:
            x, y = _arrays(b, inputs)
            total = float(losses(logits(views(flat, inputs, s), x), y, weight).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([b.num_rows])], ["loss", "n"])

    r = table.mapInArrow(add, "loss double, n long").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("mean")).first()
    return r["mean"] or 0.0


@dataclass
class Network:
    features: list[str]
    settings: Settings
    state: np.ndarray
    losses: list[float]


def _table(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])


# Rows that one task walks in a round. Without a bound a round takes as long as all rows on a few cores.
TASK_ROWS = 200_000


def tasks_for(rows: int, least: int) -> int:
    return max(least, -(-rows // TASK_ROWS))


def fit(train: DataFrame, held_out: DataFrame, features: Sequence[str], label: str, key: Sequence[str],
        settings: Settings = Settings(), positive_weight: float | None = None, tasks: int | None = None) -> Network:
    """Rows are dealt to tasks by a hash of their key, once; tasks: how many at least,
    more for many rows; Spark's setting if not given."""
    s, features, inputs = settings, list(features), len(features)
    dealt = F.xxhash64(*key, F.lit(s.seed))
    count = [tasks_for(train.count(), tasks)] if tasks else []
    mixed = train.withColumn("_dealt", dealt).repartition(*count, "_dealt").sortWithinPartitions("_dealt")
    table, held = pinned(_table(mixed, features, label), "network-train"), pinned(_table(held_out, features, label), "network-held-out")
    if positive_weight is None:
        n = table.agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") != 1, 1)).alias("q")).first()
        positive_weight = n["q"] / n["p"] if n["p"] and n["q"] else 1.0
    n_learnt, n_all = sizes(inputs, s)
    state, steps = np.concatenate([initial(inputs, s), np.zeros(2 * n_learnt)]), 0
    best, least, since, told = state, math.inf, 0, []
    for number in range(s.rounds):
        state, steps = next_state(table, state, steps, number, inputs, positive_weight, s)
        told.append(mean_loss(held, state, inputs, positive_weight, s))
        if told[-1] < least:
            best, least, since = state, told[-1], 0
        else:
            since += 1
            if since >= s.patience:
                break
    return Network(features, s, best[:n_all].copy(), told)


def predict(model: Network, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep... and the probability of label 1."""
    kept, inputs = rows.select(*keep).schema, len(model.features)
    names = [f"_x{k}" for k in range(inputs)]
    wide = rows.select(*keep, *[F.col(f).cast("double").alias(n) for f, n in zip(model.features, names, strict=True)])
    shared = rows.sparkSession.sparkContext.broadcast(model.state)
    s = model.settings

    def score(batches):
        v = views(shared.value, inputs, s)
        for b in batches:
            x = np.nan_to_num(np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float), nan=0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(kept))], pa.array(1 / (1 + np.exp(-logits(v, x))))],
                                             [*kept.names, "probability"])

    return wide.mapInArrow(score, T.StructType([*kept.fields, T.StructField("probability", T.DoubleType())]))


def save(model: Network, spark: SparkSession, path: str) -> None:
    spark.createDataFrame(
        [(model.features, [float(x) for x in model.state], list(map(float, model.losses)), repr(model.settings))],
        "features array<string>, state array<double>, losses array<double>, settings string",
    ).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, settings: Settings = Settings()) -> Network:
    """The model stored at `path`; other settings than it was stored with are an error."""
    r = spark.read.parquet(path).first()
    if r["settings"] != repr(settings):
        raise ValueError(f"stored with {r['settings']}")
    return Network(list(r["features"]), settings, np.array(r["state"], float), list(r["losses"]))
