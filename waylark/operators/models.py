"""Delay models with Spark ML, their evaluation and selection."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import perceptron
from waylark.operators.features import FEATURE_COLS, LABEL_COL, class_stats
from waylark.operators.ordered import running_totals
from waylark.session import pinned

# Published settings of the boosted trees and the network.
TREE_SETTINGS = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8"}
NETWORK_LAYERS = [20, 128, 64, 32, 2]
NETWORK_ROUNDS = 50
DECISION_THRESHOLD = 0.5
PREFERENCE = {"boosted_trees": 1, "neural_network": 0}


def positive_weight(df: DataFrame, label: str = LABEL_COL) -> float:
    """Negatives per positive; 1 when there are no positives."""
    return class_stats(df, label).first()["positive_weight"] or 1.0


# Rows from which a further task is worth its start, and rows of one task at most.
SPREAD_ROWS, TASK_ROWS = 20_000, 200_000


def even_parts(df: DataFrame) -> int:
    """Parts to deal the rows to before training; below two they stay as they are. Training passes over the rows
    hundreds of times, and the rows of a stored table of few row groups would all be in as few tasks."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    if rows > cores * TASK_ROWS:
        # Whole rounds of all cores: a last round of few tasks would take as long as the others.
        return cores * -(-rows // (cores * TASK_ROWS))
    return min(cores, rows // SPREAD_ROWS)


def spread(df: DataFrame) -> DataFrame:
    """df stored in even parts for all cores; few rows stay as they are."""
    parts = even_parts(df)
    return df if parts < 2 else pinned(df.repartition(parts), "spread")


def fit_trees(train: DataFrame, features: list[str] | None = None, label: str = LABEL_COL,
              seed: int = 42, **settings) -> PipelineModel:
    """Gradient-boosted trees with the positive class weighted up.

    Columns are sampled per node, not per tree.
    """
    train = spread(train.select(*(features or FEATURE_COLS), label))
    weighted = train.withColumn(
        "_weight", F.when(F.col(label) == 1, positive_weight(train, label)).otherwise(1.0)
    )
    assemble = VectorAssembler(inputCols=features or FEATURE_COLS, outputCol="features")
    trees = GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="_weight", seed=seed,
        **(TREE_SETTINGS | settings),
    )
    return Pipeline(stages=[assemble, trees]).fit(weighted)


def balanced(df: DataFrame, key: list[str], label: str = LABEL_COL, seed: int = 7) -> DataFrame:
    """Repeat positive rows so both classes weigh the same.

    The whole part of the weight is repeated, the fraction decided by a hash.
    """
    weight = positive_weight(df, label)
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000)) / 10_000.0
    extra = F.when(draw < weight % 1, 1).otherwise(0)
    copies = F.when(F.col(label) == 1, F.lit(int(weight)) + extra).otherwise(1)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).drop("_copy")


def fit_network(train: DataFrame, features: list[str] | None = None, label: str = LABEL_COL,
                seed: int = 42, layers: list[int] | None = None, rounds: int = NETWORK_ROUNDS) -> PipelineModel:
    """Fully connected network on standardised, balanced rows."""
    cols = features or FEATURE_COLS
    assemble = VectorAssembler(inputCols=cols, outputCol="features")
    parts = even_parts(train)
    net = perceptron.fit(
        train if parts < 2 else train.repartition(parts), cols, label, layers or [len(cols), *NETWORK_LAYERS[1:]], rounds, seed)
    return PipelineModel([assemble, net])


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep... plus the positive probability, clamped to [0, 1]."""
    scored = model.transform(df)
    p = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*keep, S.clamp_probability(p).alias("probability"))


def feature_importance(model: PipelineModel, features: list[str] | None = None) -> DataFrame:
    trees = model.stages[-1]
    pairs = [(n, float(v)) for n, v in zip(features or FEATURE_COLS, trees.featureImportances.toArray())]
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(pairs, "feature string, importance double")


# --- decisions ---------------------------------------------------------------------

def decide(p: Column | str) -> dict[str, Column]:
    """Shown probability (4 digits) and decision (on the unrounded value)."""
    c = S.clamp_probability(p)
    return {"delay_probability": F.round(c, 4), "delay_prediction": c >= DECISION_THRESHOLD}


def score_journeys(scored: DataFrame, journey: str, model: str, probability: str = "probability") -> DataFrame:
    """The worst segment decides; a journey with an unscored segment has no score."""
    g = scored.groupBy(journey).agg(
        F.max(probability).alias("_worst"),
        F.count(F.lit(1)).alias("n_segments"),
        F.count(probability).alias("_scored"),
    )
    worst = F.when(F.col("_scored") == F.col("n_segments"), F.col("_worst"))
    return g.select(
        journey, *[c.alias(n) for n, c in decide(worst).items()],
        F.lit(model).alias("model_used"), "n_segments",
    )


# --- evaluation -----------------------------------------------------------------------

def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with accuracy, precision, recall and F1 in one aggregation."""
    y, p = F.col(label) == 1, F.col(prediction)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g = df.groupBy(*(by or [])).agg(
        count(y & p).alias("tp"), count(~y & p).alias("fp"),
        count(y & ~p).alias("fn"), count(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        "*",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def _by_score(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    return df.groupBy(group, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )


def roc_points(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """False and true positive rate at each distinct score used as threshold."""
    counted = _by_score(df, label, score, group)
    run = running_totals(counted, group, score, ["pos", "neg"], descending=True)
    return run.select(
        group, F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("tot_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("tot_pos")).alias("tpr"),
    )


def auc(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """Exact ROC-AUC per group, ties counted half.

    Rows are counted per distinct score first; ranks come from range buckets, so
    no task sorts the whole result.
    """
    counted = _by_score(df, label, score, group)
    run = running_totals(counted, group, score, ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return run.groupBy(group).agg(
        F.try_divide(won, F.max("tot_pos").cast("double") * F.max("tot_neg")).alias("auc"),
        F.max("tot_pos").alias("n_positive"),
        F.max("tot_neg").alias("n_negative"),
    )


def evaluate(df: DataFrame, label: str, probability: str, group: str) -> DataFrame:
    """Accuracy, F1 and AUC per group (for example per model)."""
    decided = df.withColumn("_hit", F.col(probability) >= DECISION_THRESHOLD)
    return confusion(decided, label, "_hit", [group]).join(
        auc(df, label, probability, group).select(group, "auc"), group
    )


# --- selection -------------------------------------------------------------------------

def select_model(metrics: DataFrame) -> DataFrame:
    """The run with the higher AUC; on a tie the trees win."""
    rank = F.try_element_at(
        F.create_map(*[F.lit(v) for p in PREFERENCE.items() for v in p]), F.col("model")
    )
    best = F.max_by(F.struct(*metrics.columns), F.struct("auc", F.coalesce(rank, F.lit(-1))))
    return metrics.agg(best.alias("b")).select("b.*")


def selection_history(metrics: DataFrame, now: Column, history: DataFrame | None = None) -> DataFrame:
    """The history with one row per run of this round; the selected run is marked and
    gets the time of its promotion."""
    best = select_model(metrics).select("model", F.lit(True).alias("promoted"))
    rows = metrics.join(best, "model", "left").select(
        *metrics.columns, F.coalesce("promoted", F.lit(False)).alias("promoted"),
        now.alias("evaluated_at"), F.when(F.col("promoted"), now).alias("promoted_at"),
    )
    return rows if history is None else history.unionByName(rows)


def latest_versions(versions: DataFrame, by: str = "model") -> DataFrame:
    """Highest numeric version per model."""
    number = F.col("version").cast("int")
    return versions.groupBy(by).agg(
        F.max_by(F.struct(*[c for c in versions.columns if c != by]), number).alias("v")
    ).select(by, "v.*")
