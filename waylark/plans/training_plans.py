"""Queries on models trained by gradient and curvature, and by averaged states."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.operators import boosting as BO
from waylark.operators import explain as X
from waylark.operators import features as FE
from waylark.operators import models as M
from waylark.operators import network as NN
from waylark.plans import domain as D
from waylark.plans.explain_plans import _PLANTED
from waylark.plans.learning_plans import _bucket_sql
from waylark.plans.registry import query
from waylark.session import pinned

_KEY = ["l_orderkey", "l_linenumber"]
_FEATURES = ["quantity", "discount", "tax"]


def _lines(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        *_KEY, F.expr(_PLANTED).alias("late"), *[F.col(f"l_{f}").cast("double").alias(f) for f in _FEATURES])


def _best(rows: str, name: str) -> str:
    """SQL: for each node of `rows` the best split by gradient and curvature of the first round."""
    return f"""
{name}_u AS (SELECT node, late, unnest([0, 1, 2]) AS f, unnest([quantity, discount, tax]) AS v FROM {rows}),
{name}_s AS (SELECT node, f, v, sum(0.5::DOUBLE - late) AS g, 0.25::DOUBLE * count(*) AS h FROM {name}_u GROUP BY ALL),
{name}_c AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, f) AS g0,
                    sum(h) OVER (PARTITION BY node, f) AS h0 FROM {name}_s WINDOW w AS (PARTITION BY node, f ORDER BY v)),
{name}_g AS (SELECT *, gl * gl / (hl + 1) + (g0 - gl) * (g0 - gl) / (h0 - hl + 1) - g0 * g0 / (h0 + 1) AS gain
             FROM {name}_c WHERE hl >= 1 AND h0 - hl >= 1),
{name} AS (SELECT * FROM {name}_g WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)"""


_GOES = "CASE b.f WHEN 0 THEN quantity WHEN 1 THEN discount ELSE tax END <= b.v"


@query("boosted_first_tree", f"""
WITH t AS (SELECT 0 AS node, CASE WHEN l_quantity > 25 AND l_discount > 0.04 OR l_tax > 0.07 THEN 1 ELSE 0 END AS late,
           l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem),
{_best('t', 'b0')},
t1 AS (SELECT t.* REPLACE (CASE WHEN {_GOES} THEN 1 ELSE 2 END AS node) FROM t JOIN b0 b ON t.node = b.node),
{_best('t1', 'b1')},
t2 AS (SELECT t1.* REPLACE (CASE WHEN {_GOES} THEN 2 * t1.node + 1 ELSE 2 * t1.node + 2 END AS node) FROM t1 JOIN b1 b ON t1.node = b.node),
every AS (SELECT * FROM t UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
splits AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1)
SELECT e.node::INT AS node, coalesce(any_value(s.f), -1)::INT AS feature, any_value(s.v) AS threshold,
       round(-sum(0.5::DOUBLE - late) / (0.25::DOUBLE * count(*) + 1), 6) AS prediction, 0.25::DOUBLE * count(*) AS cover
FROM every e LEFT JOIN splits s ON e.node = s.node GROUP BY 1""")
def boosted_first_tree(spark, sf):
    """The first tree over all line items: every split and leaf as SQL finds them."""
    one = BO.Settings(rounds=1, depth=2, rows=1.0, columns=1.0)
    model = BO.fit(_lines(spark, sf), _FEATURES, "late", _KEY, one, positive_weight=1.0)
    return model.table(spark).select("node", "feature", "threshold", F.round("prediction", 6).alias("prediction"), "cover")


def _split(spark, sf):
    both = pinned(FE.stratified_split(_lines(spark, sf), "late", _KEY), "planted")
    return both.where("NOT is_test"), both.where("is_test")


_TEST = f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_discount > 0.04 OR l_tax > 0.07 THEN 1 ELSE 0 END AS late FROM lineitem),
test AS (SELECT * FROM t WHERE {_bucket_sql("l_orderkey", "l_linenumber", "late")} < 2000)"""


@query("planted_signal_trained", _TEST + """
SELECT model, count(*) AS n_rows, sum(late)::BIGINT AS n_positive, TRUE AS auc_above, TRUE AS accuracy_above
FROM test, (VALUES ('boosted_trees'), ('neural_network')) m(model) GROUP BY 1""")
def planted_signal_trained(spark, sf):
    """Trees with sampled columns and the network with normalisation and dropout find a signal that
    is there: AUC above 0.95, accuracy above 0.85 on rows that neither learnt from. The network stops
    by rows of the training part."""
    train, test = _split(spark, sf)
    keep = [*_KEY, "late"]
    trees = BO.fit(train, _FEATURES, "late", _KEY, BO.Settings(rounds=12, depth=3, rate=0.3))
    scaler = FE.fit_scaler(train, _FEATURES)
    scaled = FE.apply_scaler(train, scaler)
    last = F.pmod(F.xxhash64(*_KEY, F.lit(1)), F.lit(10)) == 0
    net = NN.fit(scaled.where(~last), scaled.where(last), _FEATURES, "late", _KEY,
                 NN.Settings(hidden=(24, 12, 8), rounds=12, patience=4, dropout=0.1, rate=0.01), tasks=4)
    runs = [BO.predict(trees, test, keep).withColumn("model", F.lit("boosted_trees")),
            NN.predict(net, FE.apply_scaler(test, scaler), keep).withColumn("model", F.lit("neural_network"))]
    rows = pinned(runs[0].unionByName(runs[1]), "planted-scores")
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("late").cast("bigint").alias("n_positive"))
    return counts.join(M.evaluate(rows, "late", "probability", "model"), "model").select(
        "model", "n_rows", "n_positive", (F.col("auc") > 0.95).alias("auc_above"), (F.col("accuracy") > 0.85).alias("accuracy_above"))


@query("boosted_trees_explained", _TEST + " SELECT count(*) AS n_rows, count(*) AS n_exact FROM test")
def boosted_trees_explained(spark, sf):
    """Base value and contributions give the log odds of every test row."""
    train, test = _split(spark, sf)
    model = BO.fit(train, _FEATURES, "late", _KEY, BO.Settings(rounds=6, depth=3, rate=0.3))
    # Each row carries its probability along: nothing is joined, and equal line items stay apart.
    scored = BO.predict(model, test, _FEATURES)
    found = X.explained(model.table(spark), scored, model.features, ["probability"])
    margin = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c)
    exact = F.abs(1 / (1 + F.exp(-margin)) - F.col("probability")) < 1e-9
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(exact, 1)).alias("n_exact"))
