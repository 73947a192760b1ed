"""Trees by gradient and curvature against brute force; the network against finite differences."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylark.operators import boosting as BO
from waylark.operators import explain as X
from waylark.operators import models as M
from waylark.operators import network as NN
from waylark.plans import training_plans as TP
from waylark.session import pinned

SCHEMA = "id long, a double, b double, c double, late int"


def made(n=90, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.uniform(0, 5, (n, 3)), 1)
    y = ((x[:, 0] > 2.5) & (x[:, 1] > 1) | (x[:, 2] > 4.2)).astype(int)
    y = np.where(r.uniform(size=n) < 0.1, 1 - y, y)
    return [(i, *map(float, row), int(late)) for i, (row, late) in enumerate(zip(x, y))]


def brute(rows, depth, rounds, rate, weight, l2=1.0, least=1.0):
    """Every value of every feature as a threshold, in plain Python: the margins of all rows."""
    margin = [0.0] * len(rows)

    def split(at, g, h, depth):
        G, H = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-9, None)
        for f in range(3) if depth else ():
            for cut in sorted({rows[i][1 + f] for i in at}):
                left = [i for i in at if rows[i][1 + f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl >= least and H - hl >= least:
                    gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                    if gain > best[0] + 1e-7:
                        best = (gain, (f, cut))
        if best[1] is None:
            for i in at:
                margin[i] += rate * -G / (H + l2)
            return
        f, cut = best[1]
        split([i for i in at if rows[i][1 + f] <= cut], g, h, depth - 1)
        split([i for i in at if rows[i][1 + f] > cut], g, h, depth - 1)

    for _ in range(rounds):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        w = [weight if r[4] else 1.0 for r in rows]
        g = [wi * (pi - r[4]) for wi, pi, r in zip(w, p, rows)]
        h = [wi * pi * (1 - pi) for wi, pi in zip(w, p)]
        split(list(range(len(rows))), g, h, depth)
    return margin


ALL = BO.Settings(rounds=5, depth=3, rate=0.3, rows=1.0, columns=1.0, stored_every=2)


@pytest.mark.parametrize("weight", [1.0, 2.5])
def test_trees_equal_brute_force(spark, weight):
    rows = made()
    model = BO.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b", "c"], "late", ["id"], ALL, weight)
    got = BO.margins(model.nodes, np.array([r[1:4] for r in rows]))
    assert np.allclose(got, brute(rows, 3, 5, 0.3, weight), atol=1e-4)


def test_trees_do_not_depend_on_partitions(spark):
    s = BO.Settings(rounds=4, depth=3, rows=0.7, columns=0.67, stored_every=3)
    df = spark.createDataFrame(made(400), SCHEMA)
    one, many = (BO.fit(df.repartition(n), ["a", "b", "c"], "late", ["id"], s).nodes for n in (1, 7))
    assert one == many
    for tree in range(4):
        assert len({r[5] for r in one if r[0] == tree and r[5] >= 0}) <= 2


def test_sampled_rows():
    ids = np.arange(100_000) * 7919
    first, second = (BO.drawn(ids, t, 42, 0.8) for t in (0, 1))
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & second).mean() - 0.64) < 0.01
    assert BO.drawn(ids, 0, 42, 1.0).all()


def test_explained_and_stored(spark, tmp_path):
    rows = spark.createDataFrame(made(), SCHEMA)
    model = BO.fit(rows, ["a", "b", "c"], "late", ["id"], ALL)
    model.save(spark, str(tmp_path / "m"))
    again = BO.Ensemble.load(spark, str(tmp_path / "m"))
    assert again.features == model.features and sorted(map(str, again.nodes)) == sorted(map(str, model.nodes))
    found = X.explained(again.table(spark), rows, again.features, ["id"]).join(BO.predict(again, rows, ["id"]), "id").collect()
    for r in found:
        assert 1 / (1 + np.exp(-(r["base_value"] + sum(r["contributions"])))) == pytest.approx(r["probability"], abs=1e-9)


def test_trees_on_odd_rows(spark):
    """Missing values are split off; rows without a label, no rows and one class are no error."""
    rows = [(i, None if i % 2 else float("nan"), 1.0, None, 1) for i in range(20)]
    rows += [(i, 2.0 + i % 3, 1.0, None, 0) for i in range(20, 40)] + [(99, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = BO.fit(df, ["a", "b", "c"], "late", ["id"], ALL)
    p = {r["id"]: r["probability"] for r in BO.predict(model, df, ["id"]).collect()}
    assert len(p) == 41 and p[0] == p[1] > 0.5 > p[20 + 1]
    empty = BO.fit(df.limit(0), ["a", "b", "c"], "late", ["id"], ALL)
    assert {r["probability"] for r in BO.predict(empty, df, ["id"]).collect()} == {0.5}
    single = BO.fit(df.where("late = 1"), ["a", "b", "c"], "late", ["id"], ALL)
    assert all(r["probability"] > 0.5 for r in BO.predict(single, df, ["id"]).collect())


SMALL = NN.Settings(hidden=(5, 4, 3), rounds=30, patience=5, rate=0.02, dropout=0.1)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(12, 3)), (rng.uniform(size=12) < 0.4).astype(float)
    flat = NN.initial(3, SMALL) + rng.normal(size=NN.sizes(3, SMALL)[1]) * 0.05
    masks = [(rng.random((12, w)) >= 0.3) / 0.7 for w in SMALL.hidden[:2]]
    loss = lambda f: NN.gradient(NN.views(f, 3, SMALL), x, y, 2.5, masks)[0]
    _, found, _ = NN.gradient(NN.views(flat, 3, SMALL), x, y, 2.5, masks)
    got = np.concatenate([found[n].ravel() for n, _ in NN.parts(3, SMALL) if n in found])
    assert len(got) == NN.sizes(3, SMALL)[0]
    step = np.eye(len(flat))[: len(got)] * 1e-6
    want = np.array([(loss(flat + e) - loss(flat - e)) / 2e-6 for e in step])
    assert np.allclose(got, want, atol=1e-6)


def test_network_learns_and_stops(spark, tmp_path):
    df = spark.createDataFrame(made(1500), SCHEMA).withColumns({f: (F.col(f) - 2.5) / 1.45 for f in "abc"})
    train, held, test = (df.where(w) for w in ("id % 5 > 1", "id % 5 = 1", "id % 5 = 0"))
    net = NN.fit(train, held, ["a", "b", "c"], "late", ["id"], SMALL, tasks=3)
    best = int(np.argmin(net.losses))
    assert len(net.losses) == 30 or len(net.losses) == best + 1 + SMALL.patience
    scores = NN.predict(net, test, ["id", "late"]).withColumn("model", F.lit("n"))
    assert M.auc(scores, "late", "probability", "model").first()["auc"] > 0.85
    NN.save(net, spark, str(tmp_path / "net"))
    again = NN.load(spark, str(tmp_path / "net"), SMALL)
    assert (again.state == net.state).all()
    with pytest.raises(ValueError):
        NN.load(spark, str(tmp_path / "net"))


def test_network_on_odd_rows(spark):
    rows = [(i, None, float("nan"), 1.0, i % 2) for i in range(5)] + [(9, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    s = dataclasses.replace(SMALL, rounds=2)
    for train in (df, df.limit(0), df.where("id = 1")):
        net = NN.fit(train, df, ["a", "b", "c"], "late", ["id"], s, tasks=2)
        p = [r["probability"] for r in NN.predict(net, df, ["id"]).collect()]
        assert len(p) == 6 and all(0 < v < 1 for v in p)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    assert [NN.tasks_for(n, 4) for n in (0, 800_000, 800_001, 29_000_000)] == [4, 4, 5, 145]
    monkeypatch.setattr(NN, "TASK_ROWS", 20)
    seen = []
    monkeypatch.setattr(NN, "pinned", lambda df, label: seen.append(df.rdd.getNumPartitions()) or pinned(df, label))
    df = spark.createDataFrame(made(90), SCHEMA)
    NN.fit(df, df, ["a", "b", "c"], "late", ["id"], dataclasses.replace(SMALL, rounds=1), tasks=2)
    assert seen[0] == 5


def test_rows_are_stored_in_blocks(spark):
    """A pass gets a stored row for each block, not one for each row."""
    rows = made(700)
    df = spark.createDataFrame([*rows, (700, 1.0, 1.0, 1.0, None)], SCHEMA).coalesce(1)
    cuts = BO.cuts_of(df, ["a", "b", "c"], 256)
    blocks = BO.binned(df, ["a", "b", "c"], "late", ["id"], cuts).collect()
    assert [b.n for b in blocks] == [256, 256, 188] and sum(b.positive for b in blocks) == sum(r[4] for r in rows)
    whole = lambda name, kind: np.concatenate([np.frombuffer(b[name], kind) for b in blocks])
    for k, c in enumerate(cuts):
        assert (whole(f"bin_{k}", np.int16) == np.searchsorted(c, [r[1 + k] for r in rows])).all()
    assert (whole("label", np.float64) == [r[4] for r in rows]).all() and len(set(whole("row", np.int64))) == 700


def test_explained_rows_carry_their_scores(spark, tmp_path):
    """Scores and contributions meet without a join; equal line items count apart, and one without a feature has no contributions."""
    lines = [(i // 4, i % 4, float(i % 50 + 1), i % 11 / 100, i % 9 / 100) for i in range(600)]
    lines += lines[:40] + [(1000 + i, 1, None, 0.05, 0.08) for i in range(200)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    test = TP._split(spark, str(tmp_path))[1]
    found = TP.boosted_trees_explained(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = test.where("quantity IS NOT NULL").count()
    assert 0 < whole < test.count() and tuple(found.first()) == (test.count(), whole)
