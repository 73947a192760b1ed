import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from waylark.operators import drift as DR


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame(list(zip(*cols.values())), ", ".join(
        f"{n} {'string' if any(isinstance(v, str) for v in cols[n]) else 'double'}" for n in names))


def numpy_psi(ref, cur, bins=10):
    """The definition, on arrays in memory."""
    if ref.std() == 0:
        return 0.0
    edges = np.linspace(ref.min(), ref.max(), bins + 1)
    edges[0], edges[-1] = edges[0] - 1e-9, edges[-1] + 1e-9
    shares = []
    for x in (ref, cur):
        n = np.histogram(x, bins=edges)[0]
        s = n / (n.sum() + 1e-6)
        shares.append(np.where(s == 0, 1e-6, s))
    return float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))


def test_psi_with_batch_out_of_range_and_empty_bins(spark):
    rnd = random.Random(1)
    ref = [rnd.gauss(0, 1) for _ in range(400)]
    cur = [rnd.gauss(0.4, 1.5) for _ in range(300)] + [50.0] * 20
    got = DR.psi(frame(spark, x=ref), frame(spark, x=cur), ["x"]).first()
    assert got.psi == pytest.approx(numpy_psi(np.array(ref), np.array(cur)), abs=1e-9)


def test_psi_of_itself_and_of_a_constant(spark):
    x = [float(i % 17) for i in range(200)]
    got = DR.psi(frame(spark, x=x, k=[3.0] * 200), frame(spark, x=x, k=x), ["x", "k"])
    assert rows(got.select("feature", F.round("psi", 12))) == [("k", 0.0), ("x", 0.0)]


def test_ks(spark):
    rnd = random.Random(2)
    ref = [round(rnd.gauss(0, 1), 1) for _ in range(300)]
    cur = [round(rnd.gauss(0.3, 1), 1) for _ in range(200)]
    values = sorted({*ref, *cur})
    want = max(abs(sum(r <= v for r in ref) / 300 - sum(c <= v for c in cur) / 200) for v in values)
    got = DR.ks_2samp(frame(spark, x=ref), frame(spark, x=cur), ["x"]).first()
    assert got.ks_stat == pytest.approx(want, abs=1e-12)
    assert (got.n_ref, got.n_cur) == (300, 200)
    same = DR.ks_2samp(frame(spark, x=ref), frame(spark, x=ref), ["x"]).first()
    assert (same.ks_stat, same.ks_pvalue) == (0.0, 1.0)


def test_categories(spark):
    ref = frame(spark, a=["x"] * 60 + ["y"] * 40, b=["k"] * 100)
    cur = frame(spark, a=["x"] * 20 + ["y"] * 20 + ["new"] * 10, b=["k"] * 50)
    got = {r.feature: r for r in DR.categorical_drift(ref, cur, ["a", "b"]).collect()}
    assert got["a"].chi2 == pytest.approx(16 / 24 + 16 / 16)
    assert (got["a"].df, got["a"].n_new_categories, got["a"].n_new_rows) == (1, 1, 10)
    assert got["a"].pvalue == pytest.approx(math.erfc(math.sqrt((16 / 24 + 1) / 2)))
    assert (got["b"].chi2, got["b"].pvalue, got["b"].drift) == (0.0, 1.0, False)


def test_label_change_of_exactly_five_points_is_no_alert(spark):
    ref = frame(spark, is_delayed=[1.0] * 50 + [0.0] * 50)
    assert DR.label_drift(ref, frame(spark, is_delayed=[1.0] * 56 + [0.0] * 44)).first().alert is True
    assert DR.label_drift(ref, frame(spark, is_delayed=[1.0] * 52 + [0.0] * 48)).first().alert is False


def test_report(spark):
    rnd = random.Random(4)
    ref = frame(spark, price=[rnd.random() for _ in range(100)], duration=[1.0] * 96 + [None] * 4,
                airline=["AA"] * 100, is_delayed=[0.0] * 100)
    cur = frame(spark, price=[rnd.random() + 0.5 for _ in range(100)], duration=[1.0] * 4 + [None] * 96,
                airline=["AA"] * 100, is_delayed=[0.0] * 100)
    rep = DR.drift_report(ref, cur)
    assert set(rep) == {"numeric", "summary", "categorical", "label"}
    assert rows(rep["numeric"].select("feature", "severity", "ks_drift")) == [("price", "CRITICAL", True)]
    s = rep["summary"].first()
    assert (s.critical_features, s.n_critical, s.n_warning, s.retrain_recommended) == (["price"], 1, 0, True)


def test_nan_is_no_value(spark):
    plain = spark.createDataFrame([(float(k),) for k in range(10)], "x double")
    dirty = plain.unionByName(spark.createDataFrame([(float("nan"),)] * 3, "x double"))
    for a, b in ((plain, dirty), (dirty, plain)):
        assert abs(DR.psi(a, b, ["x"]).first().psi) < 1e-9
        assert DR.ks_2samp(a, b, ["x"]).first().ks_stat == 0.0
