"""Exact split and exact p-values against enumeration."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from waylark.functions.pvalues import _ks_exact, kolmogorov_tail
from waylark.operators import drift
from waylark.operators import features as FE


@pytest.mark.parametrize("n, m", [(a, b) for a in range(1, 9) for b in range(a, 9) if a + b <= 14])
def test_ks_equals_enumeration(n, m):
    seen = {}
    for spots in itertools.combinations(range(n + m), n):
        i = j = top = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in spots else (i, j + 1)
            top = max(top, abs(i * m - j * n))
        seen[top] = seen.get(top, 0) + 1
    total = math.comb(n + m, n)
    for gap in seen:
        want = sum(c for g, c in seen.items() if g >= gap) / total
        assert _ks_exact(gap / (n * m), n, m) == pytest.approx(want, abs=1e-12)
        assert _ks_exact(gap / (n * m), m, n) == pytest.approx(want, abs=1e-12)


def test_ks_large_and_edges(spark):
    assert _ks_exact(0.0, 5, 5) == 1.0 and _ks_exact(1.0, 1, 1) == 1.0 and math.isnan(_ks_exact(0.5, 0, 3))
    row = spark.range(1).select(kolmogorov_tail(F.lit(0.03), F.lit(4000), F.lit(4000)).alias("p")).first()
    assert _ks_exact(0.03, 4000, 4000) == pytest.approx(row.p, rel=0.02)
    rnd = random.Random(1)
    ref = spark.createDataFrame([(rnd.random(),) for _ in range(7)], "a double")
    cur = spark.createDataFrame([(rnd.random() + 0.4,) for _ in range(6)], "a double")
    got = drift.ks_exact(ref, cur, ["a"]).first()
    assert got.ks_pvalue == pytest.approx(_ks_exact(got.ks_stat, 7, 6)) and 0 < got.ks_pvalue < 1


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_split_is_exact(spark, share):
    rows = [(i, c) for c, n in ((0, 301), (1, 48), (None, 7), (2, 1)) for i in range(n)] + [(5, 0)] * 3
    df = spark.createDataFrame(rows, "id int, y int")
    got = FE.exact_split(df, "y", ["id"], share).collect()
    assert sorted(map(repr, ((r.id, r.y) for r in got))) == sorted(map(repr, rows))
    for c in (0, 1, None, 2):
        n = sum(y == c for _, y in rows)
        assert sum(r.is_test for r in got if r.y == c) == math.floor(n * share + 0.5)
    mark = lambda i, y: (int(hashlib.md5(f"{i}|{'' if y is None else y}|42".encode()).hexdigest()[:8], 16), i)
    for c in (1, None):
        last = max((mark(r.id, r.y) for r in got if r.y == c and r.is_test), default=(-1, 0))
        assert all(mark(r.id, r.y) > last for r in got if r.y == c and not r.is_test)


def test_rows_of_a_class_are_not_brought_to_one_task(spark):
    df = spark.range(50).withColumn("y", F.col("id") % 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FE.exact_split(df, "y", ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [_class" in plan
