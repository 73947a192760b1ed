import random
import statistics

import pytest
from conftest import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from waylark.operators import features as FE
from waylark.operators import models as M
from waylark.operators import ordered as O


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice([None, rnd.gauss(0, 1), 0.25]), float(rnd.randrange(5))) for i in range(501)]
    return data, spark.createDataFrame(data, "id int, a double, b double")


def test_exact_medians(noisy):
    data, df = noisy
    got = {r.feature: r["median"] for r in O.exact_medians(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(statistics.median([a for _, a, _ in data if a is not None]))
    assert got["b"] == statistics.median([b for *_, b in data])


def test_running_totals_match_a_sort(spark):
    rnd = random.Random(5)
    values = [("g", round(rnd.gauss(0, 3), 1)) for _ in range(2000)] + [("h", 1.0)] * 1000  # one value holds a third
    df = spark.createDataFrame(values, "g string, v double")
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for desc in (False, True):
        got = {(r.g, r.v): (r.cum_n, r.tot_n) for r in O.running_totals(counted, "g", "v", ["n"], desc, 16).collect()}
        for (g, v), (cum, tot) in got.items():
            mine = [x for k, x in values if k == g]
            assert tot == len(mine)
            assert cum == sum(x >= v if desc else x <= v for x in mine)


def test_auc_agrees_with_the_evaluator(spark):
    rnd = random.Random(11)
    data = [("m", float(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame(data, "model string, y double, p double")
    mine = M.auc(df, "y", "p", "model").first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    assert mine == pytest.approx(theirs, abs=1e-9)
    points = M.roc_points(df, "y", "p", "model").orderBy("threshold").collect()
    assert points[0].fpr == points[0].tpr == 1.0


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("m", 1.0, 0.5)], "model string, y double, p double")
    assert M.auc(df, "y", "p", "model").first().auc is None


def test_codes_and_unknown(spark):
    df = spark.createDataFrame([("B", "x"), ("A", "y"), (None, "x"), ("A", "x")], "airline string, dest string")
    codes = FE.fit_category_codes(df, ["airline", "dest"])
    assert rows(codes) == [("airline", "A", 0), ("airline", "B", 1), ("dest", "x", 0), ("dest", "y", 1)]
    new = spark.createDataFrame([("B",), ("American",), (None,)], "airline string")
    assert rows(FE.encode(new, codes, {"airline": "c"})) == [("American", -1), ("B", 1), (None, -1)]


def test_training_and_serving_share_the_contract(spark):
    f = spark.createDataFrame(
        [("AA", "MIA", "ATL", 2130, "2025-06-15", 24.5, 30.0, None, None, 1.0, 2.0, None, 1),
         ("AA", "MIA", "ATL", None, "2025-06-16", None, None, 95, 1.0, None, None, 3.0, 0)],
        "airline string, origin string, dest string, crs_dep_time int, flight_date string, distance double, temperature_c double, "
        "weather_code int, precipitation_mm double, wind_speed_kmh double, visibility_m double, snowfall_cm double, is_delayed int"
    ).withColumn("flight_date", F.to_date("flight_date"))
    named = f.withColumnsRenamed({"origin": "departure_airport_code", "dest": "arrival_airport_code"})
    codes = FE.fit_category_codes(named, list(FE.CATEGORIES))
    fills = FE.fit_imputer(f, ["distance", *FE.WEATHER_NUMBERS])
    train = FE.training_features(f, fills, codes)
    a, b = train.orderBy("day_of_week").collect()[::-1]
    assert (a.hour_of_day, a.is_overnight, a.day_of_week, a.duration, a.weather_code) == (21.0, 1.0, 6.0, 4.0, 0.0)
    assert (b.hour_of_day, b.temperature_c, b.weather_risk_score, b.duration, b.price) == (12.0, 30.0, 3.0, 4.0, 200.0)
    seg = spark.createDataFrame(
        [("American", "MIA", "XXX", "2026-09-14 05:30:00", 100, None, None, 89.5, 1, True, None, None, None, None, None, 75)],
        "airline string, departure_airport_code string, arrival_airport_code string, departure_airport_time string, duration int, "
        "layover_duration int, total_journey_duration int, price double, pos int, is_best boolean, temperature_c double, "
        "precipitation_mm double, wind_speed_kmh double, visibility_m double, snowfall_cm double, weather_code int"
    ).withColumn("departure_airport_time", F.col("departure_airport_time").cast("timestamp_ntz"))
    serve = FE.serving_features(seg, codes)
    assert serve.columns == FE.FEATURE_COLS
    assert [c for c in train.columns if c in FE.FEATURE_COLS] == FE.FEATURE_COLS
    r = serve.first()
    assert (r.airline_code, r.dep_airport_code, r.arr_airport_code) == (-1.0, 0.0, -1.0)
    assert (r.visibility_m, r.weather_risk_score, r.is_overnight, r.total_journey_duration) == (10000.0, 3.0, 1.0, 0.0)


def test_split_is_stable_and_keeps_class_shares(spark):
    df = spark.range(20000).withColumn("y", F.when(F.col("id") % 4 == 0, 1).otherwise(0))
    s = FE.stratified_split(df, "y", ["id"])
    share = {r.y: r.s for r in s.groupBy("y").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect()}
    assert share[0] == pytest.approx(0.2, abs=0.02) and share[1] == pytest.approx(0.2, abs=0.02)
    again = FE.stratified_split(df.repartition(7), "y", ["id"])
    assert s.filter("is_test").select("id").exceptAll(again.filter("is_test").select("id")).count() == 0


def test_worst_segment_decides(spark):
    df = spark.createDataFrame([("j", 0.2), ("j", 0.50004), ("k", 0.1), ("k", None), ("l", 0.49996)], "j string, probability double")
    got = rows(M.score_journeys(df, "j", "boosted_trees").select("j", "delay_probability", "delay_prediction"))
    assert got == [("j", 0.5, True), ("k", None, None), ("l", 0.5, False)]


def test_selection(spark):
    m = spark.createDataFrame([("neural_network", 0.7), ("boosted_trees", 0.7)], "model string, auc double")
    assert M.select_model(m).first().model == "boosted_trees"
    better = m.withColumn("auc", F.when(F.col("model") == "neural_network", 0.8).otherwise(F.col("auc")))
    assert M.select_model(better).first().model == "neural_network"
    v = spark.createDataFrame([("t", "9", "a"), ("t", "10", "b")], "model string, version string, run string")
    assert rows(M.latest_versions(v)) == [("t", "10", "b")]


def test_models_learn_a_learnable_label(spark):
    df = spark.range(1500).select(
        "id", (F.xxhash64("id") % 1000 / 1000.0).alias("x"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("z"))
    df = df.withColumn("is_delayed", F.when(F.col("x") + 0.1 * F.col("z") > 0.5, 1.0).otherwise(0.0))
    s = FE.stratified_split(df, "is_delayed", ["id"]).cache()
    train, test = s.filter("NOT is_test"), s.filter("is_test")
    trees = M.fit_trees(train, ["x", "z"], maxIter=3, maxDepth=2)
    p = M.predict(trees, test, ["is_delayed"]).withColumn("model", F.lit("boosted_trees"))
    e = M.evaluate(p, "is_delayed", "probability", "model").first()
    assert e.auc > 0.9 and e.f1 > 0.7
    top = M.feature_importance(trees, ["x", "z"]).orderBy(F.desc("importance")).first()
    assert top.feature == "x"
    even = M.balanced(train, ["id"])
    share = even.agg(F.avg("is_delayed")).first()[0]
    assert share == pytest.approx(0.5, abs=0.05)
    net = M.fit_network(FE.apply_scaler(even, FE.fit_scaler(train, ["x", "z"])), ["x", "z"], layers=[2, 4, 2], rounds=30)
    q = M.predict(net, FE.apply_scaler(test, FE.fit_scaler(train, ["x", "z"])), ["is_delayed"]).withColumn("model", F.lit("n"))
    assert M.auc(q, "is_delayed", "probability", "model").first().auc > 0.9


def test_medians_leave_out_nan_and_text(spark):
    d = spark.createDataFrame([(1.0, "1"), (2.0, "abc"), (3.0, "NaN"), (float("nan"), None), (float("nan"), "3"), (None, "2")], "x double, t string")
    assert FE.fit_imputer(d, ["x", "t"]) == {"x": 2.0, "t": 2.0}


def test_a_bundle_is_loaded_as_it_was_stored(spark, tmp_path):
    from waylark.operators import bundle as B
    from waylark.operators import models as M

    rows = [(k, float(k % 2), *[float((k * (j + 3)) % 17) for j in range(len(FE.FEATURE_COLS))]) for k in range(60)]
    train = spark.createDataFrame(rows, ["id", FE.LABEL_COL, *FE.FEATURE_COLS])
    codes = spark.createDataFrame([("airline", "AA", 0)], "feature string, value string, code int")
    scaler = FE.fit_scaler(train, FE.FEATURE_COLS)
    first = B.Bundle(codes, {"distance": 7.0}, scaler, M.fit_trees(train, maxIter=2), M.fit_network(FE.apply_scaler(train, scaler), rounds=3))
    B.save(first, str(tmp_path / "b"))
    second = B.load(spark, str(tmp_path / "b"))
    assert (second.fills, second.scaler, second.codes.collect()) == (first.fills, first.scaler, codes.collect())
    for model in M.PREFERENCE:
        assert B.differences(first, second, train, model, ["id"]).count() == 0


def test_split_bucket_is_the_head_of_an_md5(spark):
    import hashlib

    d = spark.createDataFrame([(5, None, 1), (6, "x", 0)], "a int, b string, y int")
    got = [r[0] for r in d.select(FE.split_bucket(["a", "b"], "y")).collect()]
    assert got == [int(hashlib.md5(t).hexdigest()[:8], 16) % 10_000 for t in (b"5||1|42", b"6|x|0|42")]


def test_exact_medians_of_many_rows(spark):
    """More rows than the sketch holds exactly, even and odd counts, ties and a column of nulls."""
    d = spark.range(60_001).select(
        ((F.col("id") * 7919) % 60_001).cast("double").alias("x"), F.when(F.col("id") > 0, F.col("id") % 5).alias("few"),
        F.lit(None).cast("double").alias("none"))
    got = {r.feature: r["median"] for r in O.exact_medians(d, ["x", "few", "none"]).collect()}
    few = sorted(i % 5 for i in range(1, 60_001))
    assert got == {"x": 30_000.0, "few": (few[29_999] + few[30_000]) / 2}
    assert O.exact_medians(d.limit(0), ["x"]).count() == 0


def test_training_rows_are_spread_over_the_cores(spark, monkeypatch):
    """All rows of a single row group would be in one task of every pass."""
    one = spark.range(0, 1000, 1, 1).withColumn("x", F.rand(1))
    assert M.spread(one) is one
    monkeypatch.setattr(M, "SPREAD_ROWS", 100)
    got = M.spread(one)
    held = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 800 and rows(got) == rows(one)
