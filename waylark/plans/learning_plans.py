"""Training sets, encoders, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators import bundle as B
from waylark.operators import features as FE
from waylark.operators import models as M
from waylark.operators import ordered as O
from waylark.plans import domain as D
from waylark.plans import weather_plans as WP
from waylark.plans.domain import views
from waylark.plans.registry import query
from waylark.session import new_shared_path, pinned

_RATE = """count(*) AS n_flights, sum(is_delayed)::BIGINT AS n_delayed, round(100.0::DOUBLE * sum(is_delayed) / count(*), 6) AS delay_pct"""


@query("delay_label_rate", f"WITH {views('obs_flights')} SELECT {_RATE} FROM obs_flights")
def delay_label_rate(spark, sf):
    return FE.delay_rate(D.obs_flights(spark, sf)).withColumn("delay_pct", F.round("delay_pct", 6))


@query("delay_rate_by_carrier", f"WITH {views('obs_flights')} SELECT airline, {_RATE} FROM obs_flights GROUP BY 1")
def delay_rate_by_carrier(spark, sf):
    return FE.delay_rate(D.obs_flights(spark, sf), by=["airline"]).withColumn("delay_pct", F.round("delay_pct", 6))


@query("class_stats", f"""
WITH {views('obs_flights')}
SELECT count(*) AS n_rows, count(*) FILTER (is_delayed = 0) AS n_negative, count(*) FILTER (is_delayed = 1) AS n_positive,
       round(avg(is_delayed), 6) AS positive_rate,
       round(count(*) FILTER (is_delayed = 0) / count(*) FILTER (is_delayed = 1), 6) AS positive_weight FROM obs_flights""")
def class_stats(spark, sf):
    return FE.class_stats(D.obs_flights(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("positive_rate", "positive_weight")})


@query("value_counts", f"""
WITH {views('obs_flights')}
SELECT airline, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM obs_flights GROUP BY 1""")
def value_counts(spark, sf):
    return FE.value_counts(D.obs_flights(spark, sf), "airline").withColumn("share", F.round("share", 6))


_MEDIAN_COLS = ["distance", *FE.WEATHER_NUMBERS]


@query("exact_medians", f"WITH {views('flights_with_weather')} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median({c}) AS median FROM flights_with_weather" for c in _MEDIAN_COLS))
def exact_medians(spark, sf):
    return O.exact_medians(pinned(D.flights_with_weather(spark, sf).select(*_MEDIAN_COLS), "numbers"), _MEDIAN_COLS)


# A number as text, with words, NaN and nulls among them.
_DIRTY = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'abc' WHEN l_partkey % 11 = 0 THEN 'NaN'
       WHEN l_partkey % 13 <> 0 THEN l_quantity::VARCHAR END AS quantity,
       CASE WHEN l_suppkey % 4 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS price FROM lineitem"""


def dirty_numbers(spark, sf):
    part = F.col("l_partkey")
    text = F.when(part % 7 == 0, "abc").when(part % 11 == 0, "NaN").when(part % 13 != 0, F.col("l_quantity").cast("string"))
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("quantity"),
        F.when(F.col("l_suppkey") % 4 == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("price"))


_CLEAN = """clean AS (SELECT l_orderkey, l_linenumber, CASE WHEN NOT isnan(try_cast(quantity AS DOUBLE)) THEN try_cast(quantity AS DOUBLE) END AS quantity,
       CASE WHEN NOT isnan(price) THEN price END AS price FROM dirty)"""


@query("medians_of_dirty_numbers", f"""
WITH dirty AS ({_DIRTY}), {_CLEAN}
SELECT 'quantity' AS feature, median(quantity) AS median FROM clean UNION ALL SELECT 'price', median(price) FROM clean""")
def medians_of_dirty_numbers(spark, sf):
    return O.exact_medians(dirty_numbers(spark, sf), ["quantity", "price"])


@query("impute_dirty_numbers", f"""
WITH dirty AS ({_DIRTY}), {_CLEAN}, m AS (SELECT median(quantity) AS q, median(price) AS p FROM clean)
SELECT l_orderkey, l_linenumber, coalesce(quantity, q) AS quantity, coalesce(price, p) AS price FROM clean, m""")
def impute_dirty_numbers(spark, sf):
    d = dirty_numbers(spark, sf)
    return FE.apply_imputer(d, FE.fit_imputer(d, ["quantity", "price"]))


@query("median_impute", f"""
WITH {views('obs_flights')}, m AS (SELECT median(distance) AS d FROM obs_flights)
SELECT l_orderkey, l_linenumber, coalesce(distance, d) AS distance FROM obs_flights, m""")
def median_impute(spark, sf):
    f = D.obs_flights(spark, sf).select("l_orderkey", "l_linenumber", "distance")
    return FE.apply_imputer(f, FE.fit_imputer(f, ["distance"]))


@query("category_codes", f"WITH {views('obs_flights')} " + " UNION ALL ".join(
    f"""SELECT '{out}' AS feature, v AS value, (row_number() OVER (ORDER BY v) - 1)::INT AS code
        FROM (SELECT DISTINCT {src} AS v FROM obs_flights)"""
    for src, out in (("airline", "airline"), ("origin", "origin"), ("dest", "dest"))))
def category_codes(spark, sf):
    return FE.fit_category_codes(D.obs_flights(spark, sf), ["airline", "origin", "dest"])


def fitted_inputs(flights):
    """Category codes and medians of the flights."""
    named = flights.select("airline", F.col("origin").alias("departure_airport_code"), F.col("dest").alias("arrival_airport_code"))
    codes = pinned(FE.fit_category_codes(named, list(FE.CATEGORIES)), "codes")
    return codes, FE.fit_imputer(flights, _MEDIAN_COLS)


def training_set(spark, sf, keep=None):
    f = pinned(D.flights_with_weather(spark, sf), "enriched-flights")
    codes, fills = fitted_inputs(f)
    return FE.training_features(f, fills, codes, keep)


_RISK = """CASE WHEN {c} IN (51, 53, 61, 80) THEN 1 WHEN {c} IN (45, 48, 55, 63, 65, 71, 73, 81, 82) THEN 2
           WHEN {c} IN (75, 95, 96, 99) THEN 3 ELSE 0 END::DOUBLE"""

_TRAIN = f"""
WITH {views('flights_with_weather')},
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _MEDIAN_COLS)} FROM flights_with_weather),
ca AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT airline AS v FROM obs_flights)),
co AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT origin AS v FROM obs_flights)),
cd AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT dest AS v FROM obs_flights)),
train AS (
  SELECT l_orderkey, l_linenumber, airline, origin AS departure_airport_code, dest AS arrival_airport_code,
         duration, 0.0::DOUBLE AS layover_duration, duration AS total_journey_duration, 200.0::DOUBLE AS price,
         h::DOUBLE AS hour_of_day, (isodow(flight_date) - 1)::DOUBLE AS day_of_week, 0.0::DOUBLE AS pos,
         0.0::DOUBLE AS is_best, CASE WHEN h >= 21 OR h <= 5 THEN 1 ELSE 0 END::DOUBLE AS is_overnight,
         0.0::DOUBLE AS has_layover, ca.code::DOUBLE AS airline_code, co.code::DOUBLE AS dep_airport_code,
         cd.code::DOUBLE AS arr_airport_code,
         {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FE.WEATHER_NUMBERS)},
         coalesce(weather_code, 0)::DOUBLE AS weather_code,
         {_RISK.format(c="coalesce(weather_code, 0)")} AS weather_risk_score, is_delayed::DOUBLE AS is_delayed
  FROM (SELECT *, CASE WHEN crs_dep_time IS NULL THEN 12 ELSE least(23, crs_dep_time // 100) END AS h,
               round_even(coalesce(distance, (SELECT m_distance FROM m)) / 7.0::DOUBLE, 0) AS duration
        FROM flights_with_weather) f, m
       JOIN ca ON TRUE JOIN co ON TRUE JOIN cd ON TRUE
  WHERE ca.v = airline AND co.v = origin AND cd.v = dest)"""


@query("training_features", _TRAIN + " SELECT * FROM train")
def training_features(spark, sf):
    return training_set(spark, sf, ["l_orderkey", "l_linenumber"])


@query("standardise", _TRAIN + """, s AS (
  SELECT avg(duration) AS md, stddev_pop(duration) AS sd, avg(temperature_c) AS mt, stddev_pop(temperature_c) AS st,
         avg(hour_of_day) AS mh, stddev_pop(hour_of_day) AS sh FROM train)
SELECT l_orderkey, l_linenumber, round((duration - md) / sd, 6) AS duration, round((temperature_c - mt) / st, 6) AS temperature_c,
       round((hour_of_day - mh) / sh, 6) AS hour_of_day FROM train, s""")
def standardise(spark, sf):
    cols = ["duration", "temperature_c", "hour_of_day"]
    t = training_set(spark, sf, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", *cols)
    return FE.apply_scaler(t, FE.fit_scaler(t, cols)).withColumns({c: F.round(c, 6) for c in cols})


def serving_set(spark, sf):
    s = WP.cascaded(spark, sf)
    known = D.obs_flights(spark, sf).filter("airline <> 'C3'").select(
        "airline", F.col("origin").alias("departure_airport_code"), F.col("dest").alias("arrival_airport_code"))
    codes = pinned(FE.fit_category_codes(known, list(FE.CATEGORIES)), "codes")
    return FE.serving_features(s, codes, ["journey_sk", F.col("pos").alias("leg")])


_SERVE = f"""
WITH {views('lines', 'weather_hourly', 'obs_flights')}, {WP.CASCADE_SQL},
known AS (SELECT * FROM obs_flights WHERE airline <> 'C3'),
ca AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT airline AS v FROM known)),
co AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT origin AS v FROM known)),
cd AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT dest AS v FROM known)),
serve AS (
  SELECT journey_sk, pos AS leg, duration::DOUBLE AS duration, coalesce(layover_duration, 0)::DOUBLE AS layover_duration,
         coalesce(total_journey_duration, 0)::DOUBLE AS total_journey_duration, coalesce(price, 0.0::DOUBLE) AS price,
         hour(departure_airport_time)::DOUBLE AS hour_of_day, (isodow(departure_airport_time) - 1)::DOUBLE AS day_of_week,
         pos::DOUBLE AS pos, CASE WHEN is_best THEN 1 ELSE 0 END::DOUBLE AS is_best,
         CASE WHEN hour(departure_airport_time) >= 21 OR hour(departure_airport_time) <= 5 THEN 1 ELSE 0 END::DOUBLE AS is_overnight,
         CASE WHEN coalesce(layover_duration, 0) > 0 THEN 1 ELSE 0 END::DOUBLE AS has_layover,
         coalesce(ca.code, -1)::DOUBLE AS airline_code, coalesce(co.code, -1)::DOUBLE AS dep_airport_code,
         coalesce(cd.code, -1)::DOUBLE AS arr_airport_code, temperature_c, precipitation_mm,
         weather_code::DOUBLE AS weather_code, wind_speed_kmh, visibility_m, snowfall_cm,
         {_RISK.format(c="weather_code")} AS weather_risk_score
  FROM cascade LEFT JOIN ca ON ca.v = airline LEFT JOIN co ON co.v = departure_airport_code
       LEFT JOIN cd ON cd.v = arrival_airport_code)"""


@query("carrier_codes", """
SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN left(c_mktsegment, 2) ELSE c_mktsegment END AS airline,
       count(*) AS n FROM customer GROUP BY 1""")
def carrier_codes(spark, sf):
    """Names translated where the carrier list knows them (case and blanks ignored)."""
    c = D.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("airline"))
    carriers = c.distinct().filter("airline IN ('BUILDING', 'AUTOMOBILE')").select(
        F.concat(F.lower("airline"), F.lit(" ")).alias("name"), F.substring("airline", 1, 2).alias("code"))
    return FE.with_carrier_codes(c, carriers).groupBy("airline").agg(F.count(F.lit(1)).alias("n"))


@query("serving_features", _SERVE + " SELECT * FROM serve")
def serving_features(spark, sf):
    return serving_set(spark, sf)


def _bucket_sql(*cols):
    """`features.split_bucket` in SQL."""
    parts = " || '|' || ".join(f"coalesce({c}::VARCHAR, '')" for c in cols)
    return f"('0x' || left(md5({parts} || '|42'), 8))::BIGINT % 10000"


@query("stratified_split_counts", f"""
WITH {views('obs_flights')}
SELECT is_delayed, {_bucket_sql("l_orderkey", "l_linenumber", "is_delayed")} < 2000 AS is_test, count(*) AS n FROM obs_flights GROUP BY ALL""")
def stratified_split_counts(spark, sf):
    f = D.obs_flights(spark, sf)
    split = FE.stratified_split(f, "is_delayed", ["l_orderkey", "l_linenumber"])
    return split.groupBy("is_delayed", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("exact_split_counts", f"""
WITH {views('obs_flights')}, r AS (
  SELECT is_delayed, l_linenumber, row_number() OVER (PARTITION BY is_delayed ORDER BY
           ('0x' || left(md5(coalesce(l_orderkey::VARCHAR, '') || '|' || coalesce(l_linenumber::VARCHAR, '') || '|' || coalesce(is_delayed::VARCHAR, '') || '|42'), 8))::BIGINT,
           l_orderkey, l_linenumber) <= floor(count(*) OVER (PARTITION BY is_delayed) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test, l_orderkey FROM obs_flights)
SELECT is_delayed, is_test, count(*) AS n, sum(l_orderkey * 8 + l_linenumber)::BIGINT AS key_sum FROM r GROUP BY ALL""")
def exact_split_counts(spark, sf):
    """A fifth of each class, to the row; the sum of keys tells that they are the same rows."""
    f = pinned(D.obs_flights(spark, sf).select("l_orderkey", "l_linenumber", "is_delayed"), "flights")
    return FE.exact_split(f, "is_delayed", ["l_orderkey", "l_linenumber"]).groupBy("is_delayed", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("key_sum"))


@query("temporal_split", f"""
WITH {views('obs_flights')}
SELECT flight_date >= DATE '2024-01-21' AS is_test, count(*) AS n, sum(is_delayed)::BIGINT AS n_delayed FROM obs_flights GROUP BY 1""")
def temporal_split(spark, sf):
    f = FE.temporal_split(D.obs_flights(spark, sf), "flight_date", "2024-01-21")
    return f.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("is_delayed").alias("n_delayed"))


# --- evaluation on a deterministic stand-in score --------------------------------

def scored(spark, sf):
    """Two stand-in models on the observed flights: one coarse, one nearly continuous."""
    f = D.obs_flights(spark, sf).select(
        "l_orderkey", "l_linenumber", "is_delayed",
        F.array(
            F.struct(F.lit("boosted_trees").alias("model"),
                     (F.col("crs_arr_time") % 100 / 60.0).alias("p")),
            F.struct(F.lit("neural_network").alias("model"),
                     ((F.col("l_orderkey") * 31 + F.col("crs_arr_time")) % 9973 / 9973.0).alias("p")),
        ).alias("runs"))
    return f.select("l_orderkey", "l_linenumber", "is_delayed", F.inline("runs"))


_SCORED = f"""
WITH {views('obs_flights')}, scored AS (
  SELECT l_orderkey, l_linenumber, is_delayed, 'boosted_trees' AS model, (crs_arr_time % 100) / 60.0::DOUBLE AS p FROM obs_flights
  UNION ALL
  SELECT l_orderkey, l_linenumber, is_delayed, 'neural_network', ((l_orderkey * 31 + crs_arr_time) % 9973) / 9973.0::DOUBLE FROM obs_flights)"""

_AUC = """, g AS (SELECT model, p, sum(is_delayed) AS pos, sum(1 - is_delayed) AS neg FROM scored GROUP BY ALL),
r AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY p) - neg AS below FROM g),
aucs AS (SELECT model, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc,
                sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative FROM r GROUP BY 1)"""


@query("auc_exact", _SCORED + _AUC + " SELECT model, round(auc, 9) AS auc, n_positive, n_negative FROM aucs")
def auc_exact(spark, sf):
    return M.auc(scored(spark, sf), "is_delayed", "p", "model").withColumn("auc", F.round("auc", 9))


@query("roc_points", _SCORED + """
SELECT model, p AS threshold, round(sum(fp) OVER w / sum(fp) OVER (PARTITION BY model), 9) AS fpr,
       round(sum(tp) OVER w / sum(tp) OVER (PARTITION BY model), 9) AS tpr
FROM (SELECT model, p, sum(is_delayed)::DOUBLE AS tp, sum(1 - is_delayed)::DOUBLE AS fp FROM scored GROUP BY ALL)
WINDOW w AS (PARTITION BY model ORDER BY p DESC)""")
def roc_points(spark, sf):
    return M.roc_points(scored(spark, sf), "is_delayed", "p", "model").withColumns(
        {c: F.round(c, 9) for c in ("fpr", "tpr")})


_CONFUSION = """, c AS (SELECT model, count(*) FILTER (is_delayed = 1 AND p >= 0.5) AS tp, count(*) FILTER (is_delayed = 0 AND p >= 0.5) AS fp,
       count(*) FILTER (is_delayed = 1 AND p < 0.5) AS fn, count(*) FILTER (is_delayed = 0 AND p < 0.5) AS tn FROM scored GROUP BY 1),
x AS (SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
             round(tp / (tp + fn), 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM c)"""


@query("confusion_matrix", _SCORED + _CONFUSION + " SELECT * FROM x")
def confusion_matrix(spark, sf):
    d = scored(spark, sf).withColumn("hit", F.col("p") >= 0.5)
    return M.confusion(d, "is_delayed", "hit", ["model"]).withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query("select_model", _SCORED + _AUC + _CONFUSION + """
SELECT model, accuracy, f1, round(auc, 9) AS auc FROM x JOIN aucs USING (model)
ORDER BY auc DESC, model LIMIT 1""")
def select_model(spark, sf):
    m = M.evaluate(scored(spark, sf), "is_delayed", "p", "model").select("model", "accuracy", "f1", "auc")
    return M.select_model(m).withColumns({c: F.round(c, 9) for c in ("accuracy", "f1", "auc")})


@query("latest_versions", """
SELECT o_orderpriority AS model, arg_max(o_orderkey, v) AS run_id, max(v)::VARCHAR AS version
FROM (SELECT o_orderpriority, o_orderkey, o_orderkey % 100000 AS v FROM orders) GROUP BY 1""")
def latest_versions(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("run_id"),
        (F.col("o_orderkey") % 100000).cast("string").alias("version"))
    return M.latest_versions(o)


@query("score_journeys_worst", f"""
WITH {views('legs')}
SELECT journey_sk, CASE WHEN every THEN round(worst, 4) END AS delay_probability,
       CASE WHEN every THEN worst >= 0.5 END AS delay_prediction, 'boosted_trees' AS model_used, n AS n_segments
FROM (SELECT journey_sk, max(duration / 3100.0::DOUBLE) AS worst, bool_and(layover_duration IS NULL OR layover_duration <> 77) AS every,
             count(*) AS n FROM legs GROUP BY 1)""")
def score_journeys_worst(spark, sf):
    """The score stands in for a model; legs with a 77 minute stop count as unscorable."""
    unscorable = F.coalesce(F.col("layover_duration") == 77, F.lit(False))
    s = D.legs(spark, sf).withColumn("probability", F.when(~unscorable, F.col("duration") / 3100.0))
    return M.score_journeys(s, "journey_sk", "boosted_trees")


@query("selection_history", _SCORED + _AUC + _CONFUSION + """, m AS (
  SELECT model, accuracy, f1, round(auc, 9) AS auc FROM x JOIN aucs USING (model))
SELECT m.*, rank() OVER (ORDER BY auc DESC, model) = 1 AS promoted, TIMESTAMP '2024-02-01' AS evaluated_at,
       CASE WHEN rank() OVER (ORDER BY auc DESC, model) = 1 THEN TIMESTAMP '2024-02-01' END AS promoted_at FROM m
UNION ALL SELECT model, 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, FALSE, TIMESTAMP '2024-01-01', NULL FROM m""")
def selection_history(spark, sf):
    """The runs of this round behind those of an earlier one."""
    m = M.evaluate(scored(spark, sf), "is_delayed", "p", "model").select(
        "model", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "auc")])
    m = pinned(m, "metrics")
    earlier = m.select(
        "model", *[F.lit(0.5).alias(c) for c in ("accuracy", "f1", "auc")], F.lit(False).alias("promoted"),
        S.local_ts("2024-01-01").alias("evaluated_at"), F.lit(None).cast("timestamp_ntz").alias("promoted_at"))
    return M.selection_history(m, S.local_ts("2024-02-01"), earlier)


# --- trained models ------------------------------------------------------------------
# Training has no SQL form. What SQL can say about it is compared: how many rows were
# tested, that all numbers are in their range, which features must be without use. This
# does not prove that a model is good; the metrics themselves come from `evaluate`, which
# is compared above on a stand-in score.

_TRAIN_KEY = ["l_orderkey", "l_linenumber"]
_BUNDLES: dict[tuple[str, str], str] = {}
_TRAINING: dict[tuple[str, str], tuple] = {}


def _prepared(spark, sf):
    """The training set, stored once per session, the codes and the medians it was made with."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINING:
        f = pinned(D.flights_with_weather(spark, sf), "enriched-flights")
        codes, fills = fitted_inputs(f)
        _TRAINING[key] = pinned(FE.training_features(f, fills, codes, _TRAIN_KEY), "training"), codes, fills
    return _TRAINING[key]


def split_sets(spark, sf):
    t, _, _ = _prepared(spark, sf)
    both = FE.stratified_split(t, FE.LABEL_COL, [*_TRAIN_KEY, "duration"])
    return both.filter("NOT is_test"), both.filter("is_test")


def fitted(spark, sf):
    """Both models, fitted with the published settings once per session, stored and loaded."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUNDLES:
        _, codes, fills = _prepared(spark, sf)
        train = split_sets(spark, sf)[0]
        path = new_shared_path(spark, "bundle")
        B.save(B.fit(train, codes, fills, _TRAIN_KEY), path)
        _BUNDLES[key] = path
    return B.load(spark, _BUNDLES[key])


_SPLIT = _bucket_sql("l_orderkey", "l_linenumber", "duration", "is_delayed")


def _in_range(*cols):
    return F.bool_and(sum((F.when(F.col(c).between(0.0, 1.0), 0).otherwise(1) for c in cols), F.lit(0)) == 0)


@query("model_eval", _TRAIN + f"""
SELECT model, count(*) AS n_rows, count(*) FILTER (is_delayed = 1) AS n_positive, TRUE AS in_range
FROM train, (VALUES ('boosted_trees'), ('neural_network')) m(model) WHERE {_SPLIT} < 2000 GROUP BY 1""")
def model_eval(spark, sf):
    """Trees and network on the same test rows."""
    bundle, (_, test) = fitted(spark, sf), split_sets(spark, sf)
    keep = [*_TRAIN_KEY, FE.LABEL_COL]
    runs = [bundle.score(test, m, keep).withColumn("model", F.lit(m)) for m in M.PREFERENCE]
    rows = pinned(runs[0].unionByName(runs[1]), "scored")
    metrics = M.evaluate(rows, FE.LABEL_COL, "probability", "model").groupBy("model").agg(
        _in_range("accuracy", "f1", "auc").alias("_metrics"))
    counts = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(FE.LABEL_COL) == 1, 1)).alias("n_positive"),
        _in_range("probability").alias("_rows"))
    return counts.join(metrics, "model").select("model", "n_rows", "n_positive", (F.col("_rows") & F.col("_metrics")).alias("in_range"))


# Features that are the same in every training row can't be of use to a tree.
_CONSTANT = ["layover_duration", "price", "pos", "is_best", "has_layover"]


@query("feature_importance", "SELECT feature, TRUE AS in_range, feature IN ("
       + ", ".join(f"'{c}'" for c in _CONSTANT) + ") AS must_be_unused, 1.0::DOUBLE AS total FROM (VALUES "
       + ", ".join(f"('{c}')" for c in FE.FEATURE_COLS) + ") v(feature)")
def feature_importance(spark, sf):
    found = pinned(M.feature_importance(fitted(spark, sf).trees), "importance")
    total = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    constant = F.col("feature").isin(_CONSTANT)
    return found.crossJoin(F.broadcast(total)).select(
        "feature", F.col("importance").between(0.0, 1.0).alias("in_range"),
        (constant & (F.col("importance") == 0.0)).alias("must_be_unused"), "total")


@query("score_segments", _SERVE + """
SELECT journey_sk, count(*) AS n_segments, 'boosted_trees' AS model_used, TRUE AS in_range, TRUE AS consistent FROM serve GROUP BY 1""")
def score_segments(spark, sf):
    """Trees trained on observed flights, applied to served segments, worst leg per journey."""
    bundle = fitted(spark, sf)
    rows = B.features_of(bundle, WP.cascaded(spark, sf), ["journey_sk", F.col("pos").alias("leg")])
    out = M.score_journeys(bundle.score(rows, "boosted_trees", ["journey_sk", "leg"]), "journey_sk", "boosted_trees")
    p = F.col("delay_probability")
    # The decision is made on the unrounded value.
    agrees = (F.col("delay_prediction") == (p >= M.DECISION_THRESHOLD)) | (F.abs(p - M.DECISION_THRESHOLD) < 1e-4)
    return out.select("journey_sk", "n_segments", "model_used", p.between(0.0, 1.0).alias("in_range"), agrees.alias("consistent"))


@query("bundle_round_trip", _TRAIN + f"""
SELECT model, count(*) AS n_rows, 0::BIGINT AS n_different FROM train, (VALUES ('boosted_trees'), ('neural_network')) m(model)
WHERE {_SPLIT} < 2000 GROUP BY 1""")
def bundle_round_trip(spark, sf):
    """A bundle stored again and loaded scores every test row the same."""
    first, (_, test) = fitted(spark, sf), split_sets(spark, sf)
    path = new_shared_path(spark, "bundle-copy")
    B.save(first, path)
    second = B.load(spark, path)
    numbered = pinned(test.withColumn("row", F.monotonically_increasing_id()), "test")
    sizes = numbered.agg(F.count(F.lit(1)).alias("n_rows"))
    found = [B.differences(first, second, numbered, m, ["row"]).agg(F.count(F.lit(1)).alias("n_different")).withColumn("model", F.lit(m))
             for m in M.PREFERENCE]
    return found[0].unionByName(found[1]).crossJoin(F.broadcast(sizes)).select("model", "n_rows", "n_different")
