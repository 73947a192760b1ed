"""Drift between an earlier and a later part of the shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylark.operators import drift as DR
from waylark.plans import domain as D
from waylark.plans.domain import views
from waylark.plans.registry import query

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]

_LONG = f"WITH {views('drift_rows')}, long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, is_ref, {c}::DOUBLE AS v FROM drift_rows" for c in NUMERIC) + ")"

_PSI = _LONG + """, lim AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long WHERE is_ref GROUP BY 1),
binned AS (SELECT feature, is_ref, """ + " + ".join(
    f"CASE WHEN v >= {i}.0::DOUBLE * ((hi - lo) / 10.0::DOUBLE) + lo THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS bin,
    v BETWEEN lo - 1e-9::DOUBLE AND hi + 1e-9::DOUBLE AS inside FROM long JOIN lim USING (feature)),
tot AS (SELECT feature, count(*) FILTER (is_ref AND inside) AS r, count(*) FILTER (NOT is_ref AND inside) AS c FROM binned GROUP BY 1),
cells AS (SELECT feature, b AS bin FROM lim, range(10) t(b)),
cnt AS (SELECT feature, bin, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM binned WHERE inside GROUP BY ALL),
shares AS (SELECT cells.feature, CASE WHEN coalesce(cnt.r, 0) = 0 THEN 1e-6::DOUBLE ELSE cnt.r / (tot.r + 1e-6::DOUBLE) END AS r,
                  CASE WHEN coalesce(cnt.c, 0) = 0 THEN 1e-6::DOUBLE ELSE cnt.c / (tot.c + 1e-6::DOUBLE) END AS c
           FROM cells JOIN tot USING (feature) LEFT JOIN cnt ON cnt.feature = cells.feature AND cnt.bin = cells.bin),
psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM shares GROUP BY 1)"""

_KS = """, g AS (SELECT feature, v, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM long GROUP BY ALL),
k AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS gap, r, c
      FROM g WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT feature, max(gap) AS ks_stat, sum(r)::BIGINT AS n_ref, sum(c)::BIGINT AS n_cur FROM k GROUP BY 1),
ksp AS (SELECT *, ks_stat * ks_stat * (n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS lam2 FROM ks),
kst AS (SELECT feature, ks_stat, n_ref, n_cur, CASE WHEN lam2 < 0.02 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * j * j * lam2))))) END AS ks_pvalue FROM ksp)"""


@query("psi_numeric", _PSI + """
SELECT feature, round(psi, 5) AS psi, CASE WHEN psi < 0.1 THEN 'OK' WHEN psi < 0.2 THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM psi""")
def psi_numeric(spark, sf):
    p = DR.psi(*D.drift_sets(spark, sf), NUMERIC)
    return p.select("feature", F.round("psi", 5).alias("psi"), DR.psi_severity(F.col("psi")).alias("severity"))


@query("ks_statistic", _LONG + _KS + " SELECT feature, round(ks_stat, 9) AS ks_stat, n_ref, n_cur, round(ks_pvalue, 6) AS ks_pvalue FROM kst")
def ks_statistic(spark, sf):
    return DR.ks_2samp(*D.drift_sets(spark, sf), NUMERIC).withColumns(
        {"ks_stat": F.round("ks_stat", 9), "ks_pvalue": F.round("ks_pvalue", 6)})


def dirty_sets(spark, sf):
    """The same rows, some of whose numbers are NaN."""
    nan = lambda d: d.withColumn("l_quantity", F.when(F.col("l_discount") > 0.07, float("nan")).otherwise(F.col("l_quantity")))
    return tuple(nan(d) for d in D.drift_sets(spark, sf))


def _without_nan(sql):
    """SQL on the rows whose quantity is not made NaN."""
    return sql.replace("l_quantity::DOUBLE AS v FROM drift_rows", "l_quantity::DOUBLE AS v FROM drift_rows WHERE l_discount <= 0.07::DOUBLE")


@query("psi_with_nan", _without_nan(_PSI + " SELECT feature, round(psi, 5) AS psi FROM psi"))
def psi_with_nan(spark, sf):
    return DR.psi(*dirty_sets(spark, sf), NUMERIC).select("feature", F.round("psi", 5).alias("psi"))


@query("ks_with_nan", _without_nan(_LONG + _KS + " SELECT feature, round(ks_stat, 9) AS ks_stat, n_ref, n_cur FROM kst"))
def ks_with_nan(spark, sf):
    return DR.ks_2samp(*dirty_sets(spark, sf), NUMERIC).select("feature", F.round("ks_stat", 9).alias("ks_stat"), "n_ref", "n_cur")


@query("chi2_categorical", f"WITH {views('drift_rows')}, long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, is_ref FROM drift_rows" for c in CATEGORICAL) + """),
g AS (SELECT feature, v, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM long GROUP BY ALL),
t AS (SELECT feature, sum(r) AS tr, sum(c) FILTER (r > 0) AS tc, count(*) FILTER (r > 0) AS k FROM g GROUP BY 1)
SELECT feature, round(sum((c - r * tc / tr::DOUBLE) ** 2 / (r * tc / tr::DOUBLE)), 4) AS chi2, (any_value(k) - 1)::INT AS df
FROM g JOIN t USING (feature) WHERE r > 0 GROUP BY 1""")
def chi2_categorical(spark, sf):
    d = DR.categorical_drift(*D.drift_sets(spark, sf), CATEGORICAL, with_p=False)
    return d.select("feature", F.round("chi2", 4).alias("chi2"), "df")


# The tail of chi-square has closed forms: exp(-x / 2) for two degrees of freedom, and for
# one the complement of the error function, whose series is summed here.
_TAIL = """CASE df WHEN 2 THEN exp(-chi2 / 2) ELSE CASE WHEN chi2 > 50 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - sqrt(2.0::DOUBLE * chi2 / pi()) * exp(-chi2 / 2)
       * list_sum(list_transform(range(0, 150), lambda k: exp(k * ln(greatest(chi2, 1e-300::DOUBLE)) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2.0::DOUBLE * j + 1)))))) END END"""


@query("chi2_report", f"WITH {views('drift_rows')}, long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, is_ref FROM drift_rows" for c in CATEGORICAL) + f"""),
g AS (SELECT feature, v, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM long GROUP BY ALL),
t AS (SELECT feature, sum(r) AS tr, sum(c) FILTER (r > 0) AS tc, count(*) FILTER (r > 0) AS k,
             count(*) FILTER (r = 0) AS n_new_categories, coalesce(sum(c) FILTER (r = 0), 0)::BIGINT AS n_new_rows FROM g GROUP BY 1),
x AS (SELECT feature, sum((c - r * tc / tr::DOUBLE) ** 2 / (r * tc / tr::DOUBLE)) AS chi2, (any_value(k) - 1)::INT AS df,
             any_value(n_new_categories) AS n_new_categories, any_value(n_new_rows) AS n_new_rows
      FROM g JOIN t USING (feature) WHERE r > 0 GROUP BY 1)
SELECT feature, round(chi2, 4) AS chi2, df, n_new_categories, n_new_rows, round({_TAIL}, 6) AS pvalue, {_TAIL} < 0.05 AS drift FROM x""")
def chi2_report(spark, sf):
    d = DR.categorical_drift(*D.drift_sets(spark, sf), CATEGORICAL)
    return d.withColumns({"chi2": F.round("chi2", 4), "pvalue": F.round("pvalue", 6)})


@query("label_drift", f"""
WITH {views('drift_rows')}, x AS (SELECT avg(is_delayed) FILTER (is_ref) AS r, avg(is_delayed) FILTER (NOT is_ref) AS c FROM drift_rows)
SELECT round(r, 4) AS ref_delay_rate, round(c, 4) AS cur_delay_rate, round(abs(c - r), 4) AS delta, abs(c - r) > 0.05 AS alert FROM x""")
def label_drift(spark, sf):
    return DR.label_drift(*D.drift_sets(spark, sf))


_REPORT = _PSI + _KS + """, num AS (
  SELECT feature, round(psi, 5) AS psi, CASE WHEN psi < 0.1 THEN 'OK' WHEN psi < 0.2 THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
         round(ks_stat, 5) AS ks_stat, round(ks_pvalue, 5) AS ks_pvalue, ks_pvalue < 0.05 AS ks_drift
  FROM psi JOIN kst USING (feature))"""


@query("drift_numeric_report", _REPORT + " SELECT * FROM num")
def drift_numeric_report(spark, sf):
    return DR.drift_report(*D.drift_sets(spark, sf), numeric=[*NUMERIC, "not_there"])["numeric"]


@query("drift_summary", _REPORT + """
SELECT coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (severity = 'CRITICAL'), '') AS critical_features,
       count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'WARNING') AS n_warning,
       count(*) FILTER (severity = 'CRITICAL') >= 1 AS retrain_recommended FROM num""")
def drift_summary(spark, sf):
    s = DR.drift_report(*D.drift_sets(spark, sf), numeric=NUMERIC)["summary"]
    return s.withColumn("critical_features", F.array_join("critical_features", ","))
