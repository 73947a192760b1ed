"""Distribution drift between a reference set and a new batch.

All features of a kind are handled in one plan: columns are turned into
(feature, value) rows, counted map-side, and compared per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.functions.pvalues import chi2_tail, kolmogorov_tail, ks_tail
from waylark.operators.ordered import running_totals, unpivot

# Thresholds and floor of the stability index and the tests.
PSI_WARNING = 0.1
PSI_CRITICAL = 0.2
PSI_BINS = 10
PSI_EPS = 1e-6
EDGE_MARGIN = 1e-9
P_LIMIT = 0.05
LABEL_LIMIT = 0.05
MIN_VALUES = 5

# The features that are watched.
NUMERIC_FEATURES = [
    "duration", "layover_duration", "total_journey_duration", "price",
    "hour_of_day", "day_of_week",
    "temperature_c", "precipitation_mm", "wind_speed_kmh",
    "visibility_m", "snowfall_cm", "weather_risk_score",
]
CATEGORICAL_FEATURES = ["airline", "departure_airport_code", "arrival_airport_code"]


def shared_columns(ref: DataFrame, cur: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in ref.columns and c in cur.columns]


def _both(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(is_ref, feature, value) rows of both sides."""
    tag = lambda d, flag: unpivot(d.withColumn("is_ref", F.lit(flag)), cols, ["is_ref"])
    return tag(ref, True).unionByName(tag(cur, False))


def psi_severity(psi: Column) -> Column:
    return F.when(psi < PSI_WARNING, "OK").when(psi < PSI_CRITICAL, "WARNING").otherwise("CRITICAL")


def psi(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature.

    Equal-width bins over the reference range; batch values outside of it are
    dropped. A constant reference gives 0. (feature, n_ref, n_cur, psi)
    """
    limits = unpivot(ref, cols).groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = sum(
        (F.when(F.col("value") >= F.lit(float(i)) * step + F.col("lo"), 1).otherwise(0) for i in range(1, bins)),
        F.lit(0),
    )
    inside = F.col("value").between(F.col("lo") - EDGE_MARGIN, F.col("hi") + EDGE_MARGIN)
    # One row per feature on the right: bounded by the list of columns.
    placed = _both(ref, cur, cols).join(F.broadcast(limits), "feature").select(
        "feature", "is_ref", (F.col("hi") > F.col("lo")).alias("varies"),
        F.when(inside, slot).alias("slot"),
    )
    # A handful of rows per feature leave the map side; the rest works on those.
    cells = placed.groupBy("feature", "is_ref", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("varies").alias("varies")
    )
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_ref, slot_no = F.col("is_ref"), F.col("slot")
    here = slot_no.isNotNull()
    g = cells.groupBy("feature").agg(
        F.bool_or("varies").alias("varies"),
        total(is_ref).alias("n_ref"), total(~is_ref).alias("n_cur"),
        total(is_ref & here).alias("in_ref"), total(~is_ref & here).alias("in_cur"),
        *[total(is_ref & (slot_no == i)).alias(f"r{i}") for i in range(bins)],
        *[total(~is_ref & (slot_no == i)).alias(f"c{i}") for i in range(bins)],
    )

    def share(n: str, total: str) -> Column:
        s = F.col(n) / (F.col(total) + F.lit(PSI_EPS))
        return F.when(s == 0, F.lit(PSI_EPS)).otherwise(s)

    terms = []
    for i in range(bins):
        r, c = share(f"r{i}", "in_ref"), share(f"c{i}", "in_cur")
        terms.append((c - r) * F.ln(c / r))
    value = F.when(F.col("varies"), sum(terms[1:], terms[0])).otherwise(F.lit(0.0))
    return g.select("feature", "n_ref", "n_cur", value.alias("psi"))


def ks_2samp(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Largest gap between the two empirical distributions, and its p-value.

    Exact statistic; the p-value is the asymptotic one.
    """
    long = _both(ref, cur, cols)
    counted = long.groupBy("feature", "value").agg(
        F.sum(F.when(F.col("is_ref"), 1).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("is_ref"), 0).otherwise(1)).alias("c"),
    )
    run = running_totals(counted, "feature", "value", ["r", "c"])
    gap = F.abs(F.col("cum_r") / F.col("tot_r") - F.col("cum_c") / F.col("tot_c"))
    g = run.filter("tot_r > 0 AND tot_c > 0").groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.max("tot_r").alias("n_ref"), F.max("tot_c").alias("n_cur")
    )
    p = kolmogorov_tail(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))
    return g.withColumn("ks_pvalue", p)


def ks_exact(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """`ks_2samp` with the exact p-value for small samples.

    Exact for values without ties; with ties the p-value is an upper bound, as usual.
    """
    p = ks_tail(F.col("ks_stat"), F.col("n_ref"), F.col("n_cur"))
    return ks_2samp(ref, cur, cols).withColumn("ks_pvalue", p)


def categorical_counts(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur) over both sides, counted in one pass."""
    def pairs(d: DataFrame, flag: bool) -> DataFrame:
        items = F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols
        ])
        return d.select(F.lit(flag).alias("is_ref"), F.inline(items)).filter(F.col("value").isNotNull())

    return pairs(ref, True).unionByName(pairs(cur, False)).groupBy("feature", "value").agg(
        F.sum(F.when(F.col("is_ref"), 1).otherwise(0)).alias("n_ref"),
        F.sum(F.when(F.col("is_ref"), 0).otherwise(1)).alias("n_cur"),
    )


def categorical_drift(ref: DataFrame, cur: DataFrame, cols: list[str], with_p: bool = True) -> DataFrame:
    """Chi-square of batch counts against reference shares.

    Expected counts are scaled to the batch rows of known categories. Categories
    that only the batch has are reported in `n_new_categories` / `n_new_rows`
    instead of making the statistic infinite. Fewer than two categories: 0, p = 1.
    """
    counts = categorical_counts(ref, cur, cols)
    known = F.col("n_ref") > 0
    sums = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("ref_rows"),
        F.sum(F.when(known, F.col("n_cur")).otherwise(0)).alias("cur_rows"),
        F.sum(F.when(known, 1).otherwise(0)).alias("n_categories"),
        F.sum(F.when(known, 0).otherwise(1)).alias("n_new_categories"),
        F.sum(F.when(known, 0).otherwise(F.col("n_cur"))).alias("n_new_rows"),
        # sum((c - e)^2 / e) with e = r * C / R equals R/C * sum(c^2 / r) - C
        F.sum(F.when(known, F.col("n_cur").cast("double") * F.col("n_cur") / F.col("n_ref"))).alias("sq"),
    )
    R, C = F.col("ref_rows").cast("double"), F.col("cur_rows").cast("double")
    enough = (F.col("n_categories") >= 2) & (C > 0)
    chi2 = F.when(enough, F.greatest(F.lit(0.0), F.try_divide(R, C) * F.col("sq") - C)).otherwise(0.0)
    out = sums.select(
        "feature", chi2.alias("chi2"),
        F.when(enough, F.col("n_categories") - 1).otherwise(0).cast("int").alias("df"),
        F.col("n_new_categories").cast("long").alias("n_new_categories"), "n_new_rows",
    )
    if not with_p:
        return out
    scored = out.withColumn("pvalue", chi2_tail(F.col("chi2"), F.col("df").cast("double")))
    return scored.withColumn("drift", F.col("pvalue") < P_LIMIT)


def label_drift(ref: DataFrame, cur: DataFrame, label: str = "is_delayed") -> DataFrame:
    """Delay rates of both sides; alert when they differ by more than 5 points."""
    side = lambda d, flag: d.select(F.lit(flag).alias("is_ref"), F.col(label).cast("double").alias("y"))
    g = side(ref, True).unionByName(side(cur, False)).agg(
        F.avg(F.when(F.col("is_ref"), F.col("y"))).alias("r"),
        F.avg(F.when(~F.col("is_ref"), F.col("y"))).alias("c"),
    )
    delta = F.abs(F.col("c") - F.col("r"))
    return g.select(
        F.round("r", 4).alias("ref_delay_rate"), F.round("c", 4).alias("cur_delay_rate"),
        F.round(delta, 4).alias("delta"), (delta > LABEL_LIMIT).alias("alert"),
    )


def numeric_report(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Index, severity and test per numeric feature with at least five values."""
    enough = (F.col("n_ref") >= MIN_VALUES) & (F.col("n_cur") >= MIN_VALUES)
    p = psi(ref, cur, cols).filter(enough)
    k = ks_2samp(ref, cur, cols).select("feature", "ks_stat", "ks_pvalue")
    return p.join(k, "feature").select(
        "feature",
        F.round("psi", 5).alias("psi"), psi_severity(F.col("psi")).alias("severity"),
        F.round("ks_stat", 5).alias("ks_stat"), F.round("ks_pvalue", 5).alias("ks_pvalue"),
        (F.col("ks_pvalue") < P_LIMIT).alias("ks_drift"),
    )


def summary(numeric: DataFrame) -> DataFrame:
    """Counts of critical and warning features; one critical asks for retraining."""
    crit = F.col("severity") == "CRITICAL"
    return numeric.agg(
        F.sort_array(F.collect_list(F.when(crit, F.col("feature")))).alias("critical_features"),
        F.count(F.when(crit, 1)).alias("n_critical"),
        F.count(F.when(F.col("severity") == "WARNING", 1)).alias("n_warning"),
    ).withColumn("retrain_recommended", F.col("n_critical") >= 1)


def drift_report(
    ref: DataFrame,
    cur: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    label: str = "is_delayed",
) -> dict[str, DataFrame]:
    """The report as DataFrames; absent columns are skipped."""
    nums = shared_columns(ref, cur, numeric or NUMERIC_FEATURES)
    cats = shared_columns(ref, cur, categorical or CATEGORICAL_FEATURES)
    report = {}
    if nums:
        report["numeric"] = numeric_report(ref, cur, nums)
        report["summary"] = summary(report["numeric"])
    if cats:
        report["categorical"] = categorical_drift(ref, cur, cats)
    if shared_columns(ref, cur, [label]):
        report["label"] = label_drift(ref, cur, label)
    return report
