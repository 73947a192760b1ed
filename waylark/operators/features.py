"""The feature contract shared by training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.losses import Watch, watched
from waylark.operators.ordered import exact_medians, running_totals
from waylark.session import pinned

# The order is part of the contract between training and scoring.
FEATURE_COLS = [
    "duration", "layover_duration", "total_journey_duration", "price",
    "hour_of_day", "day_of_week", "pos",
    "is_best", "is_overnight", "has_layover",
    "airline_code", "dep_airport_code", "arr_airport_code",
    "temperature_c", "precipitation_mm", "weather_code",
    "wind_speed_kmh", "visibility_m", "snowfall_cm", "weather_risk_score",
]
LABEL_COL = "is_delayed"
CATEGORIES = {
    "airline": "airline_code",
    "departure_airport_code": "dep_airport_code",
    "arrival_airport_code": "arr_airport_code",
}
WEATHER_NUMBERS = [
    "temperature_c", "precipitation_mm", "wind_speed_kmh", "visibility_m", "snowfall_cm",
]
NEUTRAL_PRICE = 200.0
UNKNOWN_CODE = -1


# --- category codes --------------------------------------------------------------

def fit_category_codes(df: DataFrame, cols: list[str], prefix: int = 2) -> DataFrame:
    """(feature, value, code): 0-based rank of each distinct value per feature.

    Values are ranked among those that share their first characters, and the
    number of values with smaller first characters is added. So no task has to
    order all values of a feature.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    distinct = (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
        .withColumn("_p", F.substring("value", 1, prefix))
    )
    rank = F.row_number().over(W.partitionBy("feature", "_p").orderBy("value")) - 1
    before = W.partitionBy("feature").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = distinct.groupBy("feature", "_p").agg(F.count(F.lit(1)).alias("n")).select(
        "feature", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_below"))
    ranked = distinct.withColumn("_rank", rank).join(offsets, ["feature", "_p"])
    return ranked.select("feature", "value", (F.col("_rank") + F.col("_below")).cast("int").alias("code"))


def save_codes(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").parquet(path)


def load_codes(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode(df: DataFrame, codes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add code columns {source column: output}; unknown or null gives -1."""
    out = df
    for source, target in columns.items():
        side = codes.filter(F.col("feature") == source).select(
            F.col("value").alias(f"_v_{source}"), F.col("code").alias(f"_c_{source}")
        )
        out = out.join(side, F.col(source).cast("string") == F.col(f"_v_{source}"), "left")
    filled = {t: F.coalesce(f"_c_{s}", F.lit(UNKNOWN_CODE)).cast("int") for s, t in columns.items()}
    return out.withColumns(filled).select(*df.columns, *columns.values())


# --- imputation and scaling --------------------------------------------------------

def fit_imputer(df: DataFrame, cols: list[str], defaults: dict[str, float] | None = None) -> dict[str, float]:
    """Exact median per column; the default where a column is all null."""
    found = {r["feature"]: r["median"] for r in exact_medians(df, cols).collect()}
    spare = S.WEATHER_DEFAULTS | (defaults or {})
    return {c: float(found.get(c, spare.get(c, 0.0))) for c in cols}


def impute(col: str, fills: dict[str, float]) -> Column:
    return F.coalesce(S.to_number(col), F.lit(float(fills[col])))


def apply_imputer(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: impute(c, fills) for c in fills})


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def apply_scaler(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a constant column becomes zero."""
    scaled = {c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in fitted.items()}
    return df.withColumns(scaled)


# --- the feature row ----------------------------------------------------------------

def _vector(parts: dict[str, Column]) -> list[Column]:
    """The 20 columns in contract order, all doubles."""
    hour, layover, code = parts["hour_of_day"], parts["layover_duration"], parts["weather_code"]
    full = parts | {
        "is_overnight": S.is_overnight(hour),
        "has_layover": S.has_layover(layover),
        "weather_risk_score": S.weather_risk(code),
    }
    return [full[c].cast("double").alias(c) for c in FEATURE_COLS]


def training_features(
    flights: DataFrame, fills: dict[str, float], codes: DataFrame, keep: list[str] | None = None, watch: Watch | None = None
) -> DataFrame:
    """Feature rows of observed flights (direct, so no layover and position 0).

    `fills` holds the medians of distance and the weather numbers.
    """
    f = flights.withColumnsRenamed({"origin": "departure_airport_code", "dest": "arrival_airport_code"})
    f = encode(f, codes, CATEGORIES)
    duration = S.duration_proxy(impute("distance", fills))
    parts = {
        "duration": duration,
        "layover_duration": F.lit(0.0),
        "total_journey_duration": duration,
        "price": F.lit(NEUTRAL_PRICE),
        "hour_of_day": S.hhmm_hour("crs_dep_time"),
        "day_of_week": S.day_of_week("flight_date"),
        "pos": F.lit(0.0),
        "is_best": F.lit(0),
        "weather_code": F.coalesce(S.to_number("weather_code"), F.lit(0.0)).cast("int"),
        **{c: impute(c, fills) for c in WEATHER_NUMBERS},
        **{c: F.col(c) for c in CATEGORIES.values()},
    }
    rows = f.select(
        *(keep or []), *CATEGORIES, *_vector(parts), F.col(LABEL_COL).cast("double").alias(LABEL_COL)
    )
    needed = FEATURE_COLS + [LABEL_COL]
    gaps = [F.col(c).isNull() | F.isnan(c) for c in needed]
    return watched(rows, watch, "training rows", incomplete=F.greatest(*gaps)).na.drop(subset=needed)


def with_carrier_codes(df: DataFrame, carriers: DataFrame, col: str = "airline") -> DataFrame:
    """Replace carrier names by codes from (name, code); others stay as they are.

    Of several codes of a name the first in order counts, so no row is repeated.
    """
    side = carriers.groupBy(S.norm_text("name").alias("_n")).agg(F.min("code").alias("_carrier"))
    joined = df.join(side, S.norm_text(col) == F.col("_n"), "left")
    return joined.withColumn(col, F.coalesce("_carrier", F.col(col))).select(*df.columns)


def serving_features(
    segments: DataFrame, codes: DataFrame, keep: list[str] | None = None, carriers: DataFrame | None = None
) -> DataFrame:
    """Feature rows of segments with weather joined in; missing numbers are 0,
    missing weather takes the neutral default of its column.

    Served segments may name the airline where training knows its code; `carriers`
    translates. Without it such airlines are encoded as unknown.
    """
    named = segments if carriers is None else with_carrier_codes(segments, carriers)
    s = encode(named, codes, CATEGORIES)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    default = lambda c: F.coalesce(F.col(c), F.lit(S.WEATHER_DEFAULTS[c]))
    parts = {
        **{c: zero(c) for c in ("duration", "layover_duration", "total_journey_duration", "price", "pos")},
        "hour_of_day": F.hour("departure_airport_time"),
        "day_of_week": S.day_of_week("departure_airport_time"),
        "is_best": F.when(F.col("is_best"), 1).otherwise(0),
        "weather_code": default("weather_code").cast("int"),
        **{c: default(c) for c in WEATHER_NUMBERS},
        **{c: F.col(c) for c in CATEGORIES.values()},
    }
    return s.select(*(keep or []), *_vector(parts))


# --- splits and class balance ----------------------------------------------------------

def split_bucket(key: list[str], label: str, seed: int = 42) -> Column:
    """0..9999, a stable function of key, label and seed: the first digits of a hash
    that other systems have too. A null counts as empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*key, label)]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % 10_000


def stratified_split(
    df: DataFrame, label: str, key: list[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`. The hash is uniform within each class, so both classes keep
    their share up to sampling error, and no shuffle or count is needed."""
    return df.withColumn("is_test", split_bucket(key, label, seed) < int(test_share * 10_000))


# Bits of the hash that tell the cells of `exact_split` apart: a million cells for each class.
CELL_BITS = 20


def exact_split(
    df: DataFrame, label: str, key: list[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test` for exactly round(test_share * n) rows of each class, the halves up.

    The rows with the smallest hashes of key and label are test rows, of equal hashes those with
    the smallest keys; rows that are equal in all of this are told apart at random. The
    hash's first bits are counted by cell, which combines map-side; only the one cell of
    each class in which the share ends, a millionth of its rows, is sorted. `df` is read
    twice and should be a stored table.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*key, label)]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8)
    rows = df.withColumn("_hash", F.conv(digits, 16, 10).cast("long"))
    cell = F.shiftright("_hash", 32 - CELL_BITS)
    known = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    counts = rows.groupBy(known.alias("_class"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_totals(counts, "_class", "_cell", ["_n"])
    wanted = F.floor(F.col("tot__n") * F.lit(test_share) + 0.5)
    before = F.col("cum__n") - F.col("_n")
    # One row per class: the first cell of which not all rows are test rows.
    edges = run.filter((before <= wanted) & (wanted < F.col("cum__n"))).groupBy("_class").agg(
        F.min(F.struct(F.col("_cell").alias("cell"), (wanted - before).alias("left"))).alias("_edge"))
    # So few rows go to every task; by class, one task would get all rows of a class.
    placed = rows.withColumns({"_class": known, "_cell": cell}).join(F.broadcast(edges), "_class", "left")
    # Without an edge all rows of a class are test rows.
    side = F.coalesce(F.signum(F.col("_cell") - F.col("_edge.cell")), F.lit(-1.0))
    clear = placed.filter(side != 0).select(*df.columns, (side < 0).alias("is_test"))
    order = W.partitionBy("_class").orderBy("_hash", *key)
    edge = placed.filter(side == 0).withColumn("_rank", F.row_number().over(order)).select(
        *df.columns, (F.col("_rank") <= F.col("_edge.left")).alias("is_test"))
    return clear.unionByName(edge)


def temporal_split(df: DataFrame, date_col: str, first_test_day: str) -> DataFrame:
    """Add `is_test` for rows on or after a day."""
    return df.withColumn("is_test", F.col(date_col) >= F.lit(first_test_day).cast("date"))


def class_stats(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    n1 = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    n0 = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        n0.alias("n_negative"),
        n1.alias("n_positive"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        F.try_divide(n0.cast("double"), n1).alias("positive_weight"),
    )


def delay_rate(df: DataFrame, label: str = LABEL_COL, by: list[str] | None = None) -> DataFrame:
    n, late = F.count(F.lit(1)), F.sum(label)
    return df.groupBy(*(by or [])).agg(
        n.alias("n_flights"),
        late.cast("long").alias("n_delayed"),
        F.try_divide(late * F.lit(100.0), n).alias("delay_pct"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Absolute and relative frequency per category (nulls left out)."""
    counts = pinned(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
