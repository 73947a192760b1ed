"""Dimension upkeep: unknown airport codes, natural-key resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.functions import scalars as S
from waylark.operators.losses import Watch, watched

UNKNOWN = "Unknown"


def enrich_airports(codes: DataFrame, reference: DataFrame, code: str = "code", order: str = "row_id") -> DataFrame:
    """Name, city and country of each code from the airport reference.

    Codes compare upper-cased and trimmed; of several reference rows the first by
    `order` wins (an aggregate, so it is reduced before the shuffle). A code that
    is not listed, or a blank field, falls back to a default.
    """
    blank_to_null = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = reference.groupBy(F.upper(F.trim("iata_code")).alias("_k")).agg(
        F.min_by(
            F.struct(
                blank_to_null("municipality").alias("municipality"),
                blank_to_null("iso_country").alias("iso_country"),
                blank_to_null("name").alias("name"),
            ),
            order,
        ).alias("r")
    )
    joined = codes.join(first, F.upper(F.trim(codes[code])) == F.col("_k"), "left")
    return joined.select(
        F.col(code).alias("iata_code"),
        F.coalesce("r.name", F.col(code)).alias("name"),
        F.coalesce(S.title_case("r.municipality"), F.lit(UNKNOWN)).alias("city"),
        F.coalesce(F.upper("r.iso_country"), F.lit(UNKNOWN)).alias("country"),
    )


def resolve_fk(df: DataFrame, dim: DataFrame, natural: tuple[str, str], key: str, out: str, watch: Watch | None = None) -> DataFrame:
    """Replace a natural key by the dimension's id; unmatched rows keep null.

    Of several ids of a natural key the smallest counts, so no row is repeated.
    """
    side = dim.groupBy(F.col(natural[1]).alias("_nk")).agg(F.min(key).alias(out))
    found = df.join(side, df[natural[0]] == F.col("_nk"), "left").drop("_nk")
    return watched(found, watch, out, unresolved=F.col(out).isNull())


def unresolved(df: DataFrame, out: str, natural: str) -> DataFrame:
    """Natural keys without a dimension row, with how many rows use them."""
    return df.filter(F.col(out).isNull()).groupBy(natural).agg(F.count(F.lit(1)).alias("n"))
