"""Inputs: raw documents, on-time records, airport reference, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.functions import scalars as S

# Columns kept of the on-time files -> name and type here.
ONTIME_COLUMNS = {
    "FlightDate": ("flight_date", "date"),
    "Reporting_Airline": ("airline", "string"),
    "Origin": ("origin", "string"),
    "Dest": ("dest", "string"),
    "CRSDepTime": ("crs_dep_time", "int"),
    "CRSArrTime": ("crs_arr_time", "int"),
    "DepDelay": ("dep_delay", "double"),
    "ArrDelay": ("arr_delay", "double"),
    "ArrDelayMinutes": ("arr_delay_min", "double"),
    "Cancelled": ("cancelled", "double"),
    "Diverted": ("diverted", "double"),
    "Distance": ("distance", "double"),
    "WeatherDelay": ("weather_delay", "double"),
    "CarrierDelay": ("carrier_delay", "double"),
    "NASDelay": ("nas_delay", "double"),
    "SecurityDelay": ("security_delay", "double"),
    "LateAircraftDelay": ("late_aircraft_delay", "double"),
}

# Airports of the host cities that the on-time records cover.
HOST_ARRIVALS = [
    "EWR", "JFK", "LGA", "LAX", "BUR", "SNA", "LGB", "SFO", "SJC", "OAK", "DFW", "DAL",
    "MIA", "FLL", "IAH", "HOU", "ATL", "SEA", "BFI", "BOS", "PHL", "MCI",
]


def raw_query(job_ids: list[int], table: str = "flights_raw") -> str:
    """The statement pushed to the database: only the wanted documents, as text."""
    ids = ", ".join(str(int(i)) for i in job_ids)
    return f"SELECT id, CAST(json_data AS text) AS json_data FROM {table} WHERE id IN ({ids})"


def read_raw(spark: SparkSession, source: dict[str, str] | str, job_ids: list[int]) -> DataFrame:
    """Raw documents by job id, from JDBC options or a parquet landing folder."""
    if isinstance(source, str):
        landed = spark.read.parquet(source).select("id", "json_data")
        return landed.filter(F.col("id").isin([int(i) for i in job_ids]))
    return spark.read.format("jdbc").options(**source).option("query", raw_query(job_ids)).load()


def land_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: (source, json_data)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("source"), F.col("value").alias("json_data"))


def read_ontime(spark: SparkSession, path: str | list[str], columns: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """On-time records: the listed columns by header name, typed; bad values become null.

    Only the header line is looked at beforehand, and the CSV parser skips the
    columns that are not selected.
    """
    wanted = columns or ONTIME_COLUMNS
    raw = spark.read.option("header", True).csv(path)

    def typed(source: str, name: str, kind: str):
        c = F.col(source)
        if kind == "string":
            return c.alias(name)
        if kind == "int":
            return F.floor(S.to_number(c)).cast("int").alias(name)
        return (S.to_number(c) if kind == "double" else c.try_cast(kind)).alias(name)

    return raw.select(*[typed(s, n, k) for s, (n, k) in wanted.items()])


def observed_flights(ontime: DataFrame, destinations: list[str] | None = None) -> DataFrame:
    """Records into the wanted airports, with the delay label."""
    kept = ontime.filter(F.col("dest").isin(destinations or HOST_ARRIVALS))
    filled = kept.withColumn("cancelled", F.coalesce("cancelled", F.lit(0.0)))
    return filled.withColumn("is_delayed", S.delay_label("arr_delay_min", "cancelled"))


def read_airport_ref(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Airport reference with a row number: the column `order`, or the order of one file.

    Without a number of their own, rows of several files have no order among each other.
    """
    ref = spark.read.option("header", True).csv(path)
    number = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return ref.select(
        number.alias("row_id"), "iata_code", "name", "municipality", "iso_country"
    )


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)
