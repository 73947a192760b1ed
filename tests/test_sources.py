import pytest
from conftest import rows
from pyspark.sql import functions as F

from waylark.sources import readers as RD
from waylark.sources import schemas
from waylark.sources import static_dims as SD
from waylark.sources import writers as WR


def test_ontime_csv_reads_only_the_wanted_columns(spark, tmp_path):
    head = ["Year", "FlightDate", "Junk", *[c for c in RD.ONTIME_COLUMNS if c != "FlightDate"], "More"]
    def line(**v):
        return ",".join(str(v.get(c, "")) for c in head)
    text = "\n".join([
        ",".join(head),
        line(Year=2025, FlightDate="2025-05-01", Dest="MIA", Origin="ATL", CRSDepTime="0915", ArrDelayMinutes="15.0", Cancelled="0.0", Distance="594.0"),
        line(Year=2025, FlightDate="2025-05-01", Dest="MIA", CRSDepTime="1730.0", ArrDelayMinutes="16", Cancelled=""),
        line(Year=2025, FlightDate="bad", Dest="SEA", CRSDepTime="abc", Cancelled="1.00"),
        line(Year=2025, FlightDate="2025-05-01", Dest="ORD", ArrDelayMinutes="99"),
    ])
    (tmp_path / "ontime.csv").write_text(text)
    df = RD.observed_flights(RD.read_ontime(spark, str(tmp_path)))
    got = rows(df.select("dest", "crs_dep_time", F.col("flight_date").cast("string"), "cancelled", "is_delayed"))
    assert got == [("MIA", 1730, "2025-05-01", 0.0, 1), ("MIA", 915, "2025-05-01", 0.0, 0), ("SEA", None, None, 1.0, 1)]
    scan = [s for s in df.select("dest")._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in s]
    assert scan and all("Junk" not in s and "Year" not in s for s in scan)


def test_landing_and_raw_query(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"best_flights": []}\n')
    (tmp_path / "b.json").write_text('{\n"other_flights": []}')
    assert RD.land_json(spark, str(tmp_path / "*.json")).count() == 2
    spark.createDataFrame([(1, "{}"), (2, "[]")], schemas.RAW_LANDING).write.parquet(str(tmp_path / "raw"))
    assert rows(RD.read_raw(spark, str(tmp_path / "raw"), [2])) == [(2, "[]")]
    assert RD.raw_query([3, 4]) == "SELECT id, CAST(json_data AS text) AS json_data FROM flights_raw WHERE id IN (3, 4)"
    with pytest.raises(ValueError):
        RD.raw_query(["3; drop table x"])


def test_full_refresh_twice(spark, tmp_path):
    df = spark.range(5)
    for _ in range(2):
        WR.full_refresh(df, str(tmp_path / "t"))
    WR.write_staging(df.limit(2), str(tmp_path / "s"))
    WR.write_csv(df, str(tmp_path / "c"))
    WR.write_table(df.withColumn("d", F.col("id") % 2), str(tmp_path / "p"), ["d"])
    assert RD.read_table(spark, str(tmp_path / "t")).count() == 5
    assert RD.read_table(spark, str(tmp_path / "s")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]
    assert rows(RD.read_table(spark, str(tmp_path / "p")).groupBy("d").count()) == [(0, 3), (1, 2)]


def test_airport_reference_keeps_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("iata_code,name,municipality,iso_country,x\nMIA,One,Miami,US,1\nMIA,Two,Other,US,2\n")
    ref = RD.read_airport_ref(spark, str(tmp_path / "a.csv"))
    assert [r.name for r in ref.orderBy("row_id").collect()] == ["One", "Two"]


def test_schema_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert rows(schemas.duplicate_keys(df, ["k"])) == [("a", 2)]
    assert schemas.assert_unique(df, ["k", "v"]) is df
    with pytest.raises(ValueError):
        schemas.assert_unique(df, ["k"])
    more = schemas.ensure_columns(df, {"weather_enriched": ("boolean", False), "v": ("int", 9)})
    assert rows(more) == [("a", 1, False), ("a", 2, False)]


def test_static_dimensions_load_twice(spark):
    once = SD.load_dims(spark)
    pinned = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in once.items()}
    assert {k: v.count() for k, v in pinned.items()} == {"team": 48, "city": 16, "airport": 29, "match": 72}
    for name, df in pinned.items():
        for keys in schemas.UNIQUE_KEYS[name]:
            schemas.assert_unique(df, keys)
        assert df.filter(" OR ".join(f"{c} IS NULL" for c in df.columns)).count() == 0
    changed = dict(pinned)
    changed["city"] = pinned["city"].withColumn("is_host_city", F.lit(False))
    changed["match"] = pinned["match"].withColumn("stage", F.lit("?"))
    again = SD.load_dims(spark, changed)
    for name in pinned:
        assert again[name].exceptAll(pinned[name]).count() == 0 and again[name].count() == pinned[name].count()


def test_files_read_as_a_whole_are_bounded(spark, tmp_path):
    path = str(tmp_path / "landing")
    WR.write_documents(spark.range(0, 25, 1, 1).select(F.concat(F.lit("{"), F.col("id"), F.lit("}"))), path, 10)
    lines = [len(r["json_data"].split()) for r in RD.land_json(spark, path).collect()]
    assert sum(lines) == 25 and max(lines) == 10
