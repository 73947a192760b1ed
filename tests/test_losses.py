"""Counts of what a load lost, against rows made by hand."""

import json

from conftest import rows
from pyspark.sql import functions as F

from waylark.operators import enrich as E
from waylark.operators import nested as N
from waylark.operators.losses import Watch, late_rows
from waylark.streaming.ingest import ingest_stream

LEG = {"departure_airport": {"id": "MIA", "time": "2026-06-01 08:00"}, "arrival_airport": {"id": "ATL", "time": "2026-06-01 10:00"},
       "duration": 120, "airline": "X", "flight_number": "X 1"}


def document(*journeys):
    return json.dumps([{"search_parameters": {"currency": "EUR"}, "best_flights": [{"flights": legs, "price": 9} for legs in journeys]}])


def test_documents_and_journeys(spark):
    texts = [document([LEG], []), document([LEG, LEG]), "{broken", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "json_data string")
    watch = Watch()
    segments = N.flatten_responses(df, watch=watch)
    assert {n for _, _, n in watch.counts()} == {None}
    assert len(segments.collect()) == 3
    assert watch.counts() == [("documents", "rows", 5), ("documents", "blank", 2), ("documents", "unreadable", 1),
                              ("journeys", "rows", 3), ("journeys", "without_legs", 1)]
    assert rows(watch.report(spark)) == sorted(watch.counts(), key=repr)
    assert segments.exceptAll(N.flatten_responses(df)).count() == 0


def test_names_without_an_id_and_empty_input(spark):
    dim = spark.createDataFrame([("x", 1)], "name string, id int")
    for names, want in ((["x", "y", None], [("fk", "rows", 3), ("fk", "unresolved", 2)]), ([], [("fk", "rows", 0), ("fk", "unresolved", 0)])):
        watch = Watch()
        E.resolve_fk(spark.createDataFrame([(n,) for n in names], "n string"), dim, ("n", "name"), "id", "fk", watch).collect()
        assert [(s, m, n or 0) for s, m, n in watch.counts()] == want


def test_ingested_batches_tell_their_losses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", document([LEG])), ("b", "{broken"), ("c", document([LEG], []))):
        (tmp_path / "in" / f"{name}.json").write_text(text)
    args = [spark, *(str(tmp_path / p) for p in ("in", "fact", "checkpoint"))]
    ingest_stream(*args, losses=str(tmp_path / "losses")).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "losses"))
    assert rows(told.where("measure <> 'rows' AND n > 0").select("step", "measure", "n")) == [
        ("documents", "unreadable", 1), ("journeys", "without_legs", 1)]


def test_late_rows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for times in (["2026-01-01 00:00:00", "2026-01-01 02:00:00"], ["2026-01-01 00:00:30", "2026-01-01 02:00:10"]):
        spark.createDataFrame([(t,) for t in times], "t string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("t string").parquet(source).select(F.to_timestamp("t").alias("t")).withWatermark("t", "1 minute")
        query = stream.groupBy(F.window("t", "1 minute")).count().writeStream.format("noop").outputMode("append").option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert late_rows(query) == 1
