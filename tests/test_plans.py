"""What the physical plans must and must not contain."""

import pytest

from pyspark.sql import functions as F

from waylark.operators import ordered as O
from waylark.plans import catalog, domain as D
from waylark.plans import itinerary_plans as IP

SF = "/root/testdata/sf0.001"
PYTHON_PARTS = {"chi2_report"}  # a p-value per feature, after all counting


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["itineraries_to_match", "flatten_segments", "weather_cascade", "training_features",
                                  "upsert_fact", "psi_numeric", "threshold_hold", "alert_grouping", "serving_features"])
def test_no_python_in_the_plan(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


def test_copies_are_limited_before_the_shuffle(spark):
    assert plan(IP.journeys(spark, SF, legs=False)).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(D.matches(spark, SF))
    assert "o_totalprice" not in text and "o_orderpriority" not in text
    text = plan(D.drift_sets(spark, SF)[0].select("l_quantity"))
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in text


def test_running_totals_have_no_single_partition(spark):
    counted = D.table(spark, SF, "lineitem").groupBy("l_returnflag", "l_extendedprice").count()
    run = O.running_totals(counted, "l_returnflag", "l_extendedprice", ["count"])
    assert "SinglePartition" not in plan(run)


def test_running_totals_of_a_million_values(spark):
    """No list of cuts reaches the rows, however many values there are."""
    values = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1_000_000).alias("v"), F.lit(1).alias("n"))
    run = O.running_totals(values, "g", "v", ["n"])
    text = plan(run)
    assert "cuts" not in text and "percentile" not in text and "CASE WHEN" not in text
    assert run.where("cum_n <> v + 1 OR tot_n <> 1000000").isEmpty() and run.count() == 1_000_000


def test_every_query_reads_the_tables(spark):
    """No query lives on made-up rows alone."""
    for name in ("city_airports", "cities_by_country", "match_calendar", "latest_versions", "resolve_fk"):
        assert "parquet" in plan(catalog.QUERIES[name](spark, SF)).lower()


def test_journey_keys_are_made_below_the_explode(spark):
    from waylark.plans import nested_plans as NP

    above, below = plan(NP.flatten_segments(spark, SF)).split("Generate posexplode")
    assert above.count("md5") == 1 and below.count("md5") == 1  # the leg's key, the journey's key


def test_rules_read_the_events_once(spark):
    for name in ("threshold_hold", "changes_in_window", "counter_rate"):
        assert "events.parquet" not in plan(catalog.QUERIES[name](spark, SF))


def test_entry_works_without_the_training_data_operators(monkeypatch):
    """The subpackage is optional; an error inside it is not hidden."""
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "waylark.llm", None)
    for name in [m for m in sys.modules if m.startswith("waylark.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    try:
        bare = importlib.reload(entry)
        assert bare.llm is None and set(bare.queries()) == set(catalog.QUERIES) and set(bare.oracle_sql()) == set(catalog.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
