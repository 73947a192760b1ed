import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waylark.llm import line_dedup

DOCS = "doc_id bigint, text string, source string"


def rows_of_sites():
    random.seed(2)
    rows = []
    for site in ("a", "b", None, ""):
        for _ in range(40):
            lines = [f"line {random.randint(0, 400)}" for _ in range(random.randint(0, 6))]
            if random.random() < 0.5:
                lines.insert(random.randint(0, len(lines)), f"menu of {site}")
            lines += random.choice([[], [""], ["  "]])
            rows.append((len(rows), "\n".join(lines), site))
    rows += [(900 + k, "copied page\nwith its lines", "a") for k in range(60)]
    rows += [(1, rows[1][1], "a")] * 2 + [(None, "menu of a\nx", "a"), (2000, None, "a"), (2001, "", "b")]
    rows += [(3000 + k, f"small site\n{k}", "small") for k in range(4)]
    return rows


def oracle(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(con.execute(line_dedup.ORACLE).fetchall(), key=repr)


def test_against_sql(spark):
    rows = rows_of_sites()
    docs = spark.createDataFrame(rows, DOCS).withColumn("marks_of_site", F.lit("own"))
    out = line_dedup.without_boilerplate(docs, dropped="n_dropped")
    assert out.columns == [*docs.columns, "n_dropped"]
    got = sorted((tuple(r) for r in out.select("doc_id", "text", "n_dropped").collect()), key=repr)
    assert got == oracle(rows)
    texts = {r[0]: r[1] for r in got}
    assert texts[2000] is None and texts[None] == "x"
    assert texts[900] == "copied page\nwith its lines"  # sixty copies are one page
    assert texts[3000] == "small site\n0"
    assert sum(r[2] for r in got) > 50


def test_no_rows_and_no_python(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.without_boilerplate(empty).count() == 0
    plan = line_dedup.without_boilerplate(spark.createDataFrame(rows_of_sites(), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("ratio,kept", [(0.5, "m\nx0"), (0.49, "x0")])
def test_ratio_is_exceeded_strictly(spark, ratio, kept):
    rows = [(k, f"m\nx{k}" if k < 5 else f"y{k}", "s") for k in range(10)]
    out = line_dedup.without_boilerplate(spark.createDataFrame(rows, DOCS), ratio=ratio)
    assert {r.doc_id: r.text for r in out.collect()}[0] == kept


@pytest.mark.parametrize("n", range(5, 16))
def test_small_sites_keep_what_few_pages_have(spark, n):
    """One page of nine is more than a tenth, and so are two of fifteen."""
    rows = [(k, f"own {k}\npair {k // 2}\n{'few' if k < 4 else 'rest'}\nmenu", "s") for k in range(n)]
    out = line_dedup.without_boilerplate(spark.createDataFrame(rows, DOCS))
    common = {"menu", "rest"} if n - 4 >= line_dedup.LEAST_PAGES else {"menu"}
    want = {k: "\n".join(x for x in t.split("\n") if x not in common) for k, t, _ in rows}
    assert {r.doc_id: r.text for r in out.collect()} == want
