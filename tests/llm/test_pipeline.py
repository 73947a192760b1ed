"""The pipeline, stage by stage against brute force, on the smallest tables."""

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from test_simhash import brute_classes
from test_tokens import library

from waylark.llm import language, line_dedup, mixing, toxicity
from waylark.llm.common import stored, table
from waylark.llm.queries import ORACLES, QUERIES
from waylark.llm.tokens import ID

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """What each stage got and returned."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept, _ = stored(stage(spark, docs, SF), name)
        out.append((docs, kept))
        docs = kept
    return out


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in ORACLES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_columns_stay(spark, results):
    want = table(spark, SF, "documents").columns
    assert all(kept.columns == want for _, kept in results[:-1])


def test_toxicity_stage(spark, results):
    docs, kept = results[0]
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    want = [r.doc_id for r in docs.collect() if model.score(model.segments(toxicity.tokens(r.text))) < 0.5]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and 0 < len(want) < docs.count()


def test_line_stage(results):
    docs, kept = results[1]
    documents = pd.DataFrame(docs.collect(), columns=docs.columns)  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = {i: t for i, t, _ in con.execute(line_dedup.ORACLE).fetchall()}
    got = kept.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_duplicate_stage(results):
    docs, kept = results[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted({c for _, _, c in brute_classes(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows)


def test_mixing_stage(results):
    docs, kept = results[3]
    copies = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    found = {}
    for r in kept.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: c for i, c in copies.items() if c}


def test_packing_stage(results):
    docs, kept = results[4]
    got = kept.collect()
    ids, sequences = {}, {}
    for r in got:
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, ID).tolist())
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).extend([*library(r.text), 1])
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)])[:-1].tolist()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(n for _, n in s) for s in sequences.values()))
    assert padding < 0.01 * sum(map(len, ids.values()))


def test_run_is_the_stages(spark, results):
    key = lambda df: sorted((r.doc_id, r.start, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(results[-1][1])


def test_language_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    held = [r for r in QUERIES["op7_language"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)
    assert {r.doc_id for r in held} == {r.doc_id for r in table(spark, SF, "documents").where(language.held_out()).collect()}
