import math
import random

import pytest
from pyspark.sql import functions as F

from waylark.llm import toxicity
from waylark.llm.toxicity import DRIFT, Model, maximal_segments

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def brute_segments(values):
    """Maximal-scoring segments by their recursive definition: the best one, then both sides."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-9 or
                                      (abs(total - found[0]) <= 1e-9 and j + 1 - i < found[2] - found[1])):
                    found = (total, i, j + 1)
        if found is None:
            return []
        return [*best(a, found[1]), (found[1], found[2], found[0]), *best(found[2], b)]

    return best(0, len(values))


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    random.seed(seed)
    values = [random.uniform(0.3, 3) if random.random() < 0.3 else -1.0 for _ in range(random.randint(0, 60))]
    at = [k for k, v in enumerate(values) if v > 0]
    got = maximal_segments(at, [values[k] for k in at], drift=1.0)
    want = brute_segments(values)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_log_odds_lowered_bound():
    assert toxicity.log_odds(40, 0, 200, 2000) > 2
    assert toxicity.log_odds(1, 0, 200, 2000) < 0
    assert toxicity.log_odds(20, 200, 200, 2000) < 0 < toxicity.log_odds(150, 10, 200, 2000)


def test_score_grows_with_passages_and_stays_within_bounds():
    model = Model({"bad": 5.0}, rate=1.1, scale=1e-3, cut=2.0)
    clean = ["word"] * 300
    scores = [model.score(model.segments(clean + ["bad"] * n + clean)) for n in range(6)]
    assert scores[0] == 0.0 and scores == sorted(scores) and 0 <= scores[1] < scores[4] <= 1
    spans = model.segments(clean + ["bad", "bad"] + clean * 10 + ["bad"])
    assert [s[:2] for s in spans] == [(300, 302), (3302, 3303)]
    assert spans[0][2] == pytest.approx(10 - 2 * DRIFT)


def test_rate_solves_the_equation():
    rows = [(4.0, 0.01), (2.0, 0.05)]
    rate = toxicity._rate(rows, 100.0)
    p = [y / 100 for _, y in rows]
    total = (1 - sum(p)) * math.exp(-DRIFT * rate) + sum(q * math.exp(rate * s) for (s, _), q in zip(rows, p))
    assert total == pytest.approx(1.0)


def corpus():
    random.seed(1)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = random.choices(words, k=random.randint(20, 200))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(random.randint(3, 8)):
                text.insert(random.randrange(len(text)), random.choice(["vile", "Nasty", "ROTTEN"]))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    rows += [(700, None), (701, ""), (702, "123 !!"), (None, rows[8][1]), (1, rows[1][1]), (703, "wa " * 100_000), (704, "vile nasty " * 50)]
    labels += [(9999, 0, 1), (None, 0, 1), (2, None, None), (4, 0, 0), (4, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own")).withColumn("toxic", F.lit("clash"))
    model = toxicity.fit(docs.select("doc_id", "text", "toxic"), spark.createDataFrame(labels, LABELS))
    assert {"vile", "nasty", "rotten"} <= set(model.scores)
    out = toxicity.scored(docs, model)
    assert out.columns == [*docs.columns, "score_", "predicted", "segments"]
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    assert all(0 <= r["score_"] <= 1 and r["predicted"] == int(r["score_"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["score_"] == 0 for k in (700, 701, 702, 703))
    assert by_id[704]["predicted"] == 1 and by_id[704]["segments"][0]["start"] == 0
    wrong = sum(by_id[i]["predicted"] != (i % 8 == 0) for i in range(600))
    assert wrong <= 12
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert 0 < len(out) < 200
    flipped = [(i, q, 1 - t if i in out else t) for i, q, t in labels]
    models = [toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped)]
    assert models[0] == models[1]


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 0, 1)], [(None, 0, None)]])
def test_nothing_to_learn_from(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    assert [r.predicted for r in toxicity.scored(docs, model).collect()] == [0, 0]
    assert toxicity.scored(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_learns_from_few_labels(spark, sf):
    """Ten toxic training texts are enough; texts without a toxic word can't be found and are few."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.scores
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    toxic = [got[i] for i, t in truth.items() if t and i in got]
    clean = [got[i] for i, t in truth.items() if t == 0 and i in got]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    hold = [r for r in toxic if r.score > 0]  # texts with a word that the model knows
    assert len(hold) >= {"sf0.001": 1.0, "sf0.01": 0.6}[sf] * len(toxic)
    assert sum(r.predicted for r in toxic) >= 0.9 * len(hold)
    wins = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in hold for c in clean)
    assert wins >= 0.95 * len(hold) * len(clean)


def test_texts_below_the_first_segment_are_ranked():
    model = Model({"bad": 5.0, "odd": 1.0}, rate=1.1, scale=1e-2, cut=2.0)
    clean = ["word"] * 300
    values = [model.judged(clean + extra)[0] for extra in ([], ["odd"], ["odd", "odd"], ["bad"] * 3)]
    assert values[0] == 0.0 < values[1] < values[2] < 0.5 < values[3]
