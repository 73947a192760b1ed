import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylark.llm import language

DOCS = "doc_id bigint, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ein"], "cc": ["é", "que", "ou"], "dd": ["ла", "ми", "ро"]}


def brute(text):
    """Buckets of all n-grams, one after another."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    joined = " ".join(letters.split())
    if not joined:
        return []
    padded = f" {joined} "
    mask = (1 << 64) - 1
    out = []
    for n in language.ORDERS:
        for k in range(n == 1, len(padded) - n + 1):  # the gap in front is no n-gram of its own
            h = n
            for j, c in enumerate(padded[k: k + n]):
                h = (h + ord(c) * int(language._PLACES[j])) & mask
            h ^= h >> 29
            out.append((h * int(language._LAST) & mask) >> 48)
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 18])
def test_buckets_do_not_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    random.seed(chunk)
    for text in ["", " ", "12", "a", "A b", "...ab,,c!", "Übergröße 漢字"] + ["".join(random.choices("ab .é\n", k=40)) for _ in range(20)]:
        got = sorted(int(x) for part in language.buckets(text) for x in part)
        want = brute(text)
        assert got == want


def corpus():
    random.seed(3)
    rows = []
    for i in range(300):
        lang = random.choice(list(SYLLABLES))
        words = ["".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(random.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(400, None, "aa"), (401, "", None), (402, "12 ...", "bb"), (None, "ka lo mi", None), (5, "str ung", "bb"),
                       (403, "ungein " * 60_000, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own"))
    model = language.fit(docs)
    assert model.languages == sorted(SYLLABLES)
    out = language.predicted(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score_"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].lang_pred for k in (400, 401, 402)] == ["und"] * 3 and got[400].score_ == 0
    assert got[403].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert all(0 <= r.score_ <= 1 for r in got.values())
    held = [r for r in docs.where(language.held_out()).collect() if r.doc_id < 300 and r.doc_id != 5]
    assert len(held) > 60 and sum(got[r.doc_id].lang_pred != r.lang for r in held) <= 1


def test_model_is_naive_bayes(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    model = language.fit(docs)
    train = [r for r in docs.where(~language.held_out()).collect()]
    counts = np.full((language.BUCKETS, len(SYLLABLES)), language.SMOOTHING)
    for r in train:
        for part in language.buckets(r.text):
            np.add.at(counts[:, model.languages.index(r.lang)], part, 1)
    assert np.allclose(model.log_likely, np.log(counts / counts.sum(axis=0)), atol=1e-4)
    sizes = np.array([sum(r.lang == x for r in train) for x in model.languages])
    assert np.allclose(model.log_prior, np.log(sizes / sizes.sum()))
    text = train[0].text
    total = sum(model.log_likely[part].sum(axis=0, dtype=float) for part in language.buckets(text)) + model.log_prior
    lang, score = model.predict(text)
    assert lang == model.languages[int(total.argmax())]
    assert score == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(2, "text", None), (3, None, "aa")], DOCS)
    model = language.fit(docs)
    assert [r.lang_pred for r in language.predicted(docs, model).collect()] == ["und", "und"]
    assert language.predicted(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("held", [1, 50, 1 << 18])
def test_batches_equal_single_texts(monkeypatch, held):
    monkeypatch.setattr(language, "HELD", held)
    rng = np.random.default_rng(5)
    likely = np.log(rng.dirichlet(np.ones(language.BUCKETS), 3).T).astype(np.float32)
    model = language.Model(["a", "b", "c"], likely, np.log([0.5, 0.3, 0.2]))
    texts = ["some words", None, "", "12 34", "some words", "longer text " * 40, "Ünïcode — gaps"]
    got = model.predict_batch(texts)
    for text, (lang, score) in zip(texts, got, strict=True):
        total, seen = model.log_prior.copy(), False
        for part in language.buckets(text or ""):
            for bucket in part:
                total, seen = total + likely[bucket], True
        best = int(total.argmax())
        want = ("abc"[best], float(1 / np.exp(total - total[best]).sum())) if seen else ("und", 0.0)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-9)
    assert model.predict_batch([]) == []
