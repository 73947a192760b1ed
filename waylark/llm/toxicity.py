"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, for each word, the different labelled texts of both classes that hold
it. The log-odds between the classes get an informative Dirichlet
prior (pseudo-counts in proportion to the overall frequency); a word counts with the
lower bound of its confidence interval, so chance words score nothing. A token scores
its log-odds less a constant drift, which makes clean text drift down. How sure the bound
is and how high a word must score to count at all are chosen by cross-fitting: each
quarter of the training texts is judged with words scored by the other three quarters.

Scoring finds all maximal-scoring segments of a text in one pass. For random clean text
the best segment follows an extreme-value law, P(best < s) = exp(-K n exp(-lambda s));
lambda solves sum p exp(lambda s) = 1 for the clean token frequencies, K is fitted on
the clean training texts, judged as above. Segments beyond chance are significant; their
normalised scores add up to the document's, of which the same law gives the score between
0 and 1; without a significant segment the best one counts, below any cut. The cut between
the classes, fitted in the same way, lies at 0.5.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.llm.common import batched, rows_of, short_batches, stored, unused

# Labelled documents used to fit the model, those with the smallest hash of their id.
TRAIN_ROWS = 200_000
# Prior pseudo-counts, in parts of the training texts.
PRIOR = 0.05
# Standard errors that the log-odds are lowered by, as tried; with few labels only the lower
# ones leave words.
SURES = (2.6, 1.6, 0.8)
# A word counts if so many toxic training texts hold it, or all of them if they are fewer.
LEAST_TEXTS = 2
# Parts of the training texts, each judged by the others.
QUARTERS = 4
DRIFT = 0.05
# Distinct words that a counting task holds before it hands them on.
HELD = 300_000
_WORD = re.compile(r"[^\W\d_]+")
COUNT_COLUMNS = [f"{c}{k}" for k in range(QUARTERS) for c in ("clean", "toxic")]
COUNTS = ", ".join(["word string", *[f"{c} bigint" for c in COUNT_COLUMNS]])
# Least scores of a word that are tried.
GRADES = (0.05, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall((text or "").lower())


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float, prior: float = PRIOR, sure: float = SURES[0]) -> float:
    """Lower confidence bound of the log-odds of a word, with an informative Dirichlet prior."""
    weight = prior * (toxic + clean)
    total = prior * (n_toxic + n_clean)
    a, b = toxic + weight, clean + weight
    odds = math.log(a / (n_toxic + total - a)) - math.log(b / (n_clean + total - b))
    return odds - sure * math.sqrt(1 / a + 1 / b)


@dataclass
class Model:
    """scores: log-odds of the words above zero; rate, scale: lambda and K; cut: at 0.5."""

    scores: dict[str, float]
    rate: float = 1.0
    scale: float = 1e-3
    cut: float = 0.0

    def token_scores(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Positions and scores of the tokens above zero."""
        get, at, found = self.scores.get, [], []
        for k, w in enumerate(words):
            if s := get(w):
                at.append(k)
                found.append(s - DRIFT)
        return at, found

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first token, token after the last, score, normalised score) of the significant segments."""
        at, found = self.token_scores(words)
        return [s for s in self.normalised(maximal_segments(at, found), len(words)) if s[3] > 0]

    def normalised(self, segments: list[tuple[int, int, float]], words: int) -> list[tuple[int, int, float, float]]:
        base = math.log(self.scale * max(1, words))
        return [(start, end, score, self.rate * score - base) for start, end, score in segments]

    def score(self, segments: list[tuple[int, int, float, float]]) -> float:
        """Between 0 and 1 for the significant segments of a text; 0 without any."""
        return self._probability(sum(s[3] for s in segments)) if segments else 0.0

    def judged(self, words: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The score of a text and its significant segments. Without any the best segment
        ranks the text, below 0.5; a text without a token above zero scores 0."""
        found = self.normalised(maximal_segments(*self.token_scores(words)), len(words))
        significant = [s for s in found if s[3] > 0]
        if found and not significant:
            return self._probability(min(-1e-6, max(s[3] for s in found))), []
        return self.score(significant), significant

    def _probability(self, x: float) -> float:
        x -= self.cut + math.log(math.log(2))
        return math.exp(-math.exp(-min(50.0, max(-6.5, x))))


def maximal_segments(at: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa), in linear time.

    Tokens at the given positions have the given positive scores, all others -drift.
    """
    # Each candidate: first, after last, sum before it, sum up to its end, and the link to
    # the nearest candidate before it that has a smaller sum before it.
    found: list[tuple[int, int, float, float, int]] = []
    total, after = 0.0, 0
    for k, s in zip(at, scores, strict=True):
        total -= drift * (k - after)
        first, left = k, total
        total += s
        after = k + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, after, left, total, j))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def held_out(folds: int = 5, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, quarter: the different texts of the labelled documents that are not held out.

    Ids with several labels count as toxic if one is. At most `rows` ids are used, which
    bounds the broadcast table of labels and the texts that are shuffled here.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("mark")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")).select(
        "text", "toxic", F.pmod(F.xxhash64("mark"), F.lit(QUARTERS)).cast("int").alias("quarter"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, and for each quarter the different clean and toxic texts in it that hold the word; "" counts the texts."""

    def count(batches):
        schema = pa.schema([("word", pa.string()), *[(c, pa.int64()) for c in COUNT_COLUMNS]])

        def rows():
            sums = [Counter() for _ in COUNT_COLUMNS]

            def handed():
                for w in set().union(*sums):
                    yield w, *[c[w] for c in sums]
                for c in sums:
                    c.clear()

            for text, toxic, quarter in rows_of(batches, "text", "toxic", "quarter"):
                sums[2 * quarter + bool(toxic)].update({*tokens(text), ""})
                if sum(map(len, sums)) > HELD:
                    yield from handed()
            yield from handed()

        yield from batched(schema, rows(), 10_000)

    return texts.mapInArrow(count, COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def _lowered(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """`log_odds` of all words for each of `SURES`, by row; 0 where it is below, for words in too
    few toxic texts and where a class is missing."""
    if not n_toxic or not n_clean:
        return np.zeros((len(SURES), len(toxic)))
    weight, total = PRIOR * (toxic + clean), PRIOR * (n_toxic + n_clean)
    a, b = toxic + weight + 1e-300, clean + weight + 1e-300
    odds = np.log(a / (n_toxic + total - a)) - np.log(b / (n_clean + total - b))
    lowered = odds - np.array(SURES)[:, None] * np.sqrt(1 / a + 1 / b)
    return np.where(toxic >= min(LEAST_TEXTS, n_toxic), np.maximum(0.0, lowered), 0.0)


def word_scores(counts: DataFrame, n_clean: list[int], n_toxic: list[int]) -> DataFrame:
    """word, score (by all training texts), rest (for each quarter by the texts outside it), for each of
    `SURES`; clean and both, the texts that hold it. Words without a score above the drift are left out."""
    named = [f"{c}{k}" for c in ("clean", "toxic") for k in range(QUARTERS)]
    numbers = pa.list_(pa.float64())
    schema = pa.schema([("word", pa.string()), ("score", numbers), ("rest", pa.list_(numbers)), ("clean", pa.int64()), ("both", pa.int64())])

    def score(batches):
        for batch in batches:
            held = np.array([batch.column(c).to_numpy() for c in named]).reshape(2, QUARTERS, -1)
            clean, toxic = held.sum(axis=1)
            every = _lowered(toxic, clean, float(sum(n_toxic)), float(sum(n_clean)))
            rest = np.array([
                _lowered(toxic - held[1, k], clean - held[0, k], float(sum(n_toxic) - n_toxic[k]), float(sum(n_clean) - n_clean[k]))
                for k in range(QUARTERS)])
            use = np.flatnonzero((every.max(axis=0) > DRIFT) | (rest.max(axis=(0, 1)) > DRIFT))
            yield pa.RecordBatch.from_arrays([
                batch.column("word").take(pa.array(use)), pa.array(every[:, use].T.tolist(), numbers),
                pa.array(rest[:, :, use].transpose(2, 0, 1).tolist(), pa.list_(numbers)),
                pa.array(clean[use]), pa.array((clean + toxic)[use])], schema=schema)

    return counts.where("word <> ''").select("word", *named).mapInArrow(
        score, "word string, score array<double>, rest array<array<double>>, clean bigint, both bigint")


# How words are scored, as tried: the sureness of the bound and the least score.
GRID = [(s, g) for s in range(len(SURES)) for g in GRADES]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled documents outside the held-out fold.

    Without documents of both classes nothing is toxic. What comes to the driver: the
    words with log-odds above zero at the least sure bound, bounded by the training rows, and
    for each grade the numbers of training texts by their statistic.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts, _ = stored(training_texts(docs, labels, folds, rows), "training")
    counts, _ = stored(word_counts(texts), "words")
    n = counts.where("word = ''").first()
    clean, toxic = ([n[f"{c}{k}"] if n else 0 for k in range(QUARTERS)] for c in ("clean", "toxic"))
    if not sum(clean) or not sum(toxic):
        return Model({})

    kept = word_scores(counts, clean, toxic).collect()
    shared = spark.sparkContext.broadcast({r.word: np.array(r.rest) for r in kept})

    def judge(batches):
        schema = pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("grade", pa.int32()), ("scores", pa.list_(pa.float64()))])

        def found():
            known = shared.value
            for text, toxic, quarter in rows_of(batches, "text", "toxic", "quarter"):
                words = tokens(text)
                hits = [(k, known[w][quarter].tolist()) for k, w in enumerate(words) if w in known]
                for grade, (s, least) in enumerate(GRID):
                    own = [(k, x[s]) for k, x in hits if x[s] >= max(least, 2 * DRIFT)]
                    segments = maximal_segments([k for k, _ in own], [x - DRIFT for _, x in own])
                    yield int(bool(toxic)), len(words), grade, [x for *_, x in segments]

        yield from batched(schema, found(), 2_000)

    seen, _ = stored(texts.select("text", "toxic", "quarter").mapInArrow(
        judge, "toxic int, words bigint, grade int, scores array<double>"), "segments")
    length = float(seen.where("toxic = 0").agg(F.avg("words")).first()[0] or 1.0)
    total = PRIOR * (sum(clean) + sum(toxic))
    chances = [(r.score, (r.clean + PRIOR * r.both) / (sum(clean) + total)) for r in kept]
    rates = [_rate([(x[s] - DRIFT, p) for x, p in chances if x[s] >= max(least, 2 * DRIFT)], length) for s, least in GRID]
    at = F.col("grade") + 1
    rate, top = F.element_at(F.array(*map(F.lit, rates)), at), F.coalesce(F.array_max("scores"), F.lit(0.0))
    scales = [1e-3] * len(GRID)
    for r in seen.where("toxic = 0").groupBy("grade").agg(
            F.sum((top > 0).cast("int")).alias("hit"), F.sum(F.col("words") * F.exp(-rate * top)).alias("exposed")).collect():
        scales[r.grade] = max(r.hit or 0, 0.5) / max(r.exposed or 1.0, 1.0)
    base = F.log(F.element_at(F.array(*map(F.lit, scales)), at) * F.greatest(F.lit(1), F.col("words")))
    x = F.aggregate(F.transform("scores", lambda s: F.greatest(F.lit(0.0), rate * s - base)), F.lit(0.0), lambda p, q: p + q)
    # How many texts of both classes lie in each twentieth of the statistic.
    cells = seen.select("grade", "toxic", F.least(F.lit(4000), F.ceil(x * 20)).alias("cell")).groupBy("grade", "cell").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("grade", "cell").collect()
    cuts = [_cut([(r.cell / 20, r.n - r.toxic, r.toxic) for r in cells if r.grade == g]) for g in range(len(GRID))]
    # The surest bound whose texts on the wrong side are as few as the fewest, give or take
    # their root; of its equally good grades the middle one.
    fewest = min(wrong for wrong, _ in cuts)
    sure = min(GRID[g][0] for g, (wrong, _) in enumerate(cuts) if wrong <= fewest + math.sqrt(fewest))
    own = [g for g in range(len(GRID)) if GRID[g][0] == sure]
    good = [g for g in own if cuts[g][0] == min(cuts[k][0] for k in own)]
    g = good[len(good) // 2]
    sure, least = GRID[g]
    return Model({r.word: r.score[sure] for r in kept if r.score[sure] >= max(least, 2 * DRIFT)}, rates[g], scales[g], cuts[g][1])


def _rate(scores: list[tuple[float, float]], words: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, where a text of `words` tokens holds a
    word once with the given chance and all other tokens score -DRIFT."""
    s = np.array([x for x, _ in scores])
    p = np.array([y for _, y in scores]) / max(1.0, words)
    rest = max(0.0, 1.0 - p.sum())
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        if rest * math.exp(-DRIFT * mid) + float((p * np.exp(np.minimum(700.0, mid * s))).sum()) > 1:
            high = mid
        else:
            low = mid
    return low


def _cut(cells: list[tuple[float, int, int]]) -> tuple[int, float]:
    """The fewest texts on the wrong side of a value, and that value, in the middle of equally good ones."""
    wrong = sum(t for x, _, t in cells if x <= 0) + sum(c for x, c, _ in cells if x > 0)
    best, found, values = wrong, [0.0], [x for x, _, _ in cells if x > 0]
    for k, (x, clean, toxic) in enumerate(c for c in cells if c[0] > 0):
        wrong += toxic - clean
        after = values[k + 1] - 0.05 if k + 1 < len(values) else x
        if wrong < best:
            best, found = wrong, [x, after]
        elif wrong == best:
            found.append(after)
    return best, (found[0] + found[-1]) / 2


def scored(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """docs with score, predicted and segments: array of (start, end, score), in tokens.

    Every row is scored by its text alone. Null, empty or letterless texts score 0.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [unused(docs, n) for n in ("score", "predicted", "segments")]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def add(batches):
        model = shared.value
        for batch in batches:
            judged = [model.judged(tokens(t)) for t in batch.column("text").to_pylist()]
            values, found = [v for v, _ in judged], [s for _, s in judged]
            extra = [
                pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32()),
                pa.array([[{"start": a, "end": b, "score": s} for a, b, s, _ in f] for f in found], spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    added = f"{names[0]} double, {names[1]} int, {names[2]} array<struct<start: bigint, end: bigint, score: double>>"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])
    return docs.mapInArrow(add, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns as they are."""
    predicted = unused(docs, "predicted")
    return scored(docs, fit(docs, labels)).where(F.col(predicted) == 0).select(*docs.columns)
