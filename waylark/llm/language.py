"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of other characters than letters becomes one gap, and
all n-grams of 1 to 3 characters, gaps included, are hashed into a fixed number of
buckets. The model is a matrix of log-probabilities, buckets by languages, whose size is
fixed but for the number of languages; it is broadcast. A batch is scored in numpy:
its sparse counts (text, bucket) are multiplied by the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.llm.common import batched, row_key, short_batches, unused

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
# Training documents of each language, about; the ones with the smallest hashes.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
UNKNOWN = "und"
# Characters that are handled at once, so that memory doesn't grow with a text.
CHUNK = 1 << 18
# Odd multipliers for the places of an n-gram, and the last mix.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LAST = np.uint64(0xD6E8FEB86659FD93)
_GAP = np.uint32(32)
# N-grams of a batch of texts that are counted and multiplied together.
HELD = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, chunk by chunk; nothing if it has no letter."""
    letters, held = _letters(), np.array([_GAP], np.uint32)
    for start in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[start: start + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate([held, np.where(letters[codes], codes, _GAP)])
        # A gap that follows a gap goes.
        codes = codes[np.concatenate([[True], (codes[1:] != _GAP) | (codes[:-1] != _GAP)])]
        yield from _grams(codes, len(held))
        held = codes[-(max(ORDERS) - 1):]
    if held[-1] != _GAP:
        yield from _grams(np.append(held, _GAP), len(held))


def _grams(codes: np.ndarray, old: int) -> Iterator[np.ndarray]:
    """N-grams that end behind the first `old` characters."""
    wide = codes.astype(np.uint64)
    for n in ORDERS:
        first = max(0, old - n + 1)
        if len(wide) == old or len(wide) - first < n:
            continue
        mixed = np.full(len(wide) - first - n + 1, n, np.uint64)
        for k in range(n):
            mixed += wide[first + k: len(wide) - n + 1 + k] * _PLACES[k]
        mixed ^= mixed >> np.uint64(29)
        yield ((mixed * _LAST) >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    """languages in order; log-probabilities (buckets x languages); log-priors."""

    languages: list[str]
    log_likely: np.ndarray
    log_prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text: sparse counts (text, bucket) times the matrix,
        multiplied whenever about `HELD` n-grams have come together, however the texts end."""
        totals, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        parts: list[np.ndarray] = []
        held = 0
        for k, text in enumerate(texts):
            for part in buckets(text or ""):
                seen[k] = True
                parts.append(part + k * BUCKETS)
                held += len(part)
                if held >= HELD:
                    self._multiply(parts, totals)
                    parts, held = [], 0
        if parts:
            self._multiply(parts, totals)
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        totals += self.log_prior
        best = totals.argmax(axis=1)
        score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.languages[b], float(p)) if s else (UNKNOWN, 0.0) for b, p, s in zip(best, score, seen, strict=True)]

    def _multiply(self, parts: list[np.ndarray], totals: np.ndarray) -> None:
        cells, n = np.unique(np.concatenate(parts), return_counts=True)
        rows, columns = cells // BUCKETS, cells % BUCKETS
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        totals[rows[first]] += np.add.reduceat(n[:, None] * self.log_likely[columns].astype(float), first, axis=0)


def held_out(folds: int = 3, remainder: int = 1, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == remainder, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the documents that are not held out and have a language.

    docs: doc_id, text, lang. About `rows` documents of each language are counted, all
    if there are fewer. To the driver come the languages with their numbers of
    documents, and the counts of buckets by language. Without such documents every
    prediction is unknown.
    """
    spark = docs.sparkSession
    short_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    parts = 1_000_000
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(parts, -(-rows * parts // sizes[lang]))).otherwise(share)
    sample = usable.where(F.pmod(row_key("doc_id", "text")[0], F.lit(parts)) < share).select("lang", "text")

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

        def sums():
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    held = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for part in buckets(text):
                        held += np.bincount(part, minlength=BUCKETS)
            for lang, held in found.items():
                for k in np.flatnonzero(held).tolist():
                    yield lang, k, int(held[k])

        yield from batched(schema, sums(), 10_000)

    counts = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {lang: k for k, lang in enumerate(languages)}
    for batch in counts.toArrow().to_batches():
        at = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
        table[batch.column("bucket").to_numpy(), at] += batch.column("n").to_numpy()
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the probability of that language; from the text alone.

    Null texts and texts without a letter are `und` with score 0. Rows stay as they are.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [unused(docs, n) for n in ("lang_pred", "score")]

    def add(batches):
        model = shared.value
        for batch in batches:
            found = model.predict_batch(batch.column(text).to_pylist())
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    return docs.mapInArrow(add, T.StructType([
        *docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
