"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint is cut into k // 2 + 1 segments for a distance of k bits, so that one
segment of a near pair differs by one bit at most. For two bits these are two halves.
A signature says which bits are fixed: a whole segment, or a segment without one bit (a
wildcard, at which the pair differs). The first segment that differs by one bit at most
decides, so later segments need fewer variants: 34 signatures for 64 bits and two.

Fingerprints that share a signature are candidates. Small buckets are compared in
place. A bucket beyond `BUCKET` is not compared: its members are cut again in the bits
that are still open, by the same rule, until at most 8 bits are open. So a group of
copies, however large, costs a fixed number of signatures per fingerprint, and no pair
is lost. Equal fingerprints are one before all this.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.llm.common import chosen_rows, row_key, short_batches, stored, unused
from waylark.llm.components import components

BITS = 64
SEED = 42
# Fingerprints of a bucket that are compared in place.
BUCKET = 48
# Open bits that are not cut further: a bucket then has 2**8 fingerprints at most,
# twice as many with a wildcard.
OPEN = 8
_CHUNK = 1 << 14
SIGNATURE_COLUMNS = ("parent", "id", "fixed", "differ", "last")
SIGNATURE = "parent int, id int, fixed bigint, differ bigint, last boolean"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text over word shingles, as a signed integer.

    A-Z are lower-cased; words are runs without space and the controls 9 to 13. Fewer
    words than the shingle length: one shingle of all. No words, or null: zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    joined = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    hashes = map(xxhash.xxh64_intdigest, joined, repeat(SEED))
    counts, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    while len(part := np.fromiter(islice(hashes, _CHUNK), "<u8")):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprinted(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the signed fingerprint of its whole text in column `name`."""
    short_batches(docs.sparkSession)

    def add(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _variants(fixed: int, differ: int, open_bits: list[int], left: int) -> list[tuple[int, int, list[int], int]]:
    """The signatures that together find all pairs which agree on `fixed`, differ in
    `differ` and differ in at most `left` of the open bits."""
    if not open_bits:
        return []
    segments = left // 2 + 1
    size = -(-len(open_bits) // segments)
    found = []
    for k in range(segments):
        # Earlier segments differ by two bits or more, or they would have decided.
        own, spare = open_bits[k * size: (k + 1) * size], left - 2 * k
        rest = open_bits[: k * size] + open_bits[(k + 1) * size:]
        whole = fixed | sum(1 << b for b in own)
        found.append((whole, differ, rest, left))
        if spare >= 1:
            found += [(whole & ~(1 << b), differ | 1 << b, rest, left - 1) for b in own]
    return found


def signatures(bits: int) -> list[tuple[int, int, int, int, bool]]:
    """parent (-1 on the first level), id, fixed, differ, last: the signatures of all levels.

    They are some 1 700 for two bits, whatever the data.
    """
    rows, queue = [], [(-1, 0, 0, list(range(BITS)), bits)]
    while queue:
        parent, fixed, differ, open_bits, left = queue.pop()
        for f, d, rest, spare in _variants(fixed, differ, open_bits, left):
            last = len(rest) <= OPEN
            rows.append((parent, len(rows), _signed(f), _signed(d), last))
            if not last:
                queue.append((len(rows) - 1, f, d, rest, spare))
    return rows


def near_pairs(prints: DataFrame, bits: int = 2) -> DataFrame:
    """a, b: all pairs of different fingerprints (column `fp`) with at most `bits` differing bits.

    Pairs may be repeated. Null fingerprints have no pairs.
    """
    rows = signatures(bits)
    table = F.broadcast(prints.sparkSession.createDataFrame(rows, SIGNATURE))
    first = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r[1:], SIGNATURE_COLUMNS[1:], strict=True)]) for r in rows if r[0] < 0])
    cut = prints.select("fp").where("fp is not null").distinct().select("fp", F.explode(first).alias("s")).select("fp", "s.*")
    found = []
    while True:
        signed = cut.select(
            "id", F.col("fp").bitwiseAND(F.col("fixed")).alias("value"), "fp",
            F.col("fp").bitwiseAND(F.col("differ")).alias("side"), "last")
        # A bucket matters if it has two fingerprints, on both sides of its wildcards.
        buckets = signed.groupBy("id", "value").agg(
            F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
        wild = table.select("id", (F.col("differ") != 0).alias("wild"))
        buckets = buckets.where("n > 1").join(wild, "id").where("not wild or low <> high").select("id", "value", "n")
        # Spark takes the exploded signatures for no larger than the fingerprints and would broadcast them.
        level, _ = stored(signed.drop("side").hint("merge").join(buckets, ["id", "value"]), "buckets")
        compared = level.where((F.col("n") <= BUCKET) | F.col("last")).groupBy("id", "value").agg(
            F.collect_list("fp").alias("all"))
        pairs = F.flatten(F.transform("all", lambda x: F.transform(
            F.filter("all", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= bits)),
            lambda y: F.struct(x.alias("a"), y.alias("b")))))
        found.append(compared.select(F.explode(pairs).alias("pair")).select("pair.*"))
        large = level.where((F.col("n") > BUCKET) & ~F.col("last"))
        if large.isEmpty():
            break
        cut = large.select("fp", F.col("id").alias("parent")).join(table, "parent")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs


def classes(prints: DataFrame, bits: int = 2) -> DataFrame:
    """fp, component_id for every different fingerprint: the smallest doc_id reachable.

    prints: doc_id, fp. Equal fingerprints are linked, the zero of empty texts like any
    other. A class whose rows all have a null doc_id has a null component_id.
    """
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_pairs(prints, bits)).withColumnRenamed("node", "fp")
    rooted, _ = stored(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (signed), component_id for every row of docs (doc_id, text).

    Every row, repeated or not, is one row of the result; no rows give an empty result.
    """
    prints, _ = stored(fingerprinted(docs.select("doc_id", "text"), shingle, name="fp").select("doc_id", "fp"), "prints")
    return prints.join(classes(prints, bits), "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of docs without near duplicates: of each class the one with the smallest doc_id.

    Ties are decided by a hash of the row; null ids come last. Columns stay as they are,
    whatever other columns docs has; any type but map will do.
    """
    a, b = unused(docs, "key_of_row"), unused(docs, "second_key")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[
        k.alias(n) for k, n in zip(row_key(*docs.columns), (a, b), strict=True)])
    prints, _ = stored(fingerprinted(slim, shingle, name="fp").drop("text"), "prints")
    # One row of each fingerprint first, so that a group of copies is small before the joins.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", a, b)
    firsts = prints.groupBy("fp").agg(F.min(order).alias("least"))
    roots = components(near_pairs(prints, bits)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    kept = rooted.select(*[F.col(f"least.{k}").alias(k) for k in (a, b)], F.lit(1).alias("copies"))
    equal = prints.groupBy(a, b).agg(F.count("*").alias("n"))
    return chosen_rows(docs, (a, b), kept.join(equal, [a, b]))
