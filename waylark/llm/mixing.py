"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The target of each source is turned into whole blocks: every block goes to the source
with the highest quotient target / (2 * blocks so far + 1). The same rule then deals a
source's blocks to its shards, random parts of bounded size. Within a shard the quota
is met by whole passes over all documents, by blocks of neighbouring documents in
seeded order, and at last by the choice among its shortest documents, held back for it,
whose sum comes nearest, so every document is taken a whole number of times.

What comes to the driver is a row per source and a row per shard of `SHARD_DOCS`
documents; documents stay in the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import WORD, chosen_rows, row_key, stored, unused, whole_text

BLOCK_WORDS = 512
# Blocks that the smallest table is cut into at least, as long as it has as many words.
LEAST_BLOCKS = 20_000
SHARD_DOCS = 1 << 14
MOST = 3
# The shortest documents of a shard that are held back for the last choice, and the steps
# that its sums are told apart by.
FINE_DOCS = 128
FINE_STEPS = 1 << 19
# Rows of a table of sources or shards that are broadcast; a row has a name and numbers.
BROADCAST_ROWS = 50_000


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2k + 1); equal quotients go to the earlier one.

    Rounding at one common divisor gives the result for some number of seats near the
    wanted one; the few that lack or exceed follow one by one.
    """
    total = sum(weights)
    if total <= 0:
        return [0] * len(weights)
    found = [int(seats * w / total + 0.5) for w in weights]
    spare = seats - sum(found)
    if spare > 0:
        queue = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, found, strict=True)) if w > 0]
        heapq.heapify(queue)
        for _ in range(spare):
            _, i = heapq.heappop(queue)
            found[i] += 1
            heapq.heappush(queue, (-weights[i] / (2 * found[i] + 1), i))
    else:
        queue = [(w / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, found, strict=True)) if k > 0]
        heapq.heapify(queue)
        for _ in range(-spare):
            i = -heapq.heappop(queue)[1]
            found[i] -= 1
            if found[i]:
                heapq.heappush(queue, (weights[i] / (2 * found[i] - 1), -i))
    return found


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST) -> list[float]:
    """The words of each source: all words by weight, none above `most` times its size.

    What a full source can't take is shared again by weight among the others.
    """
    found = [0.0] * len(sizes)
    open_ones, left = [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_ones:
        weight = sum(weights[i] for i in open_ones)
        full = [i for i in open_ones if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_ones:
                found[i] = left * weights[i] / weight
            break
        for i in full:
            found[i] = float(most * sizes[i])
        left -= sum(found[i] for i in full)
        open_ones = [i for i in open_ones if i not in set(full)]
    return found


def nearest_sum(sizes: list[int], wanted: int) -> list[int]:
    """Positions of a choice of the sizes whose sum is as near to `wanted` as any, the smaller of two.

    Bit k of a number says whether the sum k can be reached with the sizes so far. Beyond
    `FINE_STEPS` words sums are told apart by steps of several words, so the choice can
    miss the best one by a step for each size.
    """
    step = 1 + wanted // FINE_STEPS
    if step > 1:
        sizes, wanted = [round(n / step) for n in sizes], wanted // step
    reach = [1]
    for n in sizes:
        reach.append((reach[-1] | reach[-1] << n) & ((1 << 2 * wanted + 1) - 1))
    below = (reach[-1] & (1 << wanted + 1) - 1).bit_length() - 1
    above = reach[-1] >> wanted
    over = (above & -above).bit_length() - 1 if above else wanted + 1
    total = below if wanted - below <= over else wanted + over
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> total & 1:
            chosen.append(i)
            total -= sizes[i]
    return chosen


def copies(sizes: list[int], quota: int, block_words: int, most: int = MOST) -> list[int]:
    """How often each document, in the given order, is taken so that about `quota` words come out."""
    total = sum(sizes)
    if not total:
        return [0] * len(sizes)
    quota = min(quota, most * total)
    passes, left = divmod(quota, total)
    found = [passes] * len(sizes)
    if not left:
        return found
    held = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (sizes[i], i))[:FINE_DOCS]
    room = sum(sizes[i] for i in held)
    kept_back = set(held)
    blocks: dict[int, list[int]] = {}
    at = 0
    for i, n in enumerate(sizes):
        if n and i not in kept_back:
            blocks.setdefault(at // block_words, []).append(i)
            at += n
    spare = []
    for block in blocks.values():  # the order is random already, so are the first blocks
        words = sum(sizes[i] for i in block)
        if words <= left:
            left -= words
            for i in block:
                found[i] += 1
        else:
            spare += block
    single = []
    for i in spare:
        if left > room and sizes[i] <= left:
            left -= sizes[i]
            found[i] += 1
        else:
            single.append(i)
    fits = held + [i for i in single if sizes[i] <= 2 * left][:FINE_DOCS]
    for k in nearest_sum([sizes[i] for i in fits], left):
        found[fits[k]] += 1
    return found


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def _named(source: str) -> Column:
    """The source as a key that tells null from any name."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has few rows; else the join is shuffled and AQE splits
    the partitions of sources that hold a large share."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(sized: DataFrame, row: str, size: str, mark: str, tie: str, source: str = "source", seed: int = 42,
        weights: dict[str | None, float] | None = None) -> DataFrame:
    """row, source_size, target, copies for each row of `sized`, a stored table of row (unique), size, mark, tie, source.

    Order and shards follow from the seed and mark, a hash of what the row holds, and
    among equal ones from tie, another; the number of the row decides only among rows
    equal in both. So the same rows are taken however they lie in files and partitions.
    Sources by code point, null last, weigh 1, 2, 3, repeating, if no weights are
    given. A table without words, or without rows, takes nothing.
    """
    spark = sized.sparkSession
    slim = sized.select(F.col(row).alias("row"), F.col(size).alias("size"), F.col(mark).alias("mark"), F.col(tie).alias("tie"), _named(source).alias("name"))
    sums = slim.groupBy("name").agg(F.count("*").alias("docs"), F.sum("size").alias("size")).collect()
    sums.sort(key=lambda r: (r.name == "-", r.name))
    own = [weights[None if r.name == "-" else r.name[1:]] if weights else 1 + k % 3 for k, r in enumerate(sums)]
    wanted = targets([r.size for r in sums], own)
    total = sum(r.size for r in sums)
    block = max(1, min(BLOCK_WORDS, total // LEAST_BLOCKS))
    blocks = dict(zip([r.name for r in sums], sainte_lague(wanted, total // block), strict=True))
    plan = _small(spark.createDataFrame(
        [(r.name, r.size, t, -(-r.docs // SHARD_DOCS)) for r, t in zip(sums, wanted, strict=True)],
        "name string, source_size bigint, target double, shards int"), len(sums))
    dealt = slim.join(plan, "name").withColumn("order", F.xxhash64(F.lit(seed), "mark")).withColumn(
        "shard", F.pmod("order", "shards"))
    parts: dict[str, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("name", "shard").agg(F.sum("size").alias("size")).orderBy("name", "shard").collect():
        parts.setdefault(r.name, []).append((r.shard, r.size))
    quotas = [
        (name, shard, q * block)
        for name, cells in parts.items()
        for (shard, _), q in zip(cells, sainte_lague([n for _, n in cells], blocks[name]), strict=True)
    ]
    cells = dealt.join(
        _small(spark.createDataFrame(quotas, "name string, shard bigint, quota bigint"), len(quotas)), ["name", "shard"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "mark", "tie", "row"])
        rows["copies"] = copies(rows["size"].tolist(), int(rows["quota"].iloc[0]), block)
        return rows[["row", "source_size", "target", "copies"]]

    return cells.groupBy("name", "shard").applyInPandas(
        choose, "row bigint, source_size bigint, target double, copies int")


def _mark(docs: DataFrame) -> Column:
    return row_key(*[c for c in ("doc_id", "text", "source") if c in docs.columns])[0]


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row of docs (doc_id, text, source).

    size: words of the text, none for null. taken: size times the copies that the mix takes.
    """
    sized, _ = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", words().alias("size"),
        _mark(docs).alias("mark"), F.monotonically_increasing_id().alias("row")), "sized")
    return sized.join(mix(sized, "row", "size", "mark", "mark", seed=seed), "row").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixture(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they are.

    Rows that are equal in all columns share the copies that they get together. Columns
    may have any type but map.
    """
    a, b, mark = (unused(docs, n) for n in ("key_of_row", "second_key", "mark_of_row"))
    keys = [k.alias(n) for k, n in zip(row_key(*docs.columns), (a, b), strict=True)]
    sized, _ = stored(docs.select(
        "source", words().alias("size"), _mark(docs).alias(mark), F.monotonically_increasing_id().alias("row"), *keys), "sized")
    taken = sized.select("row", a, b).join(mix(sized, "row", "size", mark, a, seed=seed).select("row", "copies"), "row")
    chosen = taken.groupBy(a, b).agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 0")
    return chosen_rows(docs, (a, b), chosen)
