"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are integers. Candidates are laid out in blocks of similar vectors, and every
block keeps the least and the greatest value of each component (its term maxima, for
both signs). For a query the sum over components of the larger of q * least and
q * greatest bounds every score in the block.

The blocks of a query are ordered by that bound. A first round scores the best ones
through the blocks' rows, which gives a k-th score to beat; a second round computes the
bounds again and scores the blocks whose bound reaches it. A block below cannot hold a
better candidate, nor an equal one, so the result is exact; ties go to the smaller id.

Queries and blocks meet in a grid: parts of the chunks of queries, tiles of blocks, both
of at most about `TILE_BYTES` and more of them than tasks where there are enough. A group
of the grid hands on `FIRST` blocks for each query in round one, and in round two its k
best scores; bounds of queries and blocks are never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylark.llm.common import batched, partitions, rows_of, short_batches, stored

SCALE = 1024
# Vectors of a block, queries of a chunk, and bytes of vectors on either side of a group of the grid.
BLOCK = 256
CHUNK = 256
TILE_BYTES = 16 << 20
# Vectors, those with the smallest hash of their id, that similar ones are gathered around.
PIVOTS = 128
# Blocks that the first round scores for each query.
FIRST = 3
# Whole numbers below this are exact in double arithmetic.
EXACT = 1 << 53
# Scores held for a chunk before those beyond the k best go.
HELD = 1 << 20
LOWEST = -(1 << 63)
# n vectors of a group: ids, row numbers, values row by row, least and greatest values.
GROUP = "place bigint, n int, dims int, kind string, ids binary, own binary, rows binary, low binary, high binary"
_GROUP = pa.schema([("place", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()),
                    *[(c, pa.binary()) for c in ("ids", "own", "rows", "low", "high")]])
FOUND = "own bigint, query_id bigint, score bigint, vec_id bigint, row bigint"
_FOUND = pa.schema([(c, pa.int64()) for c in ("own", "query_id", "score", "vec_id", "row")])
_EARLY = [("chunk", pa.int64()), ("block", pa.int64()), ("query", pa.int32()), ("bound", pa.int64())]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dims, v (array of bigint floor(scale * x)) of the vectors that take part.

    Null vectors, empty ones and those with null or non-finite components don't, nor
    rows without an id. vectors: vec_id, embedding.
    """
    doubles = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    usable = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.coalesce(F.forall("e", finite), F.lit(False))
    return doubles.where(usable).select(
        "vec_id", F.size("e").alias("dims"), F.transform("e", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, exactly: doubles where they suffice, else 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block the greatest score that a vector of the block can have."""
    return product(np.maximum(queries, 0), high) + product(np.minimum(queries, 0), low)


def best(queries: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, at: np.ndarray, rows: np.ndarray,
         k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best rows that reach `least`, ties to the
    smaller id; the row `own` is left out."""
    out = []
    for scores, me, floor in zip(product(queries, rows), own.tolist(), least.tolist(), strict=True):
        use = np.flatnonzero((at != me) & (scores >= floor))
        if len(use) > k:  # all that reach the k-th score, before the exact order
            use = use[scores[use] >= np.partition(scores[use], len(use) - k)[len(use) - k]]
        order = use[np.lexsort((at[use], ids[use], -scores[use]))][:k]
        out.append((order, scores[order]))
    return out


def _matrix(data: bytes, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims)


def _kind(values: np.ndarray) -> str:
    """The narrowest integers that hold the values."""
    most = int(max(values.max(), -(values.min() + 1)))
    return next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)


def gathered(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with the pivot that each is most similar to."""

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array([
            int(product(np.array([x], np.int64), pivots[len(x)])[0].argmax()) if len(x) in pivots else -1
            for x in v.to_pylist()], pa.int32())

    return vectors.withColumn("pivot", nearest("v"))


def grouped(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of at most `size` neighbouring vectors, of equal dimensions, in the order of pivots."""

    def group(batches):
        def packed(held: list[tuple], number: int) -> tuple:
            m = np.array([r[2] for r in held], np.int64)
            kind = _kind(m)
            ids, own = (np.array([r[c] for r in held], "<i8").tobytes() for c in (0, 3))
            ends = (m.min(axis=0).astype("<i8").tobytes(), m.max(axis=0).astype("<i8").tobytes())
            return (held[0][4] << 32) + number, len(held), held[0][1], kind, ids, own, m.astype(kind).tobytes(), *ends

        def rows():
            held, number = [], 0
            for row in rows_of(batches, "vec_id", "dims", "v", "row", "part"):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield packed(held, number)
                    held, number = [], number + 1
                held.append(row)
            if held:
                yield packed(held, number)

        yield from batched(_GROUP, rows(), 16)

    order = ["dims", "pivot", "vec_id", "row"]
    laid = vectors.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return laid.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(group, GROUP)


def _scored(tiles: DataFrame, chunks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """own, query_id, score, vec_id, row: the k best of each wanted query in each of the blocks named."""

    def score(batches):
        def rows():
            names = ("dims", "wanted", "q_kind", "q_ids", "q_own", "q_rows", "kind", "ids", "own", "rows")
            for dims, wanted, q_kind, q_ids, q_own, q_rows, kind, ids, own, values in rows_of(batches, *names):
                wanted = np.array(wanted)
                asked, mine = _matrix(q_rows, dims, q_kind)[wanted], np.frombuffer(q_own, "<i8")[wanted]
                names_, at = np.frombuffer(ids, "<i8"), np.frombuffer(own, "<i8")
                found = best(asked, mine, np.full(len(wanted), LOWEST), names_, at, _matrix(values, dims, kind), k)
                for me, query, (places, scores) in zip(mine.tolist(), np.frombuffer(q_ids, "<i8")[wanted].tolist(), found, strict=True):
                    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
                        yield me, query, s, int(names_[p]), int(at[p])

        yield from batched(_FOUND, rows(), 4096)

    asked = chunks.select(F.col("place").alias("chunk"), *[F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "own", "rows")])
    held = blocks.select(F.col("place").alias("block"), "dims", "kind", "ids", "own", "rows")
    paired = tiles.join(asked, "chunk").join(held, "block").repartition(partitions(tiles.sparkSession))
    return paired.mapInArrow(score, FOUND)


class Kept:
    """The k best scores of each query of a chunk so far, and the score to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.held, self.n = least.copy(), k, [], 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        self.held.append((query, score, ids, at))
        self.n += len(query)
        if self.n > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Keeps the k best of each query, ties to the smaller id, and raises what must be reached."""
        query, score, ids, at = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((at, ids, -score, query))
        query, score, ids, at = (c[order] for c in (query, score, ids, at))
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        full = nth == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        use = nth < self.k
        self.held, self.n = [tuple(c[use] for c in (query, score, ids, at))], int(use.sum())
        return self.held[0]


def searched(chunk: dict, blocks: list[dict], k: int) -> Iterator[tuple]:
    """The k best rows of some blocks for each query of a chunk that reach its `least`.

    Blocks come in the order of their highest bound; of each only the queries whose bound
    reaches the score to beat are scored, and that score rises on the way.
    """
    dims = chunk["dims"]
    asked, mine, names = _matrix(chunk["rows"], dims, chunk["kind"]), np.frombuffer(chunk["own"], "<i8"), np.frombuffer(chunk["ids"], "<i8")
    low, high = (np.stack([np.frombuffer(b[c], "<i8") for b in blocks]) for c in ("low", "high"))
    limit = bounds(asked, low, high)
    kept = Kept(np.array(chunk["least"], np.int64), k)
    for j in np.argsort(-limit.max(axis=0), kind="stable").tolist():
        use = np.flatnonzero(limit[:, j] >= kept.least)
        if not len(use):
            continue
        block = blocks[j]
        ids, at = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["own"], "<i8")
        scores = product(asked[use], _matrix(block["rows"], dims, block["kind"]))
        q, r = np.nonzero((scores >= kept.least[use][:, None]) & (mine[use][:, None] != at))
        kept.add(use[q], scores[q, r], ids[r], at[r])
    query, score, ids, at = kept.settle()
    yield from zip(mine[query].tolist(), names[query].tolist(), score.tolist(), ids.tolist(), at.tolist(), strict=True)


def _tiled(chunks: DataFrame, blocks: DataFrame, sizes: tuple[int, int], wanted: list[str], held: list[str]):
    """Chunks and blocks as a grid: every part of the chunks meets every tile of the blocks in one group."""
    parts, tiles = sizes

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int, columns: list[str]):
        return rows.select(
            "dims", "place", *columns, F.pmod(F.xxhash64("place"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("dims", "part", "tile")

    return dealt(chunks, "part", parts, "tile", tiles, wanted).cogroup(dealt(blocks, "tile", tiles, "part", parts, held))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`,
    candidates all rows but the query's own, with the same number of components. Fewer
    than k candidates: all of them. Every row is a query or candidate of its own, also
    when ids repeat. No rows give an empty result.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    whole, _ = stored(integers(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample: dict[int, list] = {}
    for r in whole.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).collect():
        sample.setdefault(r.dims, []).append(r.v)
    placed = gathered(whole, {dims: np.array(v, np.int64) for dims, v in sample.items()})
    blocks, _ = stored(grouped(placed, BLOCK), "blocks")
    chunks, _ = stored(grouped(placed.where(F.col("vec_id") % every == 0), CHUNK), "chunks")

    # Queries and blocks meet in a grid of bounded groups: the stated query set against all rows, in blocks.
    def cells(groups: DataFrame) -> int:
        held = groups.agg(F.sum(F.octet_length("rows"))).first()[0] or 0
        return max(-(-held // TILE_BYTES), min(partitions(spark), groups.count()), 1)

    sizes = max(-(-cells(chunks) // partitions(spark)), 1), cells(blocks)

    # Round one: the blocks with the highest bounds of each query. A group hands on FIRST for each of its queries.
    def highest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names = np.array(right["place"].to_pylist(), np.int64)
            low, high = (np.stack([np.frombuffer(b, "<i8") for b in right[c].to_pylist()]) for c in ("low", "high"))
            for chunk in left.to_pylist():
                found = bounds(_matrix(chunk["rows"], chunk["dims"], chunk["kind"]), low, high)
                for query, limit in enumerate(found):
                    order = np.lexsort((names, -limit))[:FIRST]
                    out += [(chunk["place"], names[j], query, limit[j]) for j in order]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(_EARLY, columns, strict=True)})

    bounded = _tiled(chunks, blocks, sizes, ["kind", "rows"], ["low", "high"]).applyInArrow(
        highest, "chunk bigint, block bigint, query int, bound bigint")
    order = Window.partitionBy("chunk", "query").orderBy(F.desc("bound"), "block")
    early = bounded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST).groupBy("chunk", "block").agg(
        F.collect_list("query").alias("wanted"))
    first, _ = stored(_ranked(_scored(early, chunks, blocks, k), k).drop("rank"), "first")
    beat = first.groupBy("own").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)

    # Round two: what the k-th score doesn't rule out. Queries short of k see every block.
    def named(batches):
        out = pa.schema([("chunk", pa.int64()), ("query", pa.int32()), ("own", pa.int64())])
        yield from batched(out, ((chunk, n, me) for chunk, own in rows_of(batches, "place", "own")
                                 for n, me in enumerate(np.frombuffer(own, "<i8").tolist())), 4096)

    limits = chunks.select("place", "own").mapInArrow(named, "place bigint, query int, own bigint").join(beat, "own", "left").groupBy(
        "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("query", F.coalesce("least", F.lit(LOWEST)).alias("least")))),
                                 lambda x: x["least"]).alias("least"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        held = right.to_pylist()
        found = [r for chunk in left.to_pylist() for r in searched(chunk, held, k)] if held else []
        columns = list(zip(*found, strict=True)) or [[]] * len(_FOUND)
        return pa.table([pa.array(v, pa.int64()) for v in columns], schema=_FOUND)

    found = _tiled(chunks.join(limits, "place"), blocks, sizes, ["kind", "ids", "own", "rows", "least"],
                   ["kind", "ids", "own", "rows", "low", "high"]).applyInArrow(search, FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
