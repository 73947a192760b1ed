"""Packing of documents into token sequences: first-fit decreasing on a tournament tree.

Documents are dealt at random into groups of about `GROUP_TOKENS` tokens, so that any
document can meet any other, whatever the order of the table, and a group is a bounded
amount of memory. Within a group every full sequence that a document fills by itself
is cut off first. What is left of each document is placed, longest first, into the
first open sequence with room, which a tournament tree over the free room finds in
log time. Sequences that are still open are then closed: the emptiest are taken apart
to fill the others, and the last one is cut where its lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import batched, rows_of, short_batches, stored, whole_text
from waylark.llm.tokens import ID, encoder

SEQUENCE = 2048
# Documents that meet in a group. Of each, less than a sequence is packed, so a group
# holds at most GROUP_DOCS * 2047 ids.
GROUP_DOCS = 2048
# Gaps below this are padded rather than filled by cutting another document.
LEAST_CUT = 16
PIECES = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, row bigint, packed_group bigint"
PLACED = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Room:
    """The free room of each bin in a tournament tree: the first bin with enough room in log time."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(1, bins - 1).bit_length()
        self.most = [0] * (2 * self.leaves)
        for b in range(bins):
            self.most[self.leaves + b] = room
        for k in range(self.leaves - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def first(self, need: int) -> int:
        """The first bin with room for `need`; there must be one."""
        k = 1
        while k < self.leaves:
            k *= 2
            if self.most[k] < need:
                k += 1
        return k - self.leaves

    def take(self, b: int, amount: int) -> None:
        k = self.leaves + b
        self.most[k] -= amount
        while k > 1:
            k //= 2
            most = max(self.most[2 * k], self.most[2 * k + 1])
            if self.most[k] == most:
                break
            self.most[k] = most


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """The items of each bin; longest first, ties by position. All lengths are within 1..room."""
    tree = Room(len(lengths), room)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = tree.first(lengths[item])
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
        tree.take(b, lengths[item])
    return bins


def pack(lengths: list[int], room: int = SEQUENCE, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): each id of each item lies in exactly one.

    Every sequence but those whose length is a power of two ends less than `least_cut`
    short of `room`, if it isn't full. Items of length 0 have no place.
    """
    placed: list[list[tuple[int, int, int]]] = []
    rests, owner = [], []
    for item, n in enumerate(lengths):
        full = n - n % room
        placed += [[(item, at, room)] for at in range(0, full, room)]
        if n > full:
            rests.append(n - full)
            owner.append((item, full))
    open_bins = [[(*owner[i], rests[i]) for i in b] for b in first_fit_decreasing(rests, room)]
    open_bins.sort(key=lambda b: -sum(n for *_, n in b))
    spare: list[tuple[int, int, int]] = []  # pieces of the emptiest bins, taken apart
    low, high = 0, len(open_bins) - 1
    while low <= high:
        gap = room - sum(n for *_, n in open_bins[low])
        while gap >= least_cut and (spare or low < high):
            if not spare:
                spare, high = open_bins[high][::-1], high - 1
            item, at, n = spare.pop()
            cut = min(n, gap)
            open_bins[low].append((item, at, cut))
            gap -= cut
            if cut < n:
                spare.append((item, at + cut, n - cut))
        if gap >= least_cut:
            break
        low += 1
    placed += open_bins[:low]
    # At most one bin is left, or what was taken apart: sequences of a power of two.
    left = (open_bins[low] if low <= high else []) + spare[::-1]
    total = sum(n for *_, n in left)
    while total:
        size = min(room, 1 << (total.bit_length() - 1))
        sequence, missing = [], size
        while missing:
            item, at, n = left.pop(0)
            cut = min(n, missing)
            sequence.append((item, at, cut))
            missing -= cut
            if cut < n:
                left.insert(0, (item, at + cut, n - cut))
        placed.append(sequence)
        total -= size
    return placed


def packed(docs: DataFrame, tokenizer: str, end_id: int | None = 1, room: int = SEQUENCE, seed: int = 42) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row per piece.

    docs: doc_id, text. Every row is a document of its own, repeated or with a null id;
    a null or empty text has the end id alone (none without end id). start: ids of the
    document before the piece; offset: place in the sequence, gapless from 0. Padding
    is what a sequence lacks to `room`, unless its length is a power of two. An empty
    table has no pieces.

    The group is a hash of the row's place and the seed: the same for the same files. The texts are
    read and encoded once; full sequences stay where they are, what is left of the
    documents is shuffled by group.
    """
    spark = docs.sparkSession
    short_batches(spark)
    columns = ["doc_id", "start", "ids", "doc_tokens", "row", "packed_group"]
    schema = pa.schema(list(zip(columns, [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3], strict=True)))
    # Random groups by the place of a row, so that repeated rows part too.
    salted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("deal", F.xxhash64(F.lit(seed), "row"))
    groups = max(1, -(-docs.select("doc_id").count() // GROUP_DOCS))

    def cut(batches):
        encode = encoder(tokenizer).ids
        end = np.array([] if end_id is None else [end_id], ID).tobytes()
        size = room * ID.itemsize

        def pieces():
            for doc_id, text, row, deal in rows_of(batches, "doc_id", "text", "row", "deal"):
                ids = encode(text) + end
                for at in range(0, len(ids), size):
                    part = ids[at: at + size]
                    group = None if len(part) == size else deal % groups
                    yield doc_id, at // ID.itemsize, part, len(ids) // ID.itemsize, row, group

        yield from batched(schema, pieces())

    pieces, _ = stored(salted.mapInArrow(cut, PIECES), "pieces")
    # A full piece is a sequence by itself; those numbers are negative.
    full = pieces.where("packed_group is null").select(
        "doc_id", "start", "ids", "doc_tokens",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        ids, starts = rows["ids"].tolist(), rows["start"].tolist()
        names, tokens = rows["doc_id"].tolist(), rows["doc_tokens"].tolist()
        out = []
        for number, sequence in enumerate(pack([len(i) // ID.itemsize for i in ids], room)):
            offset = 0
            for item, at, n in sequence:
                part = ids[item][at * ID.itemsize: (at + n) * ID.itemsize]
                out.append((names[item], starts[item] + at, part, tokens[item], (key[0] << 24) + number, offset))
                offset += n
        placed = pd.DataFrame(out, columns=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
        return placed.astype({"doc_id": "Int64"})

    rest = pieces.where("packed_group is not null")
    return full.union(rest.groupBy("packed_group").applyInPandas(place, PLACED))
