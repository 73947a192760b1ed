"""Token files: fixed-size id blocks, transposed into planes, each compressed.

File layout, all integers little-endian:

    8 bytes    magic
    planes     for each block, its planes one after another, each a zstandard frame
    index      for each block: position (u64), ids (u32), then the length of each plane (u32)
    documents  doc_id (i64), null mark (u8), ids (u64), as three zstandard frames
    footer     blocks, block size, planes, kind of plane, documents (u64 each),
               lengths of the index and of the three frames (u64 each), magic

Ids are unsigned 32-bit integers. With `planes="byte"` a block becomes 4 planes, with
`"bit"` 32 planes; the high planes of a small vocabulary are zero and cost nothing.
A reader finds any block by the index and needs no other one.

Files are written by tasks into the shared folder under names of their own. The
manifest, a table that Spark commits, names the files that count: what a lost or
repeated task left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waylark.llm.common import batched, opened, partitions, qualified, rows_of, short_batches, whole_text
from waylark.llm.tokens import ID, encoder

MAGIC = b"WLPLANE1"
BLOCK_IDS = 1 << 16
PLANES = {"byte": 4, "bit": 32}
FILE_IDS = 1 << 26
_FOOTER = struct.Struct("<9Q8s")
MANIFEST = "file string, first_doc bigint, first_hash bigint, file_no int, n_docs bigint, n_ids bigint"
READ = "doc_id bigint, start bigint, ids binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block: plane p holds byte (or bit) p of every id."""
    octets = np.ascontiguousarray(ids.astype(ID)).view(np.uint8).reshape(-1, ID.itemsize)
    if kind == "byte":
        return [p.tobytes() for p in octets.T]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little").T
    return np.ascontiguousarray(np.stack(list(rows), axis=1)).view(ID).reshape(-1)


class Writer:
    """One file; holds no more than a block and the list of its documents."""

    def __init__(self, uri: str, block_ids: int, kind: str):
        self.uri, self.block_ids, self.kind = uri, block_ids, kind
        system, path = opened(uri)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.index: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.n_open = self.n_ids = 0
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.n_ids += len(ids)
        while len(ids):
            taken = ids[: self.block_ids - self.n_open]
            self.open.append(taken)
            self.n_open += len(taken)
            ids = ids[len(taken):]
            if self.n_open == self.block_ids:
                self._block()

    def _block(self) -> None:
        frames = [self.pack(p) for p in to_planes(np.concatenate(self.open), self.kind)]
        self.index.append(struct.pack(f"<QI{len(frames)}I", self.at, self.n_open, *map(len, frames)))
        for frame in frames:
            self.out.write(frame)
            self.at += len(frame)
        self.open, self.n_open = [], 0

    def close(self) -> None:
        if self.n_open:
            self._block()
        columns = zip(*self.docs, strict=True) if self.docs else [()] * 3
        kinds = ("<i8", "u1", "<u8")
        frames = [self.pack(np.array(c, k).tobytes()) for c, k in zip(columns, kinds, strict=True)]
        index = b"".join(self.index)
        for part in (index, *frames):
            self.out.write(part)
        self.out.write(_FOOTER.pack(
            len(self.index), self.block_ids, PLANES[self.kind], self.kind == "bit", len(self.docs),
            len(index), *map(len, frames), MAGIC,
        ))
        self.out.close()


class Reader:
    """Documents of one file, block by block."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        blocks, self.block_ids, planes, is_bit, n_docs, n_index, *lengths, magic = _FOOTER.unpack(
            self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.kind = "bit" if is_bit else "byte"
        entry = struct.Struct(f"<QI{planes}I")
        start = size - _FOOTER.size - n_index - sum(lengths)
        self.index = list(entry.iter_unpack(self._at(start, n_index)))
        if len(self.index) != blocks:
            raise ValueError(f"broken index: {uri}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        columns, at = [], start + n_index
        for length, kind in zip(lengths, ("<i8", "u1", "<u8"), strict=True):
            columns.append(np.frombuffer(self.unpack(self._at(at, length)), kind))
            at += length
        self.docs = list(zip(*[c.tolist() for c in columns], strict=True))

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index[k]
        frames = []
        for length in lengths:
            frames.append(self.unpack(self._at(at, length)))
            at += length
        return from_planes(frames, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) in the order of writing."""
        block, used, k, start = np.zeros(0, ID), 0, 0, 0
        for doc_id, is_null, n in self.docs:
            parts, missing = [], n
            while missing:
                if used == len(block):
                    block, used, k = self.block(k), 0, k + 1
                parts.append(block[used: used + missing])
                used += len(parts[-1])
                missing -= len(parts[-1])
            yield (None if is_null else doc_id), start, np.concatenate(parts) if parts else block[:0]
            start += n

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, block_ids: int = BLOCK_IDS,
    planes: str = "byte", file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the ids of all documents as token files; returns the committed manifest.

    docs: doc_id, text (other columns are not read). Order: ascending doc_id, null
    first; rows with the same doc_id by their text. A null or empty text has the end
    id alone. Repeated rows are written as often as they occur. Without rows the
    manifest is empty. A file holds at most `file_ids` ids unless one document has more.

    The only shuffle sorts the texts by ranges of doc_id.
    """
    spark = docs.sparkSession
    short_batches(spark)
    folder = qualified(spark, folder)

    def write(batches):
        encode = encoder(tokenizer).ids
        end = np.array([] if end_id is None else [end_id], ID)
        held, first, file_no = None, None, 0
        schema = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("first_hash", pa.int64()),
                            ("file_no", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

        def done():
            held.close()
            return held.uri, *first, file_no, len(held.docs), held.n_ids

        def files():
            nonlocal held, first, file_no
            for doc_id, mark, text in rows_of(batches, "doc_id", "mark", "text"):
                ids = np.concatenate([np.frombuffer(encode(text), ID), end])
                if held is not None and held.n_ids + len(ids) > file_ids:
                    yield done()
                    held, file_no = None, file_no + 1
                if held is None:
                    held = Writer(f"{folder}/{uuid.uuid4().hex}.tokens", block_ids, planes)
                    first = first or (doc_id, mark)
                held.add(doc_id, ids)
            if held is not None:
                yield done()

        yield from batched(schema, files())

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark", "text")
    )
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids, read back from the files.

    The running total goes over one row per file. A file is the range of one task, cut
    at `FILE_IDS`, so those rows are as many as the tasks that wrote.
    """
    short_batches(spark)
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_hash", "file_no").rowsBetween(
        Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

        def documents():
            for uri, base in rows_of(batches, "file", "base"):
                reader = Reader(uri)
                for doc_id, start, ids in reader.documents():
                    yield doc_id, base + start, ids.tobytes()
                reader.close()

        yield from batched(schema, documents())

    return files.repartition(partitions(spark)).mapInArrow(read, READ)
