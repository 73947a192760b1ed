"""Alignment of two tokenizers over a corpus by inverted bitmaps of id pairs.

Both tokenizers cut the same bytes. Where a token of A and a token of B end together, a
group ends; the A and B tokens of a group are linked. For every pair of ids the corpus is
asked in how many documents it is linked, and every document gets the sums of these
counts over its links.

The documents are numbered in blocks. A task builds for each pair and block a compressed
bitmap of the documents that link it (sorted positions, or plain bits where that is
shorter) and, beside it, bit planes of how often: plane k holds bit k of the links less
one, a bit for each set document. The bitmaps of a pair are disjoint unions of those of
its blocks, so their popcounts add up to the pair's documents, and the planes to its
links. A pair's count then goes back along its postings, block by block.

Encoding is cached by parts of a text. A part begins at a space or line end between two
other characters; both tokenizers always cut there (A by its pattern, B as none of its
pieces holds a space behind another character, nor a line end), so parts are encoded,
aligned and linked one by one, and most have been seen before.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from waylark.llm.common import partitions, short_batches, stored
from waylark.llm.tokens import ID, Encoder

# Documents of a block; positions in it fit 16 bits.
BLOCK_DOCS = 4096
# A block is closed early beyond so many (document, part) entries, whatever its documents.
BLOCK_ENTRIES = 2_000_000
# A bitmap with more set documents than this is kept as plain bits, as that is shorter.
DENSE = BLOCK_DOCS // 16
# Parts that a worker remembers, with at most a hundred times as many characters.
REMEMBERED = 300_000
# Blocks that a task of the last step holds sums of, about.
BLOCKS_A_TASK = 64
PAIR = 1 << 16

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"[ \n](?:\s|\Z)|\A\s|\s\n")
_WHITE = re.compile(r"[^\S \n]")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _visible_bytes() -> dict[str, int]:
    """Byte-level BPE shows each byte as one character: itself where printable, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.cached = Encoder(path_a)
        self.a = self.cached.tokenizer
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = _visible_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("\u2581", " ").encode())
            if not self.b.is_byte(k) and ("\n" in piece or "\u2581" in piece.lstrip("\u2581")):
                raise ValueError(f"texts can't be cut in parts for a tokenizer with the piece {piece!r}")

    def by_a(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment by A, as little-endian 32-bit integers; it begins with a space or a line end."""
        after_space, after_line = self.cached.rest, self.cached.first
        line_end = after_line.marks["\n"]
        return [after_space[s[1:]] if s[0] == " " else line_end + after_line[s[1:]] for s in segments]

    def by_b(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment by B, which adds a space: the segment's own, or one more before a line end."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [ids if s[0] == " " else ids[1:] for s, ids in zip(segments, found, strict=True)]


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _odd(text: str) -> bool:
    """Whether a space or line end is not between two other characters. Most texts without white
    space beyond those are told by plain searches."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return True
    return bool(_WHITE.search(text) and _ODD.search(text))


def parts(text: str) -> list[str]:
    """Keys of the parts of space+text, see `segment`."""
    if not _odd(text):
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == " " and s[1:2].strip() else s for s in _CUT.split(" " + text)]


def segment(key: str) -> str:
    """The part that a key stands for: the key, with a space in front if it begins with none."""
    return " " + key if key[:1].strip() else key


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(_offsets(counts)[:-1], counts)


def groups(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) in each group; both sides have the same bytes in all."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return tuple(np.diff(np.searchsorted(ends, common) + 1, prepend=0) for ends in (ends_a, ends_b))


# Token pairs of a group up to which they are written out one by one.
PLAIN_LINKS = 256


def linked(ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of all groups, ascending by group; a pair may come again in its group.

    Where a group has many token pairs the work follows its different ids.
    """
    size = in_a * in_b
    plain = np.where(size <= PLAIN_LINKS, size, 0)
    group, rank = np.repeat(np.arange(len(size)), plain), _ranks(plain)
    a = ids_a[_offsets(in_a)[:-1][group] + rank // in_b[group]]
    b = ids_b[_offsets(in_b)[:-1][group] + rank % in_b[group]]
    found = [(group, a * PAIR + b, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(size > PLAIN_LINKS).tolist():
        first_a, first_b = int(in_a[:g].sum()), int(in_b[:g].sum())
        a, n = np.unique(ids_a[first_a: first_a + in_a[g]], return_counts=True)
        b, m = np.unique(ids_b[first_b: first_b + in_b[g]], return_counts=True)
        found.append((np.full(len(a) * len(b), g), (a[:, None] * PAIR + b).ravel(), (n[:, None] * m).ravel()))
    if len(found) == 1:
        return found[0]
    group, pair, links = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], links[order]


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.held = np.zeros(1024, dtype)
        self.size = 0

    def add(self, values: list | np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, len(self.held)), self.held.dtype)])
        self.held[self.size:need] = values
        self.size = need


class Parts:
    """What is known of each part: its text in the digest, its measures and its linked pairs."""

    def __init__(self, found: Tokenizers):
        self.tokenizers = found
        self.lengths_a = np.array([len(x) for x in found.bytes_a])
        self.lengths_b = np.array([len(x) for x in found.bytes_b])
        ids = max(len(found.bytes_a), len(found.bytes_b))
        # Each id as text with what follows it: the same side, the other side, the next group, nothing.
        self.shown = np.array([[f"{k}," for k in range(ids)], [f"{k}|" for k in range(ids)],
                               [f"{k};" for k in range(ids)], [str(k) for k in range(ids)]], object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.chars = 0
        self.bad: set[int] = set()
        self.measures = [_Column(np.int64) for _ in MEASURES]
        self.first, self.many = _Column(np.int64), _Column(np.int64)
        self.pairs, self.links = _Column(np.int64), _Column(np.int64)

    def full(self, remembered: int) -> bool:
        return len(self.text) > remembered or self.chars > 100 * remembered

    def learn(self, keys: Iterable[str]) -> None:
        new = [k for k in keys if k not in self.number]
        for at in range(0, len(new), 4096):
            self._learn(new[at:at + 4096])

    def _learn(self, keys: list[str]) -> None:
        segments = [segment(k) for k in keys]
        by_a, by_b = self.tokenizers.by_a(segments), self.tokenizers.by_b(segments)
        known = len(self.text)
        self.number.update(zip(keys, range(known, known + len(keys)), strict=True))
        self.chars += sum(map(len, keys))
        for k in self._not_given_back(segments, by_a, by_b):
            by_a[k], by_b[k] = b"", []
            self.bad.add(known + k)
        n_a, n_b = np.array(list(map(len, by_a))) // 4, np.array(list(map(len, by_b)))
        ids_a = np.frombuffer(b"".join(by_a), ID).astype(np.int64)
        ids_b = np.array(list(chain.from_iterable(by_b)), np.int64)
        in_a, in_b = groups(self.lengths_a[ids_a], self.lengths_b[ids_b])
        # Parts end with a group, so the groups of a part follow from its A tokens.
        upto = np.searchsorted(np.cumsum(in_a), np.cumsum(n_a), side="right")
        n_groups = np.diff(upto, prepend=0)
        group, pair, links = linked(ids_a, ids_b, in_a, in_b)
        last = np.searchsorted(group, upto)
        many = np.diff(last, prepend=0)
        n_links = np.diff(_offsets(in_a * in_b)[upto], prepend=0)
        self.text += self._texts(ids_a, ids_b, in_a, in_b, upto, n_a + n_b)
        self.first.add(self.pairs.size + last - many)
        self.many.add(many)
        self.pairs.add(pair)
        self.links.add(links)
        for column, values in zip(self.measures, (n_a, n_b, n_groups, n_links), strict=True):
            column.add(values)

    def _not_given_back(self, segments: list[str], by_a: list[bytes], by_b: list[list[int]]) -> list[int]:
        """The segments that differ from the bytes of A or B."""
        raw = [s.encode() for s in segments]
        bytes_a, bytes_b = self.tokenizers.bytes_a.__getitem__, self.tokenizers.bytes_b.__getitem__
        back = [b"".join(map(bytes_b, ids)) for ids in by_b]
        out = [k for k, (r, b) in enumerate(zip(raw, back, strict=True)) if r != b]
        whole = np.frombuffer(b"".join(by_a), ID).tolist()
        if b"".join(map(bytes_a, whole)) != b"".join(raw):
            out += [k for k, (r, a) in enumerate(zip(raw, by_a, strict=True)) if b"".join(map(bytes_a, np.frombuffer(a, ID).tolist())) != r]
        return out

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray,
               upto: np.ndarray, tokens: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2 for each part: the tokens of a group by side, groups in order."""
        begin = _offsets(in_a + in_b)[:-1]
        at_a = np.repeat(begin, in_a) + _ranks(in_a)
        at_b = np.repeat(begin + in_a, in_b) + _ranks(in_b)
        kind = np.zeros(len(ids_a) + len(ids_b), np.int64)
        kind[begin + in_a - 1] = 1
        kind[begin + in_a + in_b - 1] = 2
        ends = np.cumsum(tokens)
        kind[ends[tokens > 0] - 1] = 3
        ids = np.zeros(len(kind), np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        shown = self.shown[kind, ids].tolist()
        return ["".join(shown[e - n: e]) for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]


@cache
def known_parts(path_a: str, path_b: str) -> Parts:
    """One memory of parts for a worker process."""
    return Parts(tokenizers(path_a, path_b))


# --- bitmaps ----------------------------------------------------------------------------

def _set_bits(size: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """`size` bytes with the given bits of the given bytes set; no bit is named twice."""
    return np.bincount(at, weights=1 << bit, minlength=size).astype(np.uint8)


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = _offsets(lengths).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the offsets of its rows in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def bitmaps(counts: np.ndarray, positions: np.ndarray, links: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bitmap and the planes of each run of `counts` postings (ascending positions, links >= 1)."""
    dense = counts > DENSE
    size = np.where(dense, BLOCK_DOCS // 8, 2 * counts)
    begin = np.repeat(_offsets(size)[:-1], counts)
    in_dense = np.repeat(dense, counts)
    data = np.zeros(int(size.sum()), np.uint8)
    at = positions[in_dense]
    if len(at):
        data = _set_bits(len(data), begin[in_dense] + (at >> 3), at & 7)
    rank = _ranks(counts)
    at, thin = begin[~in_dense] + 2 * rank[~in_dense], positions[~in_dense]
    data[at], data[at + 1] = thin & 255, thin >> 8
    extra = links - 1
    deepest = np.maximum.reduceat(extra, _offsets(counts)[:-1]) if len(counts) else extra
    planes = np.zeros(len(counts), np.int64)
    while (more := deepest >> planes.clip(max=62) > 0).any():
        planes += more
    width = (counts + 7) // 8
    begin = np.repeat(_offsets(planes * width)[:-1], counts)
    wide = np.repeat(width, counts)
    held = np.zeros(int((planes * width).sum()), np.uint8)
    for k in range(int(planes.max(initial=0))):
        hit = (extra >> k & 1).astype(bool)
        held |= _set_bits(len(held), begin[hit] + k * wide[hit] + (rank[hit] >> 3), rank[hit] & 7)
    return _binaries(data, size), _binaries(held, planes * width)


def postings(counts: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, links) of all postings: the reverse of `bitmaps`."""
    counts = counts.astype(np.int64)
    row, rank = np.repeat(np.arange(len(counts)), counts), _ranks(counts)
    data, offsets = _data(docs)
    dense = counts > DENSE
    in_dense = np.repeat(dense, counts)
    positions = np.zeros(len(row), np.int64)
    at = offsets[row[~in_dense]] + 2 * rank[~in_dense]
    positions[~in_dense] = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    if dense.any():
        whole = np.concatenate([data[offsets[k]: offsets[k + 1]] for k in np.flatnonzero(dense)])
        positions[in_dense] = np.flatnonzero(np.unpackbits(whole, bitorder="little")) % BLOCK_DOCS
    data, offsets = _data(planes)
    width = (counts + 7) // 8
    depth = np.diff(offsets) // np.maximum(1, width)
    links = np.ones(len(row), np.int64)
    for k in range(int(depth.max(initial=0))):
        has = depth[row] > k
        r, n = row[has], rank[has]
        links[has] += (data[offsets[r] + k * width[r] + (n >> 3)].astype(np.int64) >> (n & 7) & 1) << k
    return row, positions, links


# --- the steps --------------------------------------------------------------------------

class _Block:
    """The (pair, position, links) entries of a block's documents."""

    def __init__(self):
        self.docs, self.size = 0, 0
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, known: Parts, docs: np.ndarray, numbers: np.ndarray) -> None:
        """Documents of a batch (positions in it) and the parts they hold, a row for each time."""
        key, times = np.unique(docs.astype(np.int64) << 32 | numbers, return_counts=True)
        place, part = self.docs + (key >> 32), key & 0xFFFFFFFF
        many = known.many.held[part]
        at = np.repeat(known.first.held[part], many) + _ranks(many)
        key = known.pairs.held[at] * BLOCK_DOCS + np.repeat(place, many)
        self.entries.append(_summed(key, known.links.held[at] * np.repeat(times, many)))
        self.size += len(self.entries[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all batches, OR-merged: pair * BLOCK_DOCS + position, ascending, and links."""
        if not self.entries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _summed(*[np.concatenate(x) for x in zip(*self.entries, strict=True)])


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(values[order], begin) if len(key) else values


def _schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("block", pa.int64()), ("place", pa.int32()), ("doc", key), *[(m, pa.int64()) for m in MEASURES],
        ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32()),
        ("links", pa.int64()), ("docs", pa.binary()), ("planes", pa.binary())])


def _pair_rows(block: int, key: np.ndarray, links: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pair = key // BLOCK_DOCS
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.concatenate([begin[1:], [len(key)]])
    for at in range(0, len(begin), 20_000):
        first, last = begin[at:at + 20_000], ends[at:at + 20_000]
        own = slice(int(first[0]), int(last[-1]))
        counts = last - first
        docs, planes = bitmaps(counts, key[own] % BLOCK_DOCS, links[own])
        which, n = pair[first], len(first)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, block)), *[pa.nulls(n, f.type) for f in list(schema)[1:8]],
            pa.array((which // PAIR).astype(np.int32)), pa.array((which % PAIR).astype(np.int32)),
            pa.array(counts.astype(np.int32)), pa.array(np.add.reduceat(links[own], first - first[0])), docs, planes,
        ], schema=schema)


def _inverted(batches: Iterable[pa.RecordBatch], known: Parts, schema: pa.Schema, entries: int, remembered: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents and, at the end of each block, of its pairs."""
    first, number = TaskContext.get().partitionId() << 32, 0
    block = _Block()
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS // 16):
            rows = batch.slice(at, BLOCK_DOCS // 16)
            texts = rows.column(1).to_pylist()
            split = [parts(t) if t else [] for t in texts]
            known.learn(dict.fromkeys([p for s in split for p in s]))
            get = known.number.__getitem__
            numbers = [list(map(get, s)) for s in split]
            if known.bad:
                numbers = [[] if not known.bad.isdisjoint(n) else n for n in numbers]
            counts = np.array([len(n) for n in numbers])
            flat = np.array([x for n in numbers for x in n], np.int64)
            docs = np.repeat(np.arange(len(numbers)), counts)
            sums = [np.zeros(len(numbers), np.int64) for _ in MEASURES]
            for s, column in zip(sums, known.measures, strict=True):
                np.add.at(s, docs, column.held[flat])
            digest = [
                hashlib.sha256(";".join([known.text[x] for x in n]).encode()).hexdigest() if n else "" for n in numbers]
            n = len(numbers)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, first + number)), pa.array(np.arange(block.docs, block.docs + n, dtype=np.int32)),
                rows.column(0), *map(pa.array, sums), pa.array(digest, pa.string()),
                *[pa.nulls(n, f.type) for f in list(schema)[8:]]], schema=schema)
            if len(flat):
                block.add(known, docs, flat)
            block.docs += n
            if block.docs + BLOCK_DOCS // 16 > BLOCK_DOCS or block.size > entries:
                yield from _pair_rows(first + number, *block.merged(), schema)
                block, number = _Block(), number + 1
                if known.full(remembered):
                    known.clear()
    yield from _pair_rows(first + number, *block.merged(), schema)


def _returned(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents with the sums over their postings; all rows of a block are here."""
    slot: dict[int, int] = {}
    sums = np.zeros((2, 8, BLOCK_DOCS), np.int64)
    held: list[tuple[int, pa.RecordBatch]] = []
    for batch in batches:
        for b in batch.column("block").unique().to_pylist():
            slot.setdefault(b, len(slot))
        if len(slot) > sums.shape[1]:
            sums = np.concatenate([sums, np.zeros((2, max(len(slot), sums.shape[1]), BLOCK_DOCS), np.int64)], axis=1)
        of_doc = batch.column("place").is_valid()
        docs, pairs = batch.filter(of_doc), batch.filter(batch.column("place").is_null())
        for b in docs.column("block").unique().to_pylist():
            held.append((slot[b], docs.filter(pc.equal(docs.column("block"), b))))
        if pairs.num_rows:
            row, place, links = postings(pairs.column("n").to_numpy(), pairs.column("docs"), pairs.column("planes"))
            at = np.array([slot[b] for b in pairs.column("block").to_pylist()])[row] * BLOCK_DOCS + place
            best = pairs.column("best").to_numpy(zero_copy_only=False)[row]
            flat = sums.reshape(2, -1)
            np.add.at(flat[0], at, links * best)
            np.add.at(flat[1], at, links * pairs.column("count").to_numpy()[row])
    for k, docs in held:
        place = docs.column("place").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [*[docs.column(f.name) for f in list(out)[:-2]], pa.array(sums[0, k, place]), pa.array(sums[1, k, place])],
            schema=out)


def inverted(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
             entries: int = BLOCK_ENTRIES, remembered: int = REMEMBERED) -> DataFrame:
    """Rows of documents (place is set) and of pairs with their bitmaps in a block, written to the shared folder."""
    short_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc"].dataType
    schema = _schema(to_arrow_type(kind))
    measures = ", ".join(f"{m} bigint" for m in MEASURES)
    ddl = f"block bigint, place int, doc {kind.simpleString()}, {measures}, groups_sha256 string, a int, b int, n int, links bigint, docs binary, planes binary"

    def invert(batches):
        return _inverted(batches, known_parts(path_a, path_b), schema, entries, remembered)

    return stored(slim.mapInArrow(invert, ddl), "inverted")[0]


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, count (documents that link the pair), links (in all), best: whether no pair of
    the A id has a higher count. Written to the shared folder."""
    counts, _ = stored(found.where("a IS NOT NULL").groupBy("a", "b").agg(
        F.sum("n").alias("count"), F.sum("links").alias("links")), "counts")
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))
    return stored(counts.join(tops, "a").select("a", "b", "count", "links", (F.col("count") == F.col("top")).alias("best")), "best")[0]


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
            entries: int = BLOCK_ENTRIES, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs.

    A encodes space+text (byte-level, tokenizers library), B the text (sentencepiece,
    which adds the space). Texts that are null or empty, or whose bytes one of the two
    doesn't give back, have no tokens: zeros and an empty digest. n_best: links whose pair
    has the highest count of its A id, ties included; count_sum: the counts of all links.
    Repeated rows are documents of their own. No rows give none. Other columns are left out.
    """
    spark = docs.sparkSession
    found = inverted(docs, path_a, path_b, doc_id, text, entries, remembered)
    counts = pair_counts(found)
    own = found.where("place IS NOT NULL").select("block", "place", "doc", *MEASURES, "groups_sha256")
    scored = found.where("a IS NOT NULL").select("a", "b", "block", "n", "docs", "planes").join(
        counts.select("a", "b", "count", "best"), ["a", "b"]).drop("a", "b")
    rows = own.unionByName(scored, allowMissingColumns=True)
    blocks = found.where("place IS NOT NULL").select("block").distinct().count()
    result = own.drop("block", "place").selectExpr("*", "0L AS n_best", "0L AS count_sum")
    out = to_arrow_schema(result.schema)
    dealt = rows.repartition(max(partitions(spark), blocks // BLOCKS_A_TASK), "block")
    summed = dealt.mapInArrow(lambda batches: _returned(batches, out), result.schema)
    return summed.select(F.col("doc").alias(doc_id), *MEASURES, "n_best", "count_sum", "groups_sha256")
