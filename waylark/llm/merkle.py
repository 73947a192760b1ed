"""Document fingerprints: Merkle trees over sections, paragraphs and short passages.

Paragraphs are lines; a section is a run of paragraphs that ends at an empty line or
after `SECTION` paragraphs. A paragraph is cut into passages by its content: a cut is
where a hash of `WINDOW` characters is the least within `RADIUS` characters on either
side. So cuts depend on the paragraph alone, and meet again behind an edit. Of level k
are the cuts that are the least within RADIUS * 2^k; each is one of all lower levels too.
Where no cut comes for `WIDEST` characters (runs of one character), some are set by count.

A passage's mark is a hash of its characters, a longer one's a hash of the marks within.
The leaves of a text are its passages of level k, the least with n <= FINE * 4^k, so
their number grows with the root of its length. A paragraph's digest covers its
characters, a section's the digests of its paragraphs, the root all. Equal roots mean
equal texts. The fingerprint is the tree as a string:

    root : level : leaves      leaf = 16 bits of its mark and 8 of its length, in base 64

A leaf is followed by "/" if it ends a section, "," if it ends a paragraph, another sign
if its cut is of a higher level. So two fingerprints alone tell which branches differ, and
how alike the documents are; the finer one is made as coarse as the other first.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import batched, rows_of, short_batches, whole_text
from waylark.llm.neighbours import in_ranges

SECTION = 16
WINDOW = 4
RADIUS = 4
WIDEST = 128
FINE = 1024
# Signs behind a leaf whose cut is 1, 2, ... levels higher; the last stands for all above.
_HIGHER = b"!#$%"
_PARAGRAPH, _SECTION = b",/"
_END = 63  # the level of a line end
_SIGNS = np.zeros(256, np.int64)
_SIGNS[list(_HIGHER)] = np.arange(1, len(_HIGHER) + 1)
_SIGNS[[_PARAGRAPH, _SECTION]] = _END
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def level_of(n: int) -> int:
    """The level of the leaves of a text of n characters."""
    level = 0
    while n > FINE << 2 * level:
        level += 1
    return level


def _window_hash(codes: np.ndarray) -> np.ndarray:
    """A hash above 0 of the characters up to each one; 0 for line ends, which are cuts of every level."""
    h = codes.astype(np.uint32) * np.uint32(0x85EBCA6B)
    for back in range(1, min(WINDOW, len(codes))):
        h[back:] ^= (codes[:-back].astype(np.uint32) + np.uint32(back)) * np.uint32((0xC2B2AE35 * (2 * back + 1)) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h |= np.uint32(1)
    h[codes == 10] = 0
    return h


def cuts(codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the passages of level 0, and the level of each cut up to `top`; `_END` for ends of paragraphs."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _window_hash(codes)
    off = RADIUS << top
    # least[i]: the least of padded[i : i + width]; only cuts of one level can be cuts of the next.
    least = padded = np.zeros(n + 2 * off + 1, np.uint32)
    padded[off: off + n] = h
    at, width, level = np.arange(n), 1, np.full(n, -1, np.int8)
    for k in range(top + 1):
        while width < RADIUS << k:
            least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
        mine = h[at]
        at = at[(mine < least[at + (off - width)]) & (mine <= least[at + (off + 1)])]
        if not len(at):
            break
        level[at] = k
    level[codes == 10] = _END
    level[n - 1] = _END
    at = np.flatnonzero(level >= 0)
    # Long stretches without a cut: every WIDEST characters, of the level that the count's factors of two give.
    start = np.concatenate([[0], at[:-1] + 1])
    extra = (at - start) // WIDEST
    if extra.any():
        number = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        forced = np.repeat(start, extra) + number * WIDEST - 1
        twos = np.log2(number & -number).astype(np.int64)
        level[forced] = np.maximum(level[forced], np.minimum(twos, top))
        at = np.flatnonzero(level >= 0)
    return at + 1, level[at].astype(np.int64)


def marks(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bits for each run of values; runs end before `ends`."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    within = np.arange(len(values), dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)
    mixed = (values.astype(np.uint64) + np.uint64(1)) * _ODD[0] + within * _ODD[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[2]
    mixed ^= mixed >> np.uint64(32)
    total = np.add.reduceat(mixed, starts) * _ODD[0]
    return total >> np.uint64(48)


def _coarser(found: np.ndarray, lengths: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks, lengths and levels of the passages of level k from those of the level below."""
    last = np.flatnonzero(level >= k)
    if not len(last):
        return found, lengths, level
    ends = last + 1
    return marks(found, ends), np.add.reduceat(lengths, np.concatenate([[0], ends[:-1]])), level[last]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sections(text: str) -> list[list[str]]:
    """The paragraphs, with their line ends, of each section."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if out[-1] and (not line or len(out[-1]) >= SECTION):
            out.append([])
        out[-1].append(line + "\n")
    last = out[-1].pop()[:-1]
    if last:
        out[-1].append(last)
    return [s for s in out if s] or [[]]


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaves, each leaf a passage; joined they are the text."""
    k = level_of(len(text))
    ends, level = cuts(_codes(text), k)
    ends = ends[level >= k].tolist()
    out, at, n = [], 0, 0
    for section in _sections(text):
        out.append([])
        for paragraph in section:
            leaves, stop = [], at + len(paragraph)
            while at < stop:
                leaves.append(text[at: ends[n]])
                at, n = ends[n], n + 1
            out[-1].append(leaves)
    return out


def fingerprint(text: str) -> str:
    """The tree of a text as a string; see above."""
    roots, closing, at = [], [], 0
    for section in _sections(text):
        roots.append(_digest(b"".join([_digest(p.encode("utf-8", "surrogatepass")) for p in section])))
        at += sum(map(len, section))
        closing.append(at)  # the characters up to the section's end
    k = level_of(len(text))
    codes = _codes(text)
    ends, level = cuts(codes, k + len(_HIGHER))
    lengths = np.diff(ends, prepend=0)
    found = marks(codes, ends)
    for higher in range(1, k + 1):
        found, lengths, level = _coarser(found, lengths, level, higher)
    size = np.minimum(-(-lengths >> k), 255)
    raw = np.stack([found >> np.uint64(8), found & np.uint64(255), size.astype(np.uint64)], 1).astype(np.uint8)
    leaves = np.frombuffer(base64.urlsafe_b64encode(raw.tobytes()), np.uint8).reshape(-1, 4)
    signs = np.array([0, *_HIGHER], np.uint8)[np.clip(np.where(level == _END, 0, level - k), 0, len(_HIGHER))]
    signs[level == _END] = _PARAGRAPH
    if text:
        signs[np.searchsorted(np.cumsum(lengths), closing)] = _SECTION
    laid = np.concatenate([leaves, signs[:, None]], 1).ravel()
    return f"{_digest(b''.join(roots)).hex()}:{k:x}:{laid[laid != 0].tobytes().decode('ascii')}"


@lru_cache(maxsize=4)  # a document's fingerprint is compared with two others
def _leaves(print_: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the leaves, their lengths and which end a paragraph, at level k, the fingerprint's own or a higher one."""
    _, own, tree_ = print_.split(":")
    own = int(own, 16)
    laid = np.frombuffer(tree_.encode("ascii"), np.uint8)
    kind = _SIGNS[laid]
    raw = np.frombuffer(base64.urlsafe_b64decode(laid[kind == 0].tobytes()), np.uint8).reshape(-1, 3).astype(np.uint64)
    found, lengths = (raw[:, 0] << np.uint64(8)) | raw[:, 1], raw[:, 2].astype(np.int64)
    level = np.full(len(raw), own, np.int64)
    signed = np.flatnonzero(kind)
    if len(signed):
        place = (signed - np.arange(len(signed))) // 4 - 1
        level[place] = np.where(kind[signed] == _END, _END, own + kind[signed])
    for higher in range(own + 1, k + 1):
        found, lengths, level = _coarser(found, lengths, level, higher)
    return found, lengths << own, np.flatnonzero(level == _END)


def _pairs(leaves: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf with the one before and with the one behind it; the ends of a paragraph are empty leaves."""
    one = np.uint64(1)
    before = np.concatenate([[np.uint64(0)], leaves[:-1] + one])
    before[ends[:-1] + 1] = 0
    behind = np.concatenate([leaves[1:] + one, [np.uint64(0)]])
    behind[ends] = 0
    wide = np.uint64(32)
    return (before << wide) | (leaves + one), ((leaves + one) << wide) | behind


def _shared(pairs: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs the other side has too; a repeated one as often as it is there."""
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    nth = np.arange(len(pairs)) - np.searchsorted(ordered, ordered)
    there = np.sort(other)
    out = np.empty(len(pairs), bool)
    out[order] = nth < np.searchsorted(there, ordered, "right") - np.searchsorted(there, ordered)
    return out


def likeness(one: str, other: str) -> float:
    """How alike two documents are by their fingerprints, 0 to 1; 1 for equal roots alone.

    Where the roots differ, branches are equal where leaves are: a leaf is shared if the
    other document has it with the same neighbour on one side at least, wherever that is,
    since short marks alone agree by chance. The result is the length of the shared leaves
    of both by the length of both.
    """
    if one[:32] == other[:32]:
        return 1.0
    k = max(int(p.split(":")[1], 16) for p in (one, other))
    sides = [_leaves(p, k) for p in (one, other)]
    total = sum(int(w.sum()) for _, w, _ in sides)
    if not all(len(leaves) for leaves, _, _ in sides):
        return 0.0
    (a_left, a_right), (b_left, b_right) = (_pairs(leaves, ends) for leaves, _, ends in sides)
    same = 0
    for mine, theirs, weight in (((a_left, a_right), (b_left, b_right), sides[0][1]), ((b_left, b_right), (a_left, a_right), sides[1][1])):
        same += int(weight[_shared(mine[0], theirs[0]) | _shared(mine[1], theirs[1])].sum())
    # Short marks may agree by chance where the roots do not.
    return min(same / total, 0.999999)


def differing_paragraphs(one: str, other: str) -> list[int]:
    """Numbers of the paragraphs of the first document that the second does not have."""
    if one[:32] == other[:32]:
        return []
    k = max(int(p.split(":")[1], 16) for p in (one, other))
    sides = []
    for p in (one, other):
        leaves, _, ends = _leaves(p, k)
        sides.append([part.tobytes() for part in np.split(leaves, ends + 1)[:-1]])
    there: dict[bytes, int] = {}
    for p in sides[1]:
        there[p] = there.get(p, 0) + 1
    out = []
    for n, p in enumerate(sides[0]):
        if there.get(p):
            there[p] -= 1
        else:
            out.append(n)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id, text; null texts are empty. Order: ascending doc_id, null first, rows
    with one doc_id by their text; the last row is followed by the first, a single row
    by itself. Every row is one row of the result; no rows, an empty result. Texts are
    shuffled once, by ranges of doc_id; a task holds two documents at a time.
    """
    spark = docs.sparkSession
    short_batches(spark)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn(
        "mark", F.xxhash64("text"))
    ordered, place, role = in_ranges(slim, ["doc_id", "mark"], ["text"])
    columns = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
               ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    kinds = ["bigint", "bigint", "string", "string", "string", "double", "double"]

    def compare(batches):
        def rows():
            held, at = None, None
            for doc_id, text, k, how in rows_of(batches, "doc_id", "text", place, role):
                if k != at:
                    held, at = None, k
                if how == -1:
                    continue
                print_ = fingerprint(text)
                if held is not None:
                    own_id, own, own_print = held
                    changed = edited(own, text)
                    changed_print = fingerprint(changed)
                    yield (own_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own_print,
                           changed_print, likeness(own_print, changed_print), likeness(own_print, print_))
                held = (doc_id, text, print_) if how == 0 else None

        yield from batched(pa.schema(columns), rows())

    return ordered.mapInArrow(compare, ", ".join(f"{n} {k}" for (n, _), k in zip(columns, kinds, strict=True)))
