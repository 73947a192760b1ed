"""Short license notices in texts, also misspelt ones: exact seeds, then bounded-error matching.

A notice of m characters may differ by k edits, one for each `EDIT_EVERY` characters. Cut
into k + 1 pieces, a match with at most k edits leaves one piece whole (the pigeonhole
principle), so the places of the pieces, found by one Aho-Corasick pass over the text,
show where a match can be. Only there the regex library matches the whole notice with at
most k edits and tells the span and the edits.

Texts are compared as words: runs of ASCII digits and letters and of characters beyond
ASCII, A-Z in lower case, with one space between two words. A match begins and ends with
whole words. A place without edits, for a notice with a `base` label, is a base place:
the notice's words stand there consecutively.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waylark.llm.common import short_batches, unused

# One edit is allowed for so many characters of a notice.
EDIT_EVERY = 10


@dataclass(frozen=True)
class Notice:
    """words: lower case, single spaces; label: the license it stands for; base: whether its
    exact places are counted as base places."""

    words: str
    label: str
    base: bool = False


# Notices as licenses and their authors publish them.
NOTICES = (
    Notice("mit license", "mit", True),
    Notice("apache license", "apache", True),
    Notice("general public license", "gpl", True),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("mozilla public license", "mpl"),
    Notice("eclipse public license", "epl"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("bsd 2 clause license", "bsd"),
    Notice("bsd 3 clause license", "bsd"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc"),
    Notice("boost software license", "boost"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
    Notice("creative commons attribution", "cc-by"),
    Notice("licensed under cc by", "cc-by"),
    Notice("licensed under cc by nc", "cc-by-nc"),
    Notice("licensed under cc by sa", "cc-by-sa"),
    Notice("creative commons zero", "cc0"),
    Notice("all rights reserved", "reserved"),
)

_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
SPANS = "array<struct<label: string, base: boolean, first_word: bigint, n_words: bigint, start: bigint, end: bigint, edits: int>>"


def edits_allowed(words: str) -> int:
    return len(words) // EDIT_EVERY


def seeds(words: str) -> list[tuple[int, str]]:
    """(offset, piece): the words cut into one piece more than edits are allowed, about equally long."""
    n = edits_allowed(words) + 1
    cuts = [len(words) * k // n for k in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds the notices in texts; one for a worker process."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in seeds(notice.words):
                places.setdefault(piece, []).append((k, offset + len(piece)))
        for piece, found in places.items():
            self.seeds.add_word(piece, found)
        if places:
            self.seeds.make_automaton()
        # Enhanced matching improves the fit of a match; whole words at both ends.
        self.patterns = [
            regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n.words, literal_spaces=True)}){{e<={edits_allowed(n.words)}}}(?![^ ])")
            for n in notices]

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the stretches of the text in which all its matches lie, ascending."""
        found: dict[int, list[tuple[int, int]]] = {}
        if not len(self.seeds):
            return found
        for last, hits in self.seeds.iter(text):
            for k, after in hits:
                slack = edits_allowed(self.notices[k].words)
                # The match begins at most `slack` characters from where it would without edits.
                start = last + 1 - after - slack
                end = last + 1 - after + len(self.notices[k].words) + slack
                found.setdefault(k, []).append((max(0, start), min(len(text), end)))
        for k, spans in found.items():
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            found[k] = merged
        return found

    def verified(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a text of words with single spaces, by start.

        All exact places, and of the others those that overlap no place of the same
        notice found before them.
        """
        out = []
        for k, windows in self.windows(text).items():
            words = self.notices[k].words
            for a, b in windows:
                exact = []
                at = text.find(words, a, b)
                while at >= 0:
                    end = at + len(words)
                    if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                        exact.append((at, end))
                    at = text.find(words, at + 1, b)
                out += [(k, s, e, 0) for s, e in exact]
                # What lies between the exact places is matched with edits. A character
                # beyond each end shows whether a word ends there.
                cuts = [a, *[x for place in exact for x in place], b]
                for c, d in zip(cuts[::2], cuts[1::2], strict=True):
                    if d - c < len(words) - edits_allowed(words):
                        continue
                    # With nothing before it, the regex library does not let a match begin with an added character.
                    left, right = c - 1, min(len(text), d + 1)
                    for m in self.patterns[k].finditer(text[left:right] if c else " " + text[:right]):
                        s, e = self._trimmed(text, max(0, left + m.start()), left + m.end())
                        if c <= s < e <= d:
                            out.append((k, s, e, sum(m.fuzzy_counts)))
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Those of `verified` that no other notice explains better: with fewer edits, over
        at least four fifths of the match."""
        found = self.verified(text)
        if all(not m[3] for m in found):
            return found
        longest = max(b - a for _, a, b, _ in found)
        starts = [a for _, a, _, _ in found]
        out = []
        for k, a, b, edits in found:
            near = found[bisect.bisect_left(starts, a - longest): bisect.bisect_left(starts, b)] if edits else []
            if not any(j != k and n < edits and 5 * (min(b, d) - max(a, c)) >= 4 * (b - a) for j, c, d, n in near):
                out.append((k, a, b, edits))
        return out

    @staticmethod
    def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
        """The span without spaces at its ends."""
        while start < end and text[start] == " ":
            start += 1
        while end > start and text[end - 1] == " ":
            end -= 1
        return start, end

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[str, bool, int, int, int, int, int]]]:
        """The number of words of a text in UTF-8, and its matches: label, base, first word, words,
        first code point, code point after the last, edits."""
        spaced = (raw or b"").translate(_TO_WORDS)
        words = spaced.split()
        text = b" ".join(words).decode()
        found = self.matches(text)
        if not found:
            return len(words), []
        runs = [m.span() for m in _RUN.finditer(spaced)]
        begins, at = [], 0
        for w in words:
            begins.append(at)
            at += len(w.decode()) + 1
        out = []
        for k, start, end, edits in found:
            first, last = bisect.bisect_right(begins, start) - 1, bisect.bisect_right(begins, end - 1) - 1
            before = len(raw[: runs[first][0]].decode())
            span = len(raw[runs[first][0]: runs[last][1]].decode())
            notice = self.notices[k]
            out.append((notice.label, notice.base and not edits, first, last - first + 1, before, before + span, edits))
        return len(words), out


@cache
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def scanned(docs: DataFrame, text: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """docs with n_words and matches: label, base, first_word, n_words, start, end (code points), edits.

    Every row is scanned by its whole text alone, so repeated rows give equal results and a
    table without rows gives none. A null or empty text has no words and no matches. All
    other columns are kept; columns of these names get underscores.
    """
    short_batches(docs.sparkSession)
    chosen = tuple(notices)
    names = [unused(docs, n) for n in ("n_words", "matches")]
    row = pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()),
        ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    fields = [f.name for f in row]

    def add(batches):
        scan = scanner(chosen).scan
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            found = [scan(t.as_py()) for t in raw]
            extra = [
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([[dict(zip(fields, m, strict=True)) for m in ms] for _, ms in found], pa.list_(row))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    added = f"{names[0]} bigint, {names[1]} {SPANS}"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])
    return docs.mapInArrow(add, schema)


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def digest() -> list[Column]:
    """Columns on the matches of `scanned`: n_base, first_word, last_word, base_labels, labels, score.

    score: the best share of a notice's characters that are right; 1 for an exact place, 0
    without a match.
    """
    matches = F.col("matches")
    base = F.filter(matches, lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])
    right = F.transform(matches, lambda m: 1 - m["edits"] / F.greatest(F.lit(1), m["end"] - m["start"]))
    return [
        F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(matches).alias("labels"),
        F.greatest(F.lit(0.0), F.coalesce(F.array_max(right), F.lit(0.0))).alias("score"),
    ]
