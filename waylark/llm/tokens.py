"""Exact ids of the tokenizers library for byte-level BPE, with repeated words encoded once.

The library spends most of its time on the same words again and again. Its splitting
pattern lets every space that is followed by a character other than white space begin
a new piece, whatever stands before it. So a text cut in front of those spaces can be
encoded part by part, and a part seen before needs no second call. Ids are the same as
those of `Tokenizer.encode(text, add_special_tokens=False)`; tests compare both.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

ID = np.dtype("<u4")
# Parts kept in memory by one worker; beyond it the memory starts anew (about 150 MB).
REMEMBERED = 600_000
_CUT = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one visible character: itself where it is
    printable, else the next free character from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class _Parts(dict):
    """The ids, as little-endian bytes, of a part with (or without) the space before it."""

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.encode = tokenizer.encode
        self.merge = tokenizer.model.tokenize
        self.lead = lead
        self.shown = _byte_characters()
        self.lead_shown = lead.translate(self.shown)
        self.raw = [i.tobytes() for i in np.arange(tokenizer.get_vocab_size(), dtype=ID)]
        self.marks = {m: self._library(m) for m in ",.:;!?\n"}
        self.after_line = self  # what follows a line end has no space before it

    def _library(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.encode(text, add_special_tokens=False).ids])

    def _merged(self, part: str) -> bytes:
        """Letters alone are one piece for the merges."""
        if part.isascii():
            shown = self.lead_shown + part
        else:
            shown = (self.lead + part).encode().decode("latin-1").translate(self.shown)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.merge(shown)])

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if _plain(part):
            ids = self._merged(part)
        elif part[-1:] in self.marks and _plain(part[:-1]):
            return self[part[:-1]] + self.marks[part[-1]]
        else:
            before, line_end, after = part.partition("\n")
            if line_end and before[-1:].strip() and after[:1].strip():
                return self[before] + self.marks[line_end] + self.after_line[after]
            ids = self._library(self.lead + part)
        if len(part) <= 64:
            self[part] = ids
        return ids


def _plain(part: str) -> bool:
    """Letters of the Latin blocks only, which every Unicode version classes alike."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0250")


class Encoder:
    """Encodes whole texts with the tokenizer in the file `path`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.rest = _Parts(self.tokenizer, ""), _Parts(self.tokenizer, " ")
        self.rest.after_line = self.first

    def ids(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # The plain split cuts at every space, which is the same unless a space stands
        # before white space or at the end.
        parts = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)
