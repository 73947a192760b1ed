"""Exact ids, token files and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waylark.llm import bitplanes, packing
from waylark.llm.tokens import ID, Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
DOCS = "doc_id bigint, text string"
TEXTS = [
    None, "", " ", "word", "Two words.", "a  b\n\n c \t d", "naïve 漢字 é1²ⅷ", "<|endoftext|> x<|endoftext|>", "it's 'll",
    "word " * 5000, "trailing \n", "\x1c\x85 odd　space", "Line one.\nLine two,\nthree",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é.,'s1²漢\n\t \x1c\x85　<|>#")), max_size=30))
def test_ids_equal_the_library(text):
    assert np.frombuffer(encoder(PATH).ids(text), ID).tolist() == library(text)


def test_ids_of_texts_and_forgetting(monkeypatch):
    own = Encoder(PATH)
    monkeypatch.setattr("waylark.llm.tokens.REMEMBERED", 3)
    for text in TEXTS * 2:
        assert np.frombuffer(own.ids(text), ID).tolist() == library(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(ID)
    planes = bitplanes.to_planes(ids, kind)
    assert len(planes) == bitplanes.PLANES[kind]
    assert bitplanes.from_planes(planes, n, kind).tolist() == ids.tolist()


def rows_for(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    random.Random(4).shuffle(rows)
    return rows, spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("x")).repartition(5)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, tmp_path, planes):
    rows, docs = rows_for(spark)
    manifest = bitplanes.write_tokens(docs, PATH, str(tmp_path / "t"), block_ids=100, planes=planes, file_ids=3000)
    assert manifest.count() > 1
    got = [tuple(r) for r in bitplanes.read_tokens(spark, manifest).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    want = sorted((i is not None, i or 0, [*library(t), 2]) for i, t in rows)
    assert sorted((i is not None, i or 0, np.frombuffer(b, ID).tolist()) for i, _, b in got) == want
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids) // 4


def test_token_files_of_nothing_and_orphans(spark, tmp_path):
    folder = tmp_path / "t"
    manifest = bitplanes.write_tokens(spark.createDataFrame([], DOCS), PATH, str(folder))
    assert bitplanes.read_tokens(spark, manifest).count() == 0
    again = bitplanes.write_tokens(spark.createDataFrame([(1, "a b")], DOCS), PATH, str(tmp_path / "u"))
    (tmp_path / "u" / "lost-attempt.tokens").write_bytes(b"half a file")
    assert [r.doc_id for r in bitplanes.read_tokens(spark, again).collect()] == [1]


def test_first_fit_decreasing_is_the_plain_rule():
    random.seed(2)
    for _ in range(50):
        room = random.randint(5, 40)
        lengths = [random.randint(1, room) for _ in range(random.randint(0, 60))]
        bins, left = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            for b, free in enumerate(left):
                if free >= lengths[i]:
                    break
            else:
                b = len(bins)
                bins.append([])
                left.append(room)
            bins[b].append(i)
            left[b] -= lengths[i]
        assert packing.first_fit_decreasing(lengths, room) == bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=40), st.sampled_from([16, 64]), st.integers(1, 8))
def test_pack_covers_each_id_once(lengths, room, least):
    sequences = packing.pack(lengths, room, least)
    seen = [[0] * n for n in lengths]
    for s in sequences:
        total = sum(n for *_, n in s)
        assert 0 < total <= room and all(n > 0 for *_, n in s)
        assert room - total < least or total & (total - 1) == 0
        for item, at, n in s:
            for k in range(at, at + n):
                seen[item][k] += 1
    assert all(c == 1 for item in seen for c in item)


def test_packed_documents(spark):
    rows, docs = rows_for(spark)
    got = packing.packed(docs, PATH, end_id=1, room=256).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    joined = sorted(((k[0] is not None, k[0] or 0), zlib.crc32(b"".join(p for _, p in sorted(v)))) for k, v in pieces.items() if k[0] != 3)
    want = sorted(((i is not None, i or 0), zlib.crc32(np.array([*library(t), 1], ID).tobytes())) for i, t in rows if i != 3)
    assert joined == want
    three = sorted((s, bytes(p)) for k, v in pieces.items() if k[0] == 3 for s, p in v)
    assert sum(len(p) for _, p in three) // 4 == sum(len(library(t)) + 1 for i, t in rows if i == 3)
    assert packing.packed(spark.createDataFrame([], DOCS), PATH).count() == 0
