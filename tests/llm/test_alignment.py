"""Alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waylark.llm import alignment, queries
from waylark.llm.alignment import BLOCK_DOCS, Tokenizers, bitmaps, parts, postings, segment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return Tokenizers(queries.TOKENIZER, queries.PIECES)


def plain_groups(both, text):
    """Lists of A and B ids per group, or None without tokens."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.bytes_a[x] for x in a) != raw or b"".join(both.bytes_b[x] for x in b) != raw:
        return None
    ends_a = np.cumsum([len(both.bytes_a[x]) for x in a])
    ends_b = np.cumsum([len(both.bytes_b[x]) for x in b])
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    assert (i, j) == (len(a), len(b))
    return out


def brute(both, texts):
    """The rows of the contract for a list of (doc_id, text)."""
    found = [(d, plain_groups(both, t)) for d, t in texts]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in found]
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (d, g), c in zip(found, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((
            d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, both):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_tokenizer_alignment(spark, SF)
    assert got.columns == ["doc_id", *alignment.MEASURES, "n_best", "count_sum", "groups_sha256"]
    assert result(got) == brute(both, texts)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "line\nend\n\nand\n more \n"), (6, "\ttab\r\nx"),
    (7, "<|endoftext|> <s> </s> <unk>"), (8, "a\u2581b c"), (9, "ﬁ é 汉字 漢字かな 😀😀 \u3000x"), (10, "aaaa" * 500),
    (11, "same text"), (11, "same text"), (12, "same text same text"), (None, "no id"), (13, "\nfirst"), (14, "x\x00y \x1c z"),
    (15, "It's the end... of it's 12345 things!!!"), (16, "a \nb"), (17, "a\n b"), (18, " a"), (19, "\u2581"), (20, "汉" * 3000),
]


def test_odd_texts(spark, both):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS n", "3 AS n_a", "'x' AS doc")
    assert result(alignment.aligned(df, queries.TOKENIZER, queries.PIECES)) == brute(both, ODD)
    assert result(alignment.aligned(df.limit(0), queries.TOKENIZER, queries.PIECES)) == []


def test_many_blocks(spark, both):
    """Blocks closed early and a memory that is cleared change nothing."""
    texts = [(k, f"word{k % 7} and {'and ' * (k % 5)}more {k}") for k in range(1500)] + ODD
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    want = brute(both, texts)
    got = alignment.aligned(df, queries.TOKENIZER, queries.PIECES, entries=500, remembered=50)
    assert result(got) == want
    found = alignment.inverted(df, queries.TOKENIZER, queries.PIECES, entries=500, remembered=50)
    assert found.where("place IS NOT NULL").select("block").distinct().count() > 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "a", "The", ".", "é", "汉", "'s", "9", "\t", "\r", "\xa0", "\u2581", "<s>"]), max_size=12))
def test_parts_are_the_text(pieces):
    text = "".join(pieces)
    if text:
        assert "".join(map(segment, parts(text))) == " " + text


def test_parts_encode_alike(both):
    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=" \n\taT.é汉'\r9\xa0<s>|", min_size=1, max_size=14))
    def check(text):
        segments = list(map(segment, parts(text)))
        a = np.frombuffer(b"".join(both.by_a(segments)), "<u4").tolist()
        assert a == both.a.encode(" " + text, add_special_tokens=False).ids
        assert [x for ids in both.by_b(segments) for x in ids] == both.b.encode(text)

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, BLOCK_DOCS - 1), st.integers(1, 1 << 20), min_size=1, max_size=20), max_size=6),
       st.integers(0, 2))
def test_bitmaps_round_trip(rows, wide):
    rows = [dict(sorted(r.items())) for r in rows] + [{p: 1 + p % 3 for p in range(0, BLOCK_DOCS, 5 - wide)}] * wide
    counts = np.array([len(r) for r in rows], np.int64)
    positions = np.array([p for r in rows for p in r], np.int64)
    links = np.array([n for r in rows for n in r.values()], np.int64)
    docs, planes = bitmaps(counts, positions, links)
    row, place, back = postings(counts, docs, planes)
    assert (row.tolist(), place.tolist(), back.tolist()) == (
        np.repeat(np.arange(len(rows)), counts).tolist(), positions.tolist(), links.tolist())


def test_counts_of_pairs(spark, both):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    found = alignment.inverted(df, queries.TOKENIZER, queries.PIECES)
    links = [Counter((x, y) for a, b in plain_groups(both, t) or [] for x in a for y in b) for _, t in ODD]
    got = {(r.a, r.b): (r["count"], r.links) for r in alignment.pair_counts(found).collect()}
    assert got == {p: (sum(p in c for c in links), sum(c[p] for c in links)) for p in set().union(*links)}
