"""License notices against a brute-force word scan and a plain edit distance."""

import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from waylark.llm import licenses, queries
from waylark.llm.licenses import NOTICES, Notice, Scanner, edits_allowed, seeds

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_labels(text):
    """Labels with a run of whole words within the allowed edits."""
    words = text.split(" ")
    out = set()
    for n in NOTICES:
        k = edits_allowed(n.words)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if len(run) > len(n.words) + k:
                    break
                if len(run) >= len(n.words) - k and distance(run, n.words) <= k:
                    out.add(n.label)
    return out


def digests(df):
    return df.select("doc_id", "n_words", *licenses.digest()).collect()


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_license_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    some = 0
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1.0 or not r.n_base) and (r.score > 0) == (r.labels != "")
        some += r.n_base
    assert some > 0


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "MIT-License, the\nmit\tLICENSE"), (5, "the MIT Licence"),
        (6, "MIT license MIT license license"), (7, "submit license to commit licenses"),
        (8, "GNU Lesser General Public License"), (9, "Licensed under CC BY-NC 4.0."),
        (10, "ÄMIT License mit licensé"), (4, "MIT-License, the\nmit\tLICENSE"), (11, "x " * 50_000 + "Apache License"),
        (None, "Apache Licence Version 2.0"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS n_words", "1 AS matches")
    found = licenses.scanned(df)
    assert found.columns == ["doc_id", "text", "n_words", "matches", "n_words_", "matches_"]
    plain = found.select("doc_id", "text", found.n_words_.alias("n_words"), found.matches_.alias("matches"))
    got = {r.doc_id: r for r in digests(plain)}
    assert len(rows) == plain.count() and sum(r.doc_id == 4 for r in digests(plain)) == 2
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
    assert (got[1].labels, got[1].score, got[4].n_base) == ("", 0.0, 2)
    assert got[5].labels == "mit" and got[5].base_labels == "" and 0.9 < got[5].score < 1
    assert got[7].labels == "" and got[8].labels == "gpl,lgpl" and got[9].labels == "cc-by,cc-by-nc"
    assert got[11].first_word == 50_000 and got[None].labels == "apache"
    span = next(r for r in plain.collect() if r.doc_id == 5).matches[0]
    assert "the MIT Licence"[span.start:span.end] == "MIT Licence" and span.edits == 1
    assert licenses.scanned(df.limit(0)).count() == 0


def test_seeds_cover_the_notice():
    for n in NOTICES:
        assert "".join(p for _, p in seeds(n.words)) == n.words
        assert len(seeds(n.words)) == edits_allowed(n.words) + 1
        assert all(n.words[a:a + len(p)] == p for a, p in seeds(n.words))


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(NOTICES), st.lists(st.tuples(st.integers(0, 90), st.sampled_from(["", "x", "e", " "])), max_size=8),
       st.lists(st.sampled_from(["the", "a", "license", "public", "copy"]), max_size=4))
def test_edited_notices(notice, changes, around):
    """Labels are those that a scan of all runs of words finds."""
    edited = notice.words
    for at, what in changes:
        at %= len(edited)
        edited = edited[:at] + what + edited[at + (len(what) == 0 or at % 2):]
    text = " ".join([*around, *edited.split(), *around])
    scan = Scanner(NOTICES)
    found = scan.verified(text)
    got = {NOTICES[k].label for k, *_ in found}
    assert got == brute_labels(text)
    kept = scan.matches(text)
    assert set(kept) <= set(found) and {m for m in found if not m[3]} <= set(kept)
    for k, a, b, edits in found:
        assert distance(text[a:b], NOTICES[k].words) <= edits <= edits_allowed(NOTICES[k].words)


@pytest.mark.parametrize("notice", NOTICES)
def test_windows_hold_all_matches(notice):
    """What the regex library finds in the whole text is found in the windows alone."""
    text = " ".join([notice.words, "and", notice.words.replace("e", "3", 1), "or", notice.words[1:], notice.words])
    whole = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice.words, literal_spaces=True)}){{e<={edits_allowed(notice.words)}}}(?![^ ])")
    got = [(a, b) for k, a, b, _ in Scanner((notice,)).matches(text)]
    assert len(got) == len(whole.findall(text))


def test_no_notices(spark):
    df = spark.createDataFrame([(1, "MIT License")], "doc_id bigint, text string")
    assert licenses.scanned(df, notices=()).select("n_words", "matches").collect() == [(2, [])]
    own = licenses.scanned(df, notices=(Notice("mit license", "x", True),)).select(*licenses.digest()).first()
    assert (own.n_base, own.labels) == (1, "x")


def test_added_character_at_the_start():
    assert Scanner(NOTICES).verified("xmit license") == [(0, 0, 12, 1)]
    assert Scanner(NOTICES).verified("mit license") == [(0, 0, 11, 0)]
