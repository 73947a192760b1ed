import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waylark.llm import merkle
from waylark.llm.neighbours import in_ranges

DOCS = "doc_id bigint, text string"


def random_text(rng, n):
    words = [rng.choice(["alpha", "beta", "γάμμα", "d", "e.", "f,", "g!\n", "h\n\n", "i"]) for _ in range(n)]
    return " ".join(words)


@pytest.mark.parametrize("seed", range(10))
def test_tree_holds_the_text_and_roots_tell_texts_apart(seed):
    rng = random.Random(seed)
    texts = [random_text(rng, rng.randint(0, 400)) for _ in range(20)] + ["", "\n", "\n\n", "..", " "]
    for t in texts:
        assert "".join(p for s in merkle.tree(t) for q in s for p in q) == t
    prints = {t: merkle.fingerprint(t) for t in texts}
    assert len({p[:32] for p in prints.values()}) == len(set(texts))
    for t in texts[:8]:
        changed = t[:-1] + "#" if t else "#"
        assert merkle.fingerprint(changed)[:32] != prints[t][:32]


def test_likeness():
    rng = random.Random(1)
    a, b = ("".join(f"word{rng.randint(0, 10**6)}{rng.choice([' ', ' ', '. ', chr(10)])}" for _ in range(2000)) for _ in range(2))
    f = merkle.fingerprint
    assert merkle.likeness(f(a), f(a)) == 1.0
    assert merkle.likeness(f(""), f("")) == 1.0
    assert merkle.likeness(f(""), f("x")) == 0.0
    for share in (0.25, 0.5, 0.9):
        cut = int(len(a) * share)
        alike = merkle.likeness(f(a), f(a[:cut] + b[: len(a) - cut]))
        assert abs(alike - share) < 0.05
    assert merkle.likeness(f("quick brown fox"), f("lazy dog sleeps here")) < 0.2
    moved = "\n".join(["first paragraph.", *a.split("\n")])
    assert merkle.likeness(f(a), f(moved)) > 0.8


def test_edits_in_one_line_and_an_inserted_paragraph():
    rng = random.Random(9)
    words = [f"word{rng.randint(0, 10**6)}{rng.choice(['', '', '', '.'])}" for _ in range(1000)]
    changed = list(words)
    changed[50], changed[950] = "abc.", "xyz."
    f = merkle.fingerprint
    assert merkle.likeness(f(" ".join(words)), f(" ".join(changed))) > 0.9
    paragraphs = [" ".join(words[k: k + 100]) for k in range(0, 1000, 100)]
    edits = ["A new one in front.", *(p.replace(p.split()[50], "Changed.") for p in paragraphs)]
    assert merkle.likeness(f("\n".join(paragraphs)), f("\n".join(edits))) > 0.8


def test_differing_paragraphs():
    paragraphs = [f"Paragraph number {k} says a thing." for k in range(40)]
    changed = list(paragraphs)
    changed[7] = "Something else."
    changed[33] += " More."
    one, two = (merkle.fingerprint("\n".join(p)) for p in (paragraphs, changed))
    assert merkle.differing_paragraphs(one, two) == [7, 33]
    assert merkle.differing_paragraphs(one, one) == []


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        f = merkle.fingerprint
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e), merkle.likeness(f(t), f(e)), merkle.likeness(f(t), f(following))))
    return sorted(out, key=repr)


def test_with_edits(spark):
    rng = random.Random(4)
    rows = [(i, random_text(rng, rng.choice([0, 1, 3, 30, 300]))) for i in range(-20, 100)] + [(200, None), (201, ""), (202, "é" * 70_001), (203, "x")]
    shuffled = list(rows)
    rng.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, DOCS).withColumn("range_of_row", F.lit(1)).repartition(7)
    assert sorted((tuple(r) for r in merkle.with_edits(docs).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(1, "one text here"), (2, "another text")][:n]
    assert sorted((tuple(r) for r in merkle.with_edits(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "n"), (None, "n"), (3, "same"), (3, "same"), (3, "other"), (9, "last")]
    got = merkle.with_edits(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    again = merkle.with_edits(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_ranges_show_each_row_its_neighbours(spark):
    rng = random.Random(8)
    keys = [(rng.choice(["x", "y", None, "z"]), rng.randint(0, 200)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(keys)], "a string, b bigint, k int")
    laid, place, role = in_ranges(df, ["a", "b"], ["k"])
    order = sorted(range(400), key=lambda k: (keys[k][0] is not None, keys[k][0] or "", keys[k][1], k))
    by_place = {}
    for r in laid.collect():
        by_place.setdefault(r[place], []).append((r["k"], r[role]))
    assert sum(role == 0 for v in by_place.values() for _, role in v) == 400
    for held in by_place.values():
        seen = [k for k, how in held if how != 2]
        at = order.index(seen[0])
        assert order[at: at + len(seen)] == seen
    assert [k for k, how in by_place[max(by_place)] if how == 2][0] == order[0]


def test_a_hot_id_spans_ranges(spark, monkeypatch):
    """Rows of one doc_id are dealt to several ranges, and few of them to two."""
    laid_out = []
    monkeypatch.setattr(merkle, "in_ranges", lambda *a: laid_out.append(in_ranges(*a)) or laid_out[-1])
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(400)], DOCS).repartition(5)
    assert merkle.with_edits(docs).count() == 400
    laid, place, role = laid_out[0]
    assert laid.where(F.col(role) == 0).select(place).distinct().count() > 4
    assert laid.where(F.col(role) != 0).count() < 100


WORDS = ["".join(random.Random(k).choice("abcdefghijklmnop") for _ in range(2 + k % 8)) for k in range(3000)]


def plain(rng, n):
    """Words without sentence marks or line ends."""
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.mark.parametrize("n, edits, least", [(400, 5, 0.9), (1000, 10, 0.85), (20_000, 40, 0.9)])
def test_cuts_meet_again_behind_an_edit(n, edits, least):
    rng = random.Random(n)
    words = plain(rng, n)
    changed = list(words)
    for k in rng.sample(range(n), edits):
        changed[k] = "other" + changed[k]
    f = merkle.fingerprint
    assert merkle.likeness(f(" ".join(words)), f(" ".join(changed))) > least
    assert merkle.likeness(f(" ".join(words)), f(" ".join(plain(rng, n)))) < 0.05


def test_leaves_grow_with_the_root_of_the_text():
    rng = random.Random(5)
    f = merkle.fingerprint
    assert len(f(text := " ".join(plain(rng, 40_000)))) < 0.05 * len(text)
    words = plain(rng, 3000)
    for a, b in ((600, 760), (150, 760), (700, 3000)):  # texts of different levels
        one, other = " ".join(words[:a]), " ".join(words[:b])
        assert merkle.level_of(len(one)) < merkle.level_of(len(other))
        assert merkle.likeness(f(one), f(other)) == pytest.approx(2 * len(one) / (len(one) + len(other)), abs=0.06)


def test_cuts_by_window_hash_alone():
    """Each cut of level k is the least of its neighbourhood, and one of level k - 1."""
    rng = random.Random(6)
    codes = merkle._codes(" ".join(plain(rng, 300)))
    h = [0] * 64 + merkle._window_hash(codes).tolist() + [0] * 64
    ends, level = merkle.cuts(codes, 4)
    for k in range(5):
        reach = merkle.RADIUS << k
        want = [j + 1 for j in range(len(codes)) if h[j + 64] < min(h[j + 64 - reach: j + 64]) and h[j + 64] <= min(h[j + 65: j + 65 + reach])]
        assert ends[level >= k].tolist() == sorted({*want, len(codes)})


def test_long_runs_of_one_character():
    one, other = "x" * 50_000, "x" * 49_000
    assert max(len(p) for s in merkle.tree(one) for q in s for p in q) <= merkle.WIDEST << merkle.level_of(len(one))
    assert merkle.likeness(merkle.fingerprint(one), merkle.fingerprint(other)) > 0.9
