import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from waylark.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def brute_seats(weights, seats):
    found = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * found[i] + 1), -i))
        found[best] += 1
    return found


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_is_highest_quotients(seed):
    random.seed(seed)
    weights = [random.choice([0, 1, 3, 10, random.randint(0, 1000)]) for _ in range(random.randint(1, 9))]
    seats = random.randint(0, 200) if any(weights) else 0
    assert mixing.sainte_lague(weights, seats) == brute_seats(weights, seats)
    assert sum(mixing.sainte_lague(weights, seats)) == seats


def test_targets_stop_at_three_times_and_share_again():
    # 40 by weight of 240; the first stops at 3, what it leaves goes to the others 2 : 3.
    assert mixing.targets([1, 100, 139], [1, 2, 3]) == pytest.approx([3, 237 * 2 / 5, 237 * 3 / 5])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([], []) == []
    random.seed(1)
    for _ in range(50):
        sizes = [random.choice([0, 1, random.randint(1, 10_000)]) for _ in range(random.randint(1, 12))]
        found = mixing.targets(sizes, [1 + k % 3 for k in range(len(sizes))])
        assert sum(found) == pytest.approx(sum(sizes))
        assert all(t <= 3 * n + 1e-6 for t, n in zip(found, sizes))


@pytest.mark.parametrize("seed", range(20))
def test_copies_meet_the_quota(seed):
    random.seed(seed)
    sizes = [random.randint(0, 300) for _ in range(random.randint(0, 80))]
    total = sum(sizes)
    quota = random.randint(0, 4 * total + 1)
    found = mixing.copies(sizes, quota, 100)
    taken = sum(n * c for n, c in zip(sizes, found))
    assert all(0 <= c <= 3 for c in found)
    few = sizes[:8]
    wanted = random.randint(0, sum(few))
    off = min(abs(wanted - sum(n for k, n in enumerate(few) if m >> k & 1)) for m in range(1 << len(few)))
    assert abs(sum(few[k] for k in mixing.nearest_sum(few, wanted)) - wanted) == off
    if total and quota <= 3 * total:
        skipped = [n for n, c in zip(sizes, found) if n and c == min(c for n, c in zip(sizes, found) if n)]
        assert abs(quota - taken) < max(skipped)


def source_rows():
    random.seed(5)
    rows = []
    for s, n in (("b", 60), ("a", 5), ("é", 30), ("", 20), (None, 25), ("Z", 40)):
        for _ in range(n):
            rows.append((len(rows), "w x " * random.randint(0, 40) + "\ttail\n", s))
    return rows + [(1, rows[1][1], "b"), (1, rows[1][1], "b"), (None, "a b c", "a"), (500, None, "b"), (501, "", "nothing")]


@pytest.mark.parametrize("shard,off", [(1 << 16, 0.005), (16, 0.05)])
def test_mix(spark, monkeypatch, shard, off):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
    rows = source_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("own")).repartition(3, "doc_id")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size) for r in got) == sorted(((i is None, i or 0), size(t)) for i, t, _ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    wanted = dict(zip(names, mixing.targets(sizes, [1 + k % 3 for k in range(len(names))])))
    for name, total in zip(names, sizes):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {total}
        assert all(r.target == pytest.approx(wanted[name]) and r.taken == r.size * r.copies <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - wanted[name]) <= max(max(r.size for r in own) / 2, off * wanted[name])
    again = mixing.mixed(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixture_repeats_rows(spark):
    docs = spark.createDataFrame(source_rows(), DOCS).withColumn("words_of_text", F.lit(1)).coalesce(1)
    taken = {}
    for r in mixing.mixed(docs).collect():
        taken[(r.doc_id, r.source)] = taken.get((r.doc_id, r.source), 0) + r.copies
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[(r.doc_id, r.source)] = found.get((r.doc_id, r.source), 0) + 1
    assert found == {k: n for k, n in taken.items() if n}


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixed(empty).count() == mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)
    assert [(r.taken, r.target) for r in mixing.mixed(blank).collect()] == [(0, 0.0)] * 2


@pytest.mark.parametrize("shard", [1 << 16, 16])
def test_files_and_partitions_do_not_matter(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard)
    docs = spark.createDataFrame(source_rows(), DOCS)
    results = [sorted(map(tuple, mixing.mixed(d).collect()), key=repr) for d in (docs.coalesce(1), docs.repartition(7))]
    assert results[0] == results[1]


def best_miss(sizes, quota):
    """How near whole documents can come, by all sums that they reach."""
    total = sum(sizes)
    left = quota % total
    reach = {0}
    for n in sizes:
        reach |= {r + n for r in reach}
    return min(abs(r - left) for r in reach)


@pytest.mark.parametrize("seed", range(100))
def test_small_sources_reach_what_whole_documents_can(seed):
    rnd = random.Random(seed)
    sizes = [int(rnd.lognormvariate(5, 1.5)) + 1 for _ in range(10)]
    quota = rnd.randint(0, 3 * sum(sizes) - 1)
    found = mixing.copies(sizes, quota, 1)
    assert abs(sum(n * c for n, c in zip(sizes, found)) - quota) == best_miss(sizes, quota)


def test_many_documents_meet_the_quota():
    rnd = random.Random(3)
    for _ in range(5):
        sizes = [int(rnd.lognormvariate(5, 1.5)) for _ in range(3000)]
        quota = rnd.randint(1, 3 * sum(sizes) - 1)
        found = mixing.copies(sizes, quota, 512)
        assert max(found) <= 3 and abs(sum(n * c for n, c in zip(sizes, found)) - quota) <= 1
    # Very long documents: sums are told apart by steps.
    sizes = [rnd.randint(1, 5_000_000) for _ in range(200)]
    quota = sum(sizes) // 3
    found = mixing.copies(sizes, quota, 512)
    assert abs(sum(n * c for n, c in zip(sizes, found)) - quota) <= 0.001 * quota


def test_query_comes_near_its_targets(spark):
    """Each source misses its target by what whole documents force, and a block, at most."""
    from waylark.llm import queries

    got = queries.op8_mixing(spark, "/root/testdata/sf0.001").collect()
    sources = {}
    for r in got:
        sources.setdefault(r.source, []).append(r)
    for own in sources.values():
        sizes, target = [r.size for r in own], own[0].target
        missed = abs(sum(r.taken for r in own) - target)
        assert missed <= best_miss([n for n in sizes if n], int(target)) + 5
        assert missed <= 0.01 * target or best_miss([n for n in sizes if n], int(target)) > 0.005 * target
