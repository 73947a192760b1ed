"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waylark.llm import simhash

MASK = (1 << 64) - 1
DOCS = "doc_id bigint, text string"


def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k: k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, bits=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    known = sorted(root)
    for k, a in enumerate(known):
        for b in known[:k]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=repr)


def result(docs):
    found = simhash.near_duplicates(docs).withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))
    return sorted((tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_fingerprint_is_spark_xxhash(spark):
    text = "The quick  brown\tfox JUMPS over Ünï"
    words = "the quick brown fox jumps over Ünï".split()
    grams = [" ".join(words[k: k + 3]) for k in range(5)]
    hashes = [r[0] & MASK for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert simhash.fingerprint(text) & MASK == want == brute_print(text)


@pytest.mark.parametrize("text", [None, "", " \n", "one", "one two", "\x85a b\xa0c d", "x " * 40_000])
def test_fingerprint_edges(text):
    assert simhash.fingerprint(text) & MASK == brute_print(text)


def test_classes_match_brute_force(spark):
    random.seed(3)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        base = random.choices(words, k=random.randint(1, 50))
        rows.append((i, " ".join(base)))
        for _ in range(random.randint(0, 2)):
            near = list(base)
            near[random.randrange(len(near))] = random.choice(words)
            rows.append((len(rows) + 1000, " ".join(near)))
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, "only without id here"), (-3, None), (9000, ""), (9001, "  ")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("own")).withColumn("component_id", F.lit(1))
    assert result(docs) == brute_classes(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert result(empty) == []
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_near_pairs_of_dense_and_hot_groups(spark, bits):
    """Thousands of prints in one bucket: cut again instead of compared, and no pair lost."""
    random.seed(bits)
    prints = set()
    for centre in (0, MASK, random.getrandbits(64)):
        for _ in range(150):
            p = centre
            for b in random.sample(range(64), random.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    half = random.getrandbits(32)
    prints |= {half << 32 | random.getrandbits(32) for _ in range(150)}
    prints |= {random.getrandbits(12) << 20 | half for _ in range(150)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed + signed[:9] + [None]], "fp bigint")
    got = {tuple(r) for r in simhash.near_pairs(df, bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & MASK).bit_count() <= bits}
    assert got == want


def test_hot_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    random.seed(9)
    signed = sorted({random.getrandbits(10) << random.choice((0, 5, 30)) for _ in range(300)})
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 2}


def test_exploded_signatures_are_not_broadcast(spark, monkeypatch):
    """Spark takes them for as small as the fingerprints, of which each has 34."""
    plans, keep = [], simhash.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(simhash, "stored", seen)
    simhash.near_pairs(spark.range(500).select(F.xxhash64("id").alias("fp"))).collect()
    assert plans and all("SortMergeJoin [id" in p for p in plans)


def test_one_of_each_keeps_columns_and_smallest(spark):
    text = "a text of some words that is copied here"
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (None, text, "z"), (7, "quite another text of other words", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp_of_text string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, text, "y"), (7, "quite another text of other words", None)]
