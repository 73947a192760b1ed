import random

from waylark.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


def run(spark, edges):
    return sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())


def test_random_chain_and_star(spark):
    random.seed(1)
    chain = [(k, k + 1) for k in range(100, 140)]
    random.shuffle(chain)
    star = [(900, k) if k % 2 else (k, 900) for k in range(901, 960)]
    loose = [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(60)]
    edges = chain + star + loose + chain[:5] + [(7, 7)]
    assert run(spark, edges) == brute(edges)


def test_no_links(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1)]) == []
