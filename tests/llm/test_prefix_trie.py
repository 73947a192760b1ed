"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from waylark.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LONGS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in below)
    return sorted(((
        min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
        hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()), key=repr)


def result(df):
    assert df.columns == [*LONGS, "ends_sha256"] and dict(df.dtypes) == {**dict.fromkeys(LONGS, "bigint"), "ends_sha256": "string"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def built(df):
    return prefix_trie.trie(*prefix_trie.rebuilt(df))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_prefix_trie(spark, SF)) == brute(rows)


def random_rows(seed, convs, longest, words):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(-20, 5 * convs), convs):
        same = rnd.random() < 0.3
        for k in range(rnd.choice([1, 2, 3, longest, rnd.randrange(1, longest + 1)])):
            out.append((c, k, "user", f"w{k}" if same else rnd.choice(words)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed, convs, longest", [(1, 60, 9), (2, 40, 37), (3, 25, 70), (4, 12, 1)])
def test_random_conversations(spark, seed, convs, longest):
    rows = random_rows(seed, convs, longest, ["a", "b", "é", ""])
    assert result(built(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, "x"), (1, None, "b", None), (1, 3, "a", "y"), (1, 3, "a", "y"), (1, 3, "a", "aa"), (None, 0, "a", "x"),
        (0, 0, "a", "long " * 5000), (0, 1, None, None), (2, 0, "a", "long " * 5000), (7, 0, "u", "only"), (-3, 5, "u", "é"),
        (13, 0, "u", "1"), (13, 1, "", "1"), (13, 2, None, "1"), (10, 0, "u", "1"), (10, -1, "u", "0"),
        *[(c, k, "r", str(k)) for c in (25, 26, 27, 28, 29, 30, 31) for k in range(12)],
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "'x' AS name", "2 AS conv", "0 AS context")
    want = brute(rows)
    assert result(built(df)) == want
    assert result(built(df.repartition(7))) == want


def test_no_turns_left(spark):
    """Conversations whose turns all go, none but the root remains; no rows, no nodes."""
    gone = [c for c in range(1, 40) if c % 5 and crc32(str(c).encode()) % 9 >= 1][:4]
    rows = [(c, 0, "u", "x") for c in gone]
    assert result(built(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert result(built(spark.createDataFrame([], SCHEMA))) == []


def test_copies_share_nodes(spark):
    rows = [(c, k, "u", f"t{k}") for c in range(0, 400, 5) for k in range(6)]
    got = result(built(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 7
