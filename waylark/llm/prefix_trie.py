"""The trie of all prefixes of conversations, by a van Emde Boas recursion.

A conversation of up to 2^k turns is cut at half depth, again and again, into aligned
blocks. Blocks of equal content get equal names, from single turns upward, so each
different block is kept once, with its two halves. Downward, a problem is a cut prefix
(the context) and the different blocks that follow it. Cutting it gives an upper problem,
of the same context, in which equal upper halves merge and add up their members, and a
lower one for each cut prefix, which gets a name and becomes a context itself. All
problems of one block size are solved together, in one join and one grouping. With blocks
of one turn the blocks are the edges of the trie.

Totals of subtrees are grafted upward: first each problem's own total, from small blocks
to large, then, from large to small, what hangs below each cut prefix outside its upper
problem. So the rounds follow the logarithm of the longest conversation, no conversation
or node is collected anywhere, and a round's rows halve as its blocks double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import stored
from waylark.operators.ordered import numbered

# Turns that a conversation can take over from the one it is built on.
MOST_SHARED = 9
ROOT = b"root"


def _name(*parts: Column) -> Column:
    """128 bits that stand for binary parts of fixed length."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _turn(role: Column, text: Column) -> Column:
    """The name of a turn: 128 bits of role and text, and the bytes of the text."""
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0"))
    return F.concat(_name(size(role), role.cast("binary"), text.cast("binary")), size(text))


def _bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("bigint")


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            share: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of every rebuilt conversation and (conv, at, name) of their turns, both stored.

    Conversation c takes the first h turns of conversation c - c % 5, then its own after
    its first h; h is `share` of the column conv, crc32 of its decimal form modulo 9 if none
    is given, and below `MOST_SHARED`. Turns are ordered by turn, null first, then by role and text.
    Null roles and texts are empty; rows without a conv_id are no conversation.
    """
    share = F.crc32(F.col("conv").cast("string")) % 9 if share is None else share
    own, _ = stored(turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        _turn(F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("name"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "turns")
    placed = numbered(own, ["conv"], ["turn", "role", "text"], "at").select("conv", "at", "name")
    placed, _ = stored(placed, "placed")
    convs = placed.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", share.cast("bigint"))
    base = (F.col("conv") - F.col("conv") % 5).alias("base")
    wanted = convs.select("conv", "h", base)
    # At most the first few turns of any conversation are taken over.
    taken = placed.where(F.col("at") < MOST_SHARED).select(F.col("conv").alias("base"), "at", "name")
    shared = wanted.join(taken, "base").where("at < h").select("conv", "at", "name")
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan, _ = stored(convs.select("*", base).join(sizes, "base", "left").select(
        "conv", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head")), "plan")
    tails = placed.join(plan, "conv").where("at >= h").select(
        "conv", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "name")
    lengths = plan.select("conv", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    return lengths, stored(shared.unionByName(tails), "rebuilt")[0]


def _digests(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal sequences: SHA-256 of their ids, joined by commas."""
    now, state = None, None
    for batch in batches:
        rows = []
        for sequence, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and sequence == now:
                state.update(b",%d" % conv)
            else:
                if state is not None:
                    rows.append((now, state.hexdigest()))
                now, state = sequence, hashlib.sha256(b"%d" % conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], out[0].type), pa.array([state.hexdigest()])], schema=out)


def _endings(convs: DataFrame) -> DataFrame:
    """sequence, ends_sha256 of (sequence, conv). The ids of a sequence pass one task in order,
    none is held: a hash of a list can't be cut."""
    out = pa.schema([("sequence", pa.binary()), ("ends_sha256", pa.string())])
    dealt = convs.select("sequence", "conv").repartition("sequence").sortWithinPartitions("sequence", "conv")
    return dealt.mapInArrow(lambda batches: _digests(batches, out), "sequence binary, ends_sha256 string")


def _blocks(lengths: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """By level: the conversations that are one block of that level (conv, sequence), and the
    different blocks of two halves (block, left, right); level 0 has none of the latter."""
    # A conversation takes part up to the level whose block holds all of it.
    top = F.ceil(F.log2(F.col("length"))).cast("int")
    rows, _ = stored(turns.join(lengths.select("conv", top.alias("top")), "conv").select(
        "conv", F.col("at").alias("i"), "top", F.col("name").alias("block")), "blocks-0")
    highest = rows.agg(F.max("top")).first()[0]
    whole, halves = [], []
    for level in range((highest if highest is not None else -1) + 1):
        whole.append(rows.where(F.col("top") == level).select("conv", F.col("block").alias("sequence")))
        if level == highest:
            break
        pairs, _ = stored(rows.where(F.col("top") > level).groupBy("conv", F.shiftright("i", 1).alias("i"), "top").agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("block"))).alias("left"),
            F.max(F.when(F.col("i") % 2 == 1, F.col("block"))).alias("right")), f"pairs-{level + 1}")
        # The last block of a conversation may have no right half; it keeps the name of its left.
        block = F.when(F.col("right").isNull(), F.col("left")).otherwise(_name(F.lit(b"\x02"), F.col("left"), F.col("right")))
        rows = pairs.select("conv", "i", "top", block.alias("block"))
        halves.append(pairs.where("right IS NOT NULL").select(
            block.alias("block"), "left", "right").dropDuplicates(["block"]))
    return whole, halves


def _cut(strings: DataFrame, halves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The upper and lower problems of (context, i, block, n, conv, sequence, below).

    n: members, conv: the smallest, sequence: the whole conversation that ends in the block, if one
    does; below: the name of the prefix at the block's end, if it goes on.
    """
    both = strings.join(halves, "block", "left").withColumn("left", F.coalesce("left", "block"))
    cut = F.when(F.col("right").isNotNull(), _name(F.lit(b"\x01"), "context", "left"))
    both = both.withColumn("cut", cut)
    upper = both.select(
        "context", (F.col("i") * 2).alias("i"), F.col("left").alias("block"), "n", "conv",
        F.when(F.col("right").isNull(), F.col("sequence")).alias("sequence"),
        # A block without a right half ends with its conversation, so nothing follows it.
        F.col("cut").alias("below"))
    lower = both.where("right IS NOT NULL").select(
        F.col("cut").alias("context"), (F.col("i") * 2 + 1).alias("i"), F.col("right").alias("block"), "n", "conv", "sequence", "below")
    return upper, lower


def _merged(strings: DataFrame) -> DataFrame:
    return strings.groupBy("context", "i", "block").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("sequence").alias("sequence"), F.max("below").alias("below"))


def _problems(whole: list[DataFrame], halves: list[DataFrame]) -> list[DataFrame]:
    """By level, the different (context, i, block) with n, conv, sequence, below; i counts the blocks
    before it in the conversation. Level 0 has the edges of the trie."""
    found: list[DataFrame] = []
    lower = upper = None
    for level in range(len(whole) - 1, -1, -1):
        own = whole[level].groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).select(
            F.lit(ROOT).alias("context"), F.lit(0).cast("bigint").alias("i"), F.col("sequence").alias("block"),
            "n", "conv", "sequence", F.lit(None).cast("binary").alias("below"))
        strings = _merged(own if upper is None else own.unionByName(upper))
        # The blocks below a cut differ already.
        strings, _ = stored(strings if lower is None else strings.unionByName(lower.select(strings.columns)), f"strings-{level}")
        found.append(strings)
        if level:
            upper, lower = _cut(strings, halves[level - 1])
    return found[::-1]


SUMS = ("saved", "leaves")


def _grafted(problems: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(name, saved, leaves) of all that hangs below each inner node, and the same of the root."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    edges = problems[0]
    # Upward: the total of each problem, block size by block size.
    totals = [stored(edges.groupBy("context", "i").agg(
        F.sum((F.col("n") - 1) * _bytes(F.col("block"))).alias("saved"),
        F.sum(F.col("below").isNull().cast("bigint")).alias("leaves")), "totals-0")[0]]
    for level, strings in enumerate(problems[:-1]):
        total = totals[-1]
        lower = total.where("i % 2 = 1").select(F.col("context").alias("below"), *SUMS)
        grafts = strings.where("i % 2 = 0 AND below IS NOT NULL").select("context", "i", "below").join(lower, "below")
        both = total.where("i % 2 = 0").unionByName(grafts.drop("below"))
        totals.append(stored(both.groupBy("context", F.shiftright("i", 1).alias("i")).agg(*sums), f"totals-{level + 1}")[0])
    # Downward: what hangs below the prefixes at which a level cuts.
    hanging: DataFrame | None = None
    for level in range(len(problems) - 2, -1, -1):
        own = totals[level].where("i % 2 = 1").select(F.col("context").alias("name"), *SUMS)
        if hanging is not None:
            further = problems[level].where("i % 2 = 1 AND below IS NOT NULL").select(
                F.col("context").alias("name"), F.col("below")).join(
                hanging.select(F.col("name").alias("below"), *SUMS), "below").drop("below")
            own = own.unionByName(further).groupBy("name").agg(*sums)
        own, _ = stored(own, f"hanging-{level}")
        hanging = own if hanging is None else hanging.unionByName(own)
    if hanging is None:
        hanging = totals[0].where("false").select(F.col("context").alias("name"), *SUMS)
    return hanging, totals[-1].select(*SUMS)


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations (conv, length), (conv, at, name).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The root, of depth 0, has all conversations as members, those without turns too.
    Without conversations there is no node. Conversations of equal turns are members of the same
    nodes, with their own ids.
    """
    empty = hashlib.sha256().hexdigest()
    whole, halves = _blocks(lengths, turns)
    every = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    turnless = lengths.where("length = 0").select(F.lit(ROOT).alias("sequence"), "conv")
    ends = _endings(turnless)
    if not whole:
        return every.join(F.broadcast(ends), F.lit(True), "left").select(
            F.col("conv").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.lit(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
            F.lit(0).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    problems = _problems(whole, halves)
    below, all_of_it = _grafted(problems)
    sequences = turnless
    for w in whole:
        sequences = sequences.unionByName(w.select("sequence", "conv"))
    ends = _endings(sequences)
    edges = problems[0]
    nodes = edges.select(
        F.col("context").alias("parent"), F.col("below").alias("name"), "conv", (F.col("i") + 1).alias("depth"),
        F.col("n").alias("n_convs"), ((F.col("n") - 1) * _bytes(F.col("block"))).alias("own"), "sequence",
    ).unionByName(every.select(
        F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("name"), "conv", F.lit(0).cast("bigint").alias("depth"),
        F.col("n").alias("n_convs"), F.lit(0).cast("bigint").alias("own"), F.lit(ROOT).alias("sequence")))
    hanging = below.unionByName(all_of_it.select(F.lit(ROOT).alias("name"), *SUMS))
    children = edges.groupBy(F.col("context").alias("name")).agg(F.count("*").alias("n_children"))
    inner = nodes.where("name IS NOT NULL").join(hanging, "name").join(children, "name")
    leaves = nodes.where("name IS NULL").select(
        *nodes.columns, F.lit(0).cast("bigint").alias("saved"), F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("n_children"))
    found = inner.select(leaves.columns).unionByName(leaves)
    parents = nodes.where("name IS NOT NULL").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    # Only nodes at which a conversation ends need its digest.
    joined = found.join(parents, "parent", "left").join(ends, "sequence", "left")
    return joined.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("own") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)), 4294967295::BIGINT)"""

ORACLE = f"""
WITH turns AS (
    SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.role, x.text) AS own FROM turns GROUP BY conv_id
), shared AS (SELECT conv_id, own, {_CRC} % 9 AS h FROM convs),
built AS (
    SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], a.own[1:0]), a.own[a.h + 1:]) AS s
    FROM shared a LEFT JOIN convs b ON b.conv_id = a.conv_id - a.conv_id % 5
), members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built),
nodes AS (
    SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends
    FROM members GROUP BY s[1:d], d
), weighed AS (
    SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(p[d].text) END AS own,
        NOT EXISTS (SELECT 1 FROM nodes c WHERE c.d = nodes.d + 1 AND c.p[1:nodes.d] = nodes.p) AS leaf FROM nodes
), spread AS (SELECT p, d, own, leaf, unnest(range(0, d + 1)) AS k FROM weighed),
sums AS (
    SELECT p[1:k] AS p, k AS d, sum(own) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = k + 1) AS children
    FROM spread GROUP BY p[1:k], k
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, s.children AS n_children, s.leaves AS n_leaves,
    s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
"""
