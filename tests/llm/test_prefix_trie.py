"""The prefix trie against plain Python over whole conversations; extents against a scan; running sums; edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import prefix_trie as trie
from hirelens.llm.queries import QUERIES

COLUMNS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        whole[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        weight = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = weight + sum(saved[x] for x in children[node])
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(node))
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(frame):
    assert frame.columns == NAMES
    assert {t for _, t in frame.dtypes[:-1]} == {"bigint"}
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, small_dir)) == brute(rows)


@pytest.mark.parametrize("segment, block_rows, chunk, partitions", [(64, 8192, 4096, 3), (2, 7, 3, 5), (1, 3, 2, 2), (3, 1, 1, 4), (4, 64, 5, 8)])
def test_segments_blocks_and_hot_groups(spark, segment, block_rows, chunk, partitions):
    """Long and equal conversations and shared beginnings, over segments, blocks and partitions of a few rows."""
    rng = random.Random(segment * 100 + block_rows)
    rows = []
    for c in range(90):
        if c % 3 == 0:  # a third are copies
            turns = [("user", f"hello {k}") for k in range(6)]
        elif c % 3 == 1:
            turns = [("user", "hello 0"), ("assistant", rng.choice("ab"))] + [("user", rng.choice(["x", "yy", "é"])) for _ in range(rng.randint(0, 9))]
        else:
            turns = [(rng.choice(["user", "system"]), rng.choice("pq")) for _ in range(rng.randint(1, 4))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(500, k, "user", f"turn {k % 3}") for k in range(150)]  # one conversation with a third of the rows
    rows += [(501, k, "user", f"turn {k % 3}") for k in range(149)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows_of(trie.prefix_trie(frame, segment=segment, block_rows=block_rows, chunk=chunk)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_extents_equal_a_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 100):
        shared = rng.integers(-1, 5, n)
        row, depth = rng.integers(0, n, 200), rng.integers(0, 6, 200)
        left, right = trie.extents(shared, row, depth)
        for i, d, a, b in zip(row, depth, left, right):
            x = i
            while x > 0 and shared[x] >= d:
                x -= 1
            y = i
            while y + 1 < n and shared[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)


def test_running_sums(spark):
    rows = [(k, v, v * 7) for k, size in ((1, 500), (2, 1), (3, 40), (9, 300)) for v in range(size)]
    got = trie.running(spark.createDataFrame(rows, "k long, o long, v long").repartition(6), "k", [F.col("o")], ["o", "v"], ["v"], "t")
    assert sorted((r.k, r.o, r.before_v) for r in got.collect()) == sorted((k, o, 7 * o * (o - 1) // 2) for k, o, _ in rows)


def test_edges(spark):
    long_text = "very long " * 20_000
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (None, 0, "user", "lost"), (None, None, None, None),
            (2, 5, None, ""), (2, -3, "", None), (3, 1, "user", long_text), (8, 1, "user", long_text), (-7, 0, "user", "minus"), (-5, 0, "user", "base"),
            (2**62, 0, "é", "\U0001f600"), (10, 0, "a", "bc"), (15, 0, "ab", "c")]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as c", "1 as pos", "2 as n", "3 as s", "4 as depth", "'y' as x", "5 as bytes")
    assert rows_of(trie.prefix_trie(frame)) == brute(rows)
    assert trie.prefix_trie(frame.limit(0)).collect() == []
    assert trie.prefix_trie(frame.where("conv_id is null")).collect() == []
