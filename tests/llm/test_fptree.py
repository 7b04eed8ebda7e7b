"""FP-tree search against plain scoring of every document; bounds never below scores; edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import fptree
from hirelens.llm.queries import QUERIES

from .helpers import doc_frame, edge_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """``docs`` and ``items`` are lists of (id, text); one row an item id."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, 2**63 - 1 if i is None else i))
        out += [(item, r, None if i == 2**63 - 1 else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def test_terms_follow_the_pattern():
    for text in ("MIT-License 2.0\tÄÖ é", "a\x00b\x7fc", "", None, "ÀB c d", "\U0001f600x@Y[z`q{"):
        assert [t.decode() for t in fptree.terms_of(text)] == terms(text)


def test_query_equals_brute_force(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(QUERIES["op13_ranked_search"](spark, small_dir)) == brute(docs, items)


@pytest.mark.parametrize("block_terms, shard_docs, shard_entries, leaf_docs", [(1 << 18, 8192, 1 << 21, 4), (40, 64, 300, 2), (1 << 18, 100, 1 << 21, 1)])
def test_shards_blocks_and_copies(spark, block_terms, shard_docs, shard_entries, leaf_docs):
    """Small shards, leaves and item blocks; a third of all rows are copies, so scores tie and ids decide."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    copy = " ".join(rng.choices(words, weights, k=20))
    docs = [(i, copy if i % 3 == 0 else " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(15)] + [(99, copy), (100, "unknown words"), (101, "")]
    got = fptree.search(doc_frame(spark, [(i, t, "en", "s", 0) for i, t in docs]).repartition(5),
                        spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms, shard_docs=shard_docs,
                        shard_entries=shard_entries, leaf_docs=leaf_docs)
    assert rows_of(got) == brute(docs, items)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(7)
    docs = []
    for i in range(500):
        held = np.flatnonzero(rng.random(40) < 1 / np.arange(1, 41) ** 0.5)
        if len(held):
            docs.append((i, int(rng.integers(25, 400)), held, rng.integers(1, 9, len(held))))
    shard = fptree.build(docs, 40, leaf_docs=8)
    assert len(shard.lo) > 50
    for _ in range(20):
        asked = rng.choice(40, 10, replace=False)
        weights = rng.integers(1, 5000, 10)
        weight_of = np.zeros(40, np.int64)
        weight_of[asked] = weights
        bound = shard.bounds(np.arange(len(shard.lo)), asked, weights)
        for node in range(len(shard.lo)):
            assert bound[node] >= shard.scores(shard.lo[node], shard.hi[node], weight_of).max()
            if shard.children[node]:
                below = range(shard.first_child[node], shard.first_child[node] + shard.children[node])
                assert (shard.lo[below[0]], shard.hi[below[-1]]) == (shard.lo[node], shard.hi[node])
        visited = []
        kept = shard.scores
        shard.scores = lambda lo, hi, w: (visited.append(hi - lo), kept(lo, hi, w))[1]
        top = shard.best(asked, weights, weight_of, 5, [])
        del shard.scores
        plain = shard.scores(0, len(shard.ids), weight_of)
        assert top == sorted((-s, i) for s, i in zip(plain.tolist(), shard.ids.tolist()) if s > 0)[:5]
        assert sum(visited) < len(shard.ids)  # something was left out


def test_edges(spark):
    frame = edge_documents(spark).selectExpr("*", "1 as item", "2 as item_id", "'x' as df")
    docs = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    items = [(1, "The same line AGAIN"), (2, None), (3, ""), (4, "word1 word2 word3 "), (None, "mit license"), (5, docs[0][1] + " é")]
    asked = spark.createDataFrame([*items, (1, "The same line AGAIN"), (4, "zzz"), (None, None)], "item_id long, text string") \
        .selectExpr("*", "'x' as terms", "3 as score")
    assert rows_of(fptree.search(frame, asked)) == brute(docs, items)
    assert fptree.search(frame.limit(0), asked).collect() == []
    assert fptree.search(frame, asked.limit(0)).collect() == []
    assert fptree.search(frame.withColumn("text", F.lit(None).cast("string")), asked).collect() == []
