"""SimHash near-dedup against a brute force over all pairs, on both the paired and the linear path."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from hirelens.llm import simhash

from .helpers import doc_frame, edge_documents


def brute_fingerprint(text: str | None) -> int:
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(seed: int, docs: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 150))] for _ in range(20)]
    rows = []
    for i in range(docs):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words).upper() if i % 3 else "\t".join(words), "en", "src0", 0))
    return rows


@pytest.mark.parametrize("list_limit", [1024, 2])
def test_groups_equal_brute_force(spark, list_limit):
    rows = family(3)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(doc_frame(spark, rows), list_limit=list_limit).collect()}
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_groups(prints)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
@pytest.mark.parametrize("list_limit", [1024, 1])
def test_links_of_planted_fingerprints(spark, bits, list_limit):
    rng = np.random.default_rng(bits)
    prints = []
    for center in rng.integers(0, 2**63, 12):
        for _ in range(6):
            x = int(center)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    frame = spark.createDataFrame([(x if x < 2**63 else x - 2**64,) for x in prints], "fp long")
    from hirelens.llm.common import components
    roots = {r["node"]: r["root"] for r in components(simhash.near_links(frame, bits, list_limit), "test").collect()}
    groups = brute_groups({k: x for k, x in enumerate(prints)}, bits)
    got = {}
    for k, x in enumerate(prints):
        s = x if x < 2**63 else x - 2**64
        got.setdefault(roots.get(s, s), set()).add(k)
    want = {}
    for k, g in groups.items():
        want.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edges(spark):
    got = simhash.simhash_groups(edge_documents(spark)).collect()
    assert len(got) == edge_documents(spark).count()
    empty = [r for r in got if r["fp"] == 0]
    assert len({r["component_id"] for r in empty}) == 1
    assert simhash.simhash_groups(edge_documents(spark).limit(0)).count() == 0


def test_keep_one_per_group(spark):
    rows = family(5)
    docs = doc_frame(spark, rows)
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()}
    groups = brute_groups({r[0]: brute_fingerprint(r[1]) for r in rows})
    assert kept == set(groups.values())
    twice = simhash.keep_one_per_group(docs.union(docs))
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted(kept)


def test_long_text_in_chunks():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    whole = simhash.fingerprint(text)
    old, simhash.CHUNK = simhash.CHUNK, 1000
    try:
        assert simhash.fingerprint(text) == whole
    finally:
        simhash.CHUNK = old
