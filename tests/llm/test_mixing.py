"""Source mixing against brute force: budgets by repeated water-filling, epochs by one whole sort of each leaf."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from hirelens.llm import mixing
from hirelens.llm.params import MIX_WEIGHTS, domain

from .helpers import doc_frame, edge_documents


def count(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_domain(source):
    number = re.search("([0-9]{1,9})$", source or "")
    return f"d{int(number[1]) % 4 if number else 0}"


def water(total, caps, weights):
    """Parts of ``total`` by weight, none above its cap: fix all that are full, share the rest, again."""
    parts, left, open_ = {}, total, set(caps)
    while open_:
        all_weights = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * all_weights <= left * weights[k]}
        if not full:
            parts.update({k: min(caps[k], left * weights[k] // all_weights) for k in open_})
            break
        for k in full:
            parts[k] = caps[k]
            left -= caps[k]
        open_ -= full
    return parts


def brute_mix(rows, weights, percent, epochs, seed):
    """Copies of each row, rows given as (doc_id, text, lang, source, n_chars)."""
    leaves = defaultdict(list)
    for k, r in enumerate(rows):
        leaves[brute_domain(r[3]), r[2], r[3]].append(k)
    caps = {leaf: epochs * sum(count(rows[k][1]) for k in members) for leaf, members in leaves.items()}
    given = {(): sum(count(r[1]) for r in rows) * percent // 100}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = {}
        for parent, total in given.items():
            children = {leaf[:depth + 1] for leaf in leaves if leaf[:depth] == parent}
            below.update(water(total, {c: sum(v for leaf, v in caps.items() if leaf[:depth + 1] == c) for c in children},
                               {c: weights.get(level, {}).get(c[-1], 1) for c in children}))
        given = below
    copies = [0] * len(rows)
    for leaf, members in leaves.items():
        tokens = caps[leaf] // epochs
        whole, rest = divmod(given[leaf], tokens) if tokens else (0, 0)

        def place(k):
            md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
            name = "" if rows[k][0] is None else str(rows[k][0])
            return int(md5(md5(f"{seed}|{name}|{md5(rows[k][1] or '')}") + f"|{whole}")[:12], 16)

        before = 0
        for k in sorted(members, key=lambda k: (place(k), rows[k][1] or "")):
            copies[k] = whole + (before < rest)
            before += count(rows[k][1])
    return copies


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["src0"] * 6 + ["src1", "src2", "src3", "src4", "src7", None, "plain"])
        lang = rng.choice(["en", "en", "de", "fr", "es", None])
        text = None if i % 41 == 0 else " ".join(["w"] * rng.choice([0, 1, 5, 30, 200]))
        rows.append((i, text, lang, source, 0))
    return rows


@pytest.mark.parametrize("percent,epochs", [(100, 4), (250, 3), (30, 1)])
def test_copies_equal_brute_force(spark, percent, epochs):
    rows = corpus(percent)
    got = mixing.mix(doc_frame(spark, rows), domain("source"), MIX_WEIGHTS, budget_percent=percent, max_epochs=epochs, seed=5)
    found = {r["doc_id"]: (r["mix_tokens"], r["mix_copies"]) for r in got.collect()}
    expected = brute_mix(rows, MIX_WEIGHTS, percent, epochs, 5)
    assert found == {r[0]: (count(r[1]), n) for r, n in zip(rows, expected)}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # d1 holds a small source beside a large one; d0 has enough of its own
    rows = [(i, "w " * 10, "en", "src1", 0) for i in range(2)] + [(100 + i, "w " * 10, "en", "src5", 0) for i in range(100)]
    rows += [(300 + i, "w " * 10, "en", "src0", 0) for i in range(100)]
    got = mixing.mix(doc_frame(spark, rows), domain("source"), {}, budget_percent=50, max_epochs=1)
    taken = defaultdict(int)
    for r in got.collect():
        taken[r["source"]] += r["mix_copies"] * r["mix_tokens"]
    # 1010 tokens, half for each domain; src1 gives its 20, its sibling src5 takes what src1 lacks
    assert dict(taken) == {"src1": 20, "src5": 490, "src0": 510}


def test_edges(spark):
    docs = edge_documents(spark)
    got = mixing.mix(docs, domain("source"), MIX_WEIGHTS)
    assert got.columns == [*docs.columns, "mix_tokens", "mix_copies"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["mix_copies"] is not None and r["mix_copies"] >= 0 for r in rows)
    assert mixing.mix(docs.limit(0), domain("source"), MIX_WEIGHTS).count() == 0


def test_epochs_have_orders_of_their_own(spark):
    rows = [(i, "w " * 10, "en", "src0", 0) for i in range(400)]

    def prefix(percent):
        got = mixing.mix(doc_frame(spark, rows), domain("source"), {}, budget_percent=percent, max_epochs=3).collect()
        most = max(r["mix_copies"] for r in got)
        return {r["doc_id"] for r in got if r["mix_copies"] == most}

    first, second = prefix(50), prefix(150)
    assert len(first) == len(second) == 200 and len(first & second) < 140


def test_rows_without_an_id_are_apart_in_the_order(spark):
    rows = [(None, f"w{i} " * 10, "en", "src0", 0) for i in range(300)]
    got = mixing.mix(doc_frame(spark, rows), domain("source"), {}, budget_percent=50, max_epochs=1).collect()
    assert sum(r["mix_copies"] for r in got) == 150
    assert [r["mix_copies"] for r in sorted(got, key=lambda r: int(r["text"].split()[0][1:]))] != [1] * 150 + [0] * 150
