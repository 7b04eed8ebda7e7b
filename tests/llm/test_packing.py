"""Packing: every id in exactly one piece, tokens equal to the tokenizer's, gapless windows, little padding."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hirelens.llm import packing
from hirelens.llm.tokens import CachedTokenizer

from .helpers import doc_frame, edge_documents


def encode(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, docs, window):
    """``docs``: list of (doc_id, ids); repeated rows may share an id."""
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
        assert 1 <= p["length"] <= window
        assert zlib.crc32(np.frombuffer(p["ids"], "<u2").astype("<u4").tobytes()) == p["ids_crc32"]
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    got = defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append((p["start"], list(np.frombuffer(p["ids"], "<u2")), p["doc_tokens"]))
    want = defaultdict(list)
    for i, ids in docs:
        want[i].append(ids)
    assert got.keys() == want.keys()
    for i, texts in want.items():
        assert sum(len(x) for _, x, _ in got[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [t for _, x, _ in sorted(got[i]) for t in x] == texts[0]
            assert {n for _, _, n in got[i]} == {len(texts[0])}
            assert sorted(got[i])[0][0] == 0
    return windows


def test_pieces(spark):
    rng = random.Random(1)
    words = ["idiot", "Straße", "naïve", "don't", "!!", "42", "été", "the", "of", "ÀB"]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 400))), "en", "s", 0)
            for i in range(150)]
    got = packing.pack(doc_frame(spark, rows), window=256, shard_tokens=5000, partition_tokens=10**9).collect()
    windows = check(got, [(r[0], encode(r[1])) for r in rows], 256)
    filled = [sum(p["length"] for p in w) for w in windows.values()]
    assert sum(f < 256 for f in filled) <= 1  # one partition: only its last window is short


def test_edges(spark):
    docs = edge_documents(spark)
    got = packing.pack(docs).collect()
    check(got, [(r["doc_id"], encode(r["text"])) for r in docs.collect()], packing.WINDOW)
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_fill_the_window():
    """The seed's window takes the lexically nearest document first."""
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 8], [90, 91, 92, 93], [5, 6, 7, 9], [94, 95, 96, 97])]
    assert list(packing.fill(docs, np.ones(65_536, np.float32), 4.0, 8, 8))[:2] == [0, 2]


def test_bm25_scores_are_those_of_the_formula():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(25)]
    idf, mean = rng.random(65_536).astype(np.float32), 17.0
    shard = packing.Shard(docs, idf, mean)
    for used in (0, 3, *range(5, 20)):
        shard.use(used)
    best = list(shard.neighbours(3))

    def bm25(q, d):
        total = 0.0
        for t in set(docs[q].tolist()):
            tf = int((docs[d] == t).sum())
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))
        return total

    free = [d for d in range(25) if shard.unused[d]]
    assert sorted(best) == free
    scores = [bm25(3, d) for d in best]
    assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:]))


@pytest.mark.parametrize("text", ["Don't !!'s x's ''ll 're ²³ ª 12½ İx Σσς", "a b\x85c\x1cd", "<|endoftext|> hi", "é é ﬁ ÀÉ ß ẞ",
                                  "'S 'RE it's ''s '' 've dž ǅ ŉ ĸ \xad­x", "", " \n", "\U0001f600 ok", "a$$$ b*** c,%%%"])
def test_cached_ids_equal_the_tokenizer(text):
    tok = CachedTokenizer(packing.tokenizer_path())
    assert [*tok.ids(text), 1] == encode(text)
    assert [*tok.ids(text), 1] == encode(text)
