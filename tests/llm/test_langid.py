"""Language filters: Bloom filters against exact sets, predictions against plain Python, held-out accuracy, edges."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.llm import langid
from hirelens.llm.queries import QUERIES

from .helpers import doc_frame, edge_documents


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [f" {w} "[k:k + n] for w in words for n in langid.GRAMS for k in range(len(w) + 3 - n)]


def hashes(text):
    return np.concatenate([np.zeros(0, np.uint64), *langid.gram_hashes(text)])


@pytest.mark.parametrize("chunk", [1 << 18, 1, 3, 7])
def test_grams_are_those_of_words(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ("Ab, cde-fgh 12 é x", "  a", "", None, "12 !?", "words\nOVER two\nLines z", "ñandú " * 9):
        grams, found = plain_grams(text), hashes(text)
        assert len(grams) == len(found)
        assert sorted(Counter(grams).values()) == sorted(Counter(found.tolist()).values())


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def brute(rows, share):
    """Predictions from exact sets of n-grams, so without any false positive."""
    texts = defaultdict(set)
    for r in rows:
        if r.lang is not None and r.text is not None and not held(r.doc_id):
            texts[r.lang].add(r.text)
    sets = {}
    for name, own in texts.items():
        docs = Counter(g for t in own for g in set(plain_grams(t)))
        sets[name] = {g for g, n in docs.items() if n >= max(1.0, share * len(own))}
    order = sorted(sets, key=lambda x: (-len(texts[x]), x))
    out = {}
    for r in rows:
        grams = plain_grams(r.text)
        counts = [sum(g in sets[x] for g in grams) for x in order]
        best = int(np.argmax(counts)) if grams else 0
        out[r.doc_id] = (held(r.doc_id), order[best] if grams else "und", counts[best] / sum(counts) if sum(counts) else 0.0)
    return out


def test_query_against_exact_sets(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    want = brute(rows, langid.SHARE)
    got = QUERIES["op11_language_id"](spark, small_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        held_out, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held_out, lang)
        assert abs(r.score - score) < 0.02


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op11_language_id"](spark, folder).where("held_out").join(truth, "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n >= 0.98


def test_false_positives_are_taken_off():
    """In a crowded table every language answers yes often; corrected counts are near the true ones."""
    rng = np.random.default_rng(3)
    languages, rows = ["big", "small"], 4096
    grams = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (2500, 300)]
    table = np.zeros((rows, 1), np.uint64)
    for k, own in enumerate(grams):
        for probe in range(langid.PROBES):
            np.bitwise_or.at(table[:, 0], langid.positions(own, probe, rows), np.uint64(1 << k))
    model = langid.Filters.of(languages, table)
    assert model.wrong[0] > 0.5 > model.wrong[1]
    other = rng.integers(0, 2**63, 3000).astype(np.uint64)
    asked = np.concatenate([grams[1][:200], other])
    raw = model.popcounts(asked)
    right = (raw - model.wrong * len(asked)) / (1 - model.wrong)
    assert raw[0] > raw[1] and abs(right[1] - 200) < 30 and abs(right[0]) < 200
    assert set(model.masks(grams[0])[:, 0] & np.uint64(1)) == {1}  # a filter never misses its own


def test_many_languages(spark):
    """Over 64 languages take more than one word of mask."""
    rows = [(i, " ".join(chr(0x4E00 + 50 * (i % 70) + k) * 2 for k in range(30)), f"l{i % 70:02d}", "s", 0) for i in range(700)]
    got = langid.identify(doc_frame(spark, rows)).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 70:02d}" for r in got)


def test_more_languages_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"wort{'abcdefghij'[i % 10]} " * 5 + "xyz"[i % 3] * 4, "ab"[i % 2], "s", 0) for i in range(400)]
    frame = doc_frame(spark, rows).select("lang", "doc_id", "text")
    few = {tuple(r) for r in langid.training_rows(frame, "lang", "doc_id", "text", 4000).collect()}
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 1)
    assert few == {tuple(r) for r in langid.training_rows(frame, "lang", "doc_id", "text", 4000).collect()} and len(few) > 20


def test_edges(spark):
    frame = edge_documents(spark).selectExpr("*", "'x' as lang_pred", "0 as held_out", "'y' as __p")
    got = langid.identify(frame)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == frame.count()
    texts = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 5):  # empty, null, white space
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif texts[r.doc_id]:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    assert langid.identify(frame.limit(0)).collect() == []
    nothing = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(nothing).collect()} == {("und", 0.0)}
