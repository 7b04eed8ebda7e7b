"""The whole pipeline against the brute-force versions of its stages, one after another."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from hirelens.llm.params import MIX_WEIGHTS

from .helpers import doc_frame
from .test_lines_rules_licenses import brute_counts, brute_dedup
from .test_mixing import brute_mix
from .test_packing import encode
from .test_simhash import brute_fingerprint, brute_groups


def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(14) for _ in range(5)]
    rows = []
    for i in range(70):
        lines = [line(rng.randint(9, 30)) for _ in range(rng.choice([1, 4, 6, 90]))] + rng.sample(shared, rng.randint(0, 2))
        if rows and i % 7 == 0:
            lines = rows[rng.randrange(len(rows))][1].split("\n")  # a copy, in which some words may differ
            lines = [x + rng.choice(["", "", " end"]) for x in lines]
        if i % 11 == 9:
            lines = [line(rng.randint(9, 30)) for _ in range(60)]
        if i % 11 == 10:
            # the words of the document before in other lines: line dedup keeps it, near-dedup does not
            words = rows[-1][1].split()
            lines = [" ".join(words[k:k + 17]) for k in range(0, len(words), 17)]
        text = "\n".join(lines)
        rows.append((i, text, rng.choice(["en", "de", "fr"]), rng.choice(["src0", "src0", "src1", "src5"]), len(text)))
    return rows


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    doc_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def good(text):
        words, *_, repeats = brute_counts(text)
        return words >= 50 and 100 * repeats <= 50 * words

    kept = [r for r in rows if good(r[1])]  # no line stands in more documents than the limit
    kept = [(r[0], text, *r[2:]) for r, text in zip(kept, brute_dedup(kept)) if text]
    groups = brute_groups({r[0]: brute_fingerprint(r[1]) for r in kept})
    alone = [r for r in kept if groups[r[0]] == r[0]]
    copies = {r[0]: n for r, n in zip(alone, brute_mix(alone, MIX_WEIGHTS, 100, 4, 17))}
    assert len(rows) > len(kept) > len(alone)  # each stage has something to do
    ids = {r[0]: encode(r[1]) for r in alone}
    taken, firsts, windows = defaultdict(int), defaultdict(int), defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        taken[p["doc_id"]] += p["length"]
        firsts[p["doc_id"]] += p["start"] == 0
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert dict(firsts) == {k: n for k, n in copies.items() if n}
    assert dict(taken) == {k: n * len(ids[k]) for k, n in copies.items() if n}
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= 2048
