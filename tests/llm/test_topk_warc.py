"""Exact top-k against brute force; WARC round trips, revisits, rolling, lost-task leftovers."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F

from hirelens.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


def brute(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            ints[i] = [floor(256 * float(x)) for x in v]
    out = []
    for q in sorted(i for i in ints if i % 50 == 0):
        scored = [(-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("shard_rows, query_rows, fan_in", [(8192, 1024, 16), (17, 2, 2)])
def test_top_k_equals_brute_force(spark, shard_rows, query_rows, fan_in):
    rng = random.Random(9)
    same = [rng.uniform(-1, 1) for _ in range(8)]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in (same if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(8)])]) for i in range(300)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, same)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    got = topk.exact_top_k(frame.where("vec_id % 50 = 0"), frame, shard_rows=shard_rows, query_rows=query_rows, fan_in=fan_in).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5)


def test_top_k_crosses_no_tables(spark):
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0], 0) for i in range(200)], VECTORS)
    got = topk.exact_top_k(frame.where("vec_id % 50 = 0"), frame, shard_rows=20, query_rows=2)
    assert not {"NestedLoop", "Cartesian"} & set(__import__("re").findall("NestedLoop|Cartesian", got._jdf.queryExecution().toString()))
    assert got.count() == 20


def test_top_k_edges(spark):
    frame = spark.createDataFrame([(0, [0.5, 0.5], 1), (1, [1.0], 1), (2, [], 1), (50, [1e9, 1e9], 1)], VECTORS) \
        .selectExpr("*", "1 as id", "2 as v", "3 as block", "4 as score", "5 as no")
    got = topk.exact_top_k(frame.where("vec_id % 50 = 0"), frame).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [
        (0, 50), (0, 1), (0, 2), (50, 0), (50, 1), (50, 2)]
    assert topk.exact_top_k(frame.limit(0), frame).count() == 0
    assert topk.exact_top_k(frame.limit(1), frame.limit(0)).count() == 0


def pages(spark):
    big, other = "<p>ä</p>" * 200, "<p>b</p>" * 300
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else other if i % 3 == 1 else f"short {i % 2}") for i in range(60)]
    rows += [(7, "http://again\r\n x", other), (58, None, other), (None, None, big), (None, "u", None), (200, "http://x", None),
             (201, "", ""), (2**62, "z", big), (-5, "http://y", "WARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'q' as digest", "1 as shard", "2 as bin")


def expected(rows):
    best = defaultdict(lambda: None)
    for r in rows:
        data = (r["html"] or "").encode()
        if r["page_id"] is not None and len(data) >= 1000:
            best[data] = max(r["page_id"], best[data] if best[data] is not None else r["page_id"])
    out, done = [], set()
    for r in rows:
        data = (r["html"] or "").encode()
        own = best[data] if len(data) >= 1000 and r["page_id"] is not None else None
        response = own is None or (own == r["page_id"] and data not in done)
        if own is not None and response:
            done.add(data)
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else own))
    return out


@pytest.mark.parametrize("shard_bytes, roll_bytes", [(None, 16_000_000), (3000, 500)])
def test_warc_round_trip(spark, tmp_path, shard_bytes, roll_bytes):
    frame = pages(spark)
    manifest = warc.write_warc(frame, str(tmp_path / "w"), shard_bytes=shard_bytes, roll_bytes=roll_bytes).collect()
    (tmp_path / "w" / "_shard-000000-00000.warc.gz-left").write_bytes(b"left by a lost task")
    (tmp_path / "w" / "shard-999999-00000.warc.gz").write_bytes(b"not in the manifest")
    got = warc.read_warc(spark, str(tmp_path / "w"))
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(expected(frame.collect()), key=key)
    texts = sorted(r["payload"].decode() for r in got.where("payload is not null").collect())
    kept = [x for x in expected(frame.collect()) if x[3] == "response"]
    assert sorted(hashlib.sha1(t.encode()).hexdigest() for t in texts) == sorted(x[2] for x in kept)
    if shard_bytes:
        assert len(manifest) > 3 and all(m["records"] for m in manifest)


def test_warc_is_deterministic(spark, tmp_path):
    frame = pages(spark)
    a = warc.write_warc(frame.repartition(1), str(tmp_path / "a"), shard_bytes=3000).collect()
    b = warc.write_warc(frame.repartition(7), str(tmp_path / "b"), shard_bytes=3000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_warc_finds_a_changed_file(spark, tmp_path):
    warc.write_warc(pages(spark), str(tmp_path / "w"))
    name = next((tmp_path / "w").glob("shard-*.warc.gz"))
    name.write_bytes(name.read_bytes()[:-1] + b"x")
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()


def test_warc_empty(spark, tmp_path):
    assert warc.write_warc(pages(spark).limit(0), str(tmp_path / "e")).count() == 0
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    assert F is not None
