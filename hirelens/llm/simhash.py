"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits: eight positional bytes.  Two fingerprints that differ in at most
four bits agree in at least four of those bytes, hence in three of any seven of them.  The
index therefore posts each distinct fingerprint under the 35 triples of its first seven
positions (three positional bytes read at a time keep the lists short).  Within a list the
shared positional bytes of each pair are tallied, pairs that reach the guaranteed minimum
are kept and verified by their bit distance.

Copies are one fingerprint, so they never meet in a list.  From a list only a spanning forest
of the verified links goes on.  Lists over ``list_limit`` are not paired: their members are
linked through the values within half the bit distance of each (two fingerprints at most four
bits apart share a value at most two bits from both), which is linear in the members and
finds exactly the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, components, key_runs, near_in_runs, popcount, shuffle_partitions, written

POSITIONS = 8
CHUNK = 65_536  # shingles hashed at a time: bounded memory for a text of any length


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a null text or one without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_digest
    joined = b" ".join(found)
    if n == 1:
        return int.from_bytes(digest(joined, seed), "big")
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    ends = ends[words - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in pairs]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42) -> F.Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of(docs[text])


def _postings(bits: int):
    """Triples of positions for up to four bits; for fewer, as many bytes as are sure to agree."""
    sure = POSITIONS - bits
    size = min(3, sure)
    span = POSITIONS - (sure - size)  # dropping a position costs at most one agreeing byte
    return [(k, c) for k, c in enumerate(combinations(range(span), size))]


def near_links(prints: DataFrame, bits: int = 4, list_limit: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct values of ``prints.fp`` at most ``bits`` apart, spanning each component."""
    if not 1 <= bits <= 5:
        raise ValueError("bits must be 1 to 5: eight positional bytes guarantee agreement in three")
    spark, lists, fewest = prints.sparkSession, _postings(bits), POSITIONS - bits

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                fp = batch["fp"].to_numpy()[at:at + 20_000]
                octets = fp.astype(">i8").view(np.uint8).reshape(-1, POSITIONS).astype(np.int64)
                for k, positions in lists:
                    key = np.full(len(fp), k, np.int64)
                    for p in positions:
                        key = key << 8 | octets[:, p]
                    yield pd.DataFrame({"key": key, "fp": fp})

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, whole in key_runs(batches, "key", list_limit):
            fp = frame["fp"].to_numpy()
            if not whole:
                yield pd.DataFrame({"a": fp, "b": fp})  # a member of a long list
                continue
            keys, octets = frame["key"].to_numpy(), fp.view(np.uint8).reshape(-1, POSITIONS)

            def near(i, j):
                tally = (octets[i] == octets[j]).sum(axis=1) >= fewest
                tally[tally] = popcount(fp[i[tally]] ^ fp[j[tally]]) <= bits
                return tally

            i, j = near_in_runs(keys, len(frame), near)
            forest = Forest()
            keep = [forest.join(x, y) for x, y in zip(i.tolist(), j.tolist())]  # row numbers: each list apart
            yield pd.DataFrame({"a": fp[i][keep], "b": fp[j][keep]})

    half = bits - bits // 2
    masks = [0]
    for size in range(1, half + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(64), size)]
    masks = np.array(masks, dtype=np.uint64).view(np.int64)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                fp = batch["a"].to_numpy()[at:at + 64]
                yield pd.DataFrame({"key": (fp[:, None] ^ masks).ravel(), "fp": np.repeat(fp, len(masks))})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, _ in key_runs(batches, "key", 1 << 30):  # a value has at most len(masks) fingerprints around it
            keys, fp = frame["key"].to_numpy(), frame["fp"].to_numpy()
            first = np.r_[True, keys[1:] != keys[:-1]]
            head = fp[np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))]
            good = ~first & (popcount(head ^ fp) <= bits)
            yield pd.DataFrame({"a": head[good], "b": fp[good]})

    n = shuffle_partitions(spark)
    distinct = prints.select("fp").distinct()
    found = written(distinct.mapInPandas(post, "key long, fp long").repartition(n, "key")
                    .sortWithinPartitions("key", "fp").mapInPandas(pair, "a long, b long").distinct(), "simhash-pairs")
    hot = found.where("a = b")
    if hot.isEmpty():
        return found
    more = (hot.mapInPandas(around, "key long, fp long").repartition(n, "key")
            .sortWithinPartitions("key", "fp").mapInPandas(meet, "a long, b long").distinct())
    return found.where("a != b").unionByName(more)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4,
                   seed: int = 42, list_limit: int = 1024) -> DataFrame:
    """(id, fp long, component_id): the smallest id among documents reachable over near fingerprints.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows
    each get their row; ids may be null (a component of null ids only has a null id).  An empty
    table gives an empty result; other columns are ignored.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprints(docs, text, words, seed).alias("fp")), "simhash-prints")
    roots = components(near_links(prints, bits, list_limit), "simhash").withColumnRenamed("node", "fp")
    least = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-least")
    rooted = written(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    of_print = written(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-of-print")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group, all columns kept.

    Of repeated rows with that id, one row with the smallest text stays.  Rows with a null id
    stay only in groups without any id, one of each group.
    """
    marked = docs.withColumn("__row", F.monotonically_increasing_id())
    base = written(marked, "simhash-base")
    groups = simhash_groups(base.select("__row", text), "__row", text, **params) \
        .select("__row", F.col("component_id").alias("__group"))
    ids = written(base.select("__row", F.col(id_col).alias("__id")).join(groups, "__row"), "simhash-rows")
    least = written(ids.groupBy("__group").agg(F.min("__id").alias("__least")), "simhash-group-ids")
    kept = (ids.join(least, "__group").where(F.col("__id").eqNullSafe(F.col("__least")))
            .groupBy("__group").agg(F.min("__row").alias("__row")).select("__row"))
    return base.join(kept, "__row", "left_semi").drop("__row")
