"""Helpers shared by the operators: tables, written intermediates, sorted streams, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package also where the session was started elsewhere."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    Cuts the lineage: a lost executor rereads these files, and what follows sees their size.
    """
    importable(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@F.pandas_udf(T.StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Each text without the lines at the places ``gone``."""
    def cut(t, places):
        if t is None or not len(places):
            return t
        drop = set(places.tolist())
        return "\n".join([x for k, x in enumerate(t.split("\n")) if k not in drop])

    return pd.Series([cut(t, places) for t, places in zip(text, gone)], dtype=object)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) if x.dtype == np.int64 else x)


def key_runs(batches: Iterator[pd.DataFrame], key: str, most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Cut batches sorted by ``key`` into frames of whole runs of equal keys, with bounded memory.

    Yields (frame, whole).  A run of more than ``most`` rows comes in parts, each with whole=False;
    all other runs come entire, many to a frame, with whole=True.
    """
    held, long_key = None, None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        held = None
        keys = frame[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        last = starts[-1]  # the last run may go on in the next batch
        over = sizes > most
        if long_key is not None and keys[0] == long_key:
            over[0] = True
        if over[-1]:
            long_key = keys[last]
            last = len(keys)
        else:
            long_key = None
        of_long = np.repeat(over, sizes)
        if of_long.any():
            yield frame[of_long], False
        rest = ~of_long[:last]
        if rest.any():
            yield frame[:last][rest], True
        if last < len(keys):
            held = frame[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, True


def near_in_runs(keys: np.ndarray, rows: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j of equal sorted ``keys`` for which ``near(i, j)`` holds, one offset at a time."""
    left, right = [], []
    at = np.arange(rows - 1)
    step = 1
    while len(at):
        at = at[at + step < rows]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        good = at[near(at, at + step)]
        if len(good):
            left.append(good)
            right.append(good + step)
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


class Forest:
    """Union-find over small integers; ``join`` tells whether the two were apart."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds (each node's neighbours are linked to the
    smallest of them) until nothing changes: a logarithmic number of rounds, no collected
    component, each round written to the shared folder.  The minimum of a node is a partial
    aggregate; it is written before the join, so that AQE can split the join of a node that
    has very many links.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a.isNotNull() & b.isNotNull() & (a != b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-links")
    seen = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or (mark["n"], mark["s"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (mark["n"], mark["s"])
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), f"{name}-least")
        large = written(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(),
                        f"{name}-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        edges = written(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-edges")
    raise RuntimeError(f"components of {name} did not settle in {most_rounds} rounds")
