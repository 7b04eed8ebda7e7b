"""Exact top-k inner products: query blocks times shards, partial selection per tile, tree merging.

Vectors are packed into blocks (many rows in one binary matrix).  A tile is one query block
and one shard: a matrix product, of which only each query's k best go on.  Lists of several
shards are merged in a tree, ``fan_in`` shards at a time, so no task gets the lists of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCK = "block long, ids binary, dims long, matrix binary"


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component as double; unusable rows left out.

    Left out are null ids, null vectors and vectors with a null or non-finite component.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))) \
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of one partition packed, ``rows`` at a time, into matrices; shorter vectors end in zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at:at + rows].sort_values("id", kind="stable")
                dims = max(map(len, part["v"]), default=0)
                matrix = np.zeros((len(part), dims), np.int64)
                for k, v in enumerate(part["v"]):
                    matrix[k, :len(v)] = v
                yield pd.DataFrame({"block": [block], "ids": [part["id"].to_numpy(np.int64).tobytes()], "dims": [dims],
                                    "matrix": [matrix.tobytes()]})
                block += 1

    return vectors.mapInPandas(run, BLOCK)


def _tile(q_ids, q, c_ids, c, k: int) -> pd.DataFrame:
    """The k best of one tile for each of its queries: score descending, then smaller id (columns are sorted by id)."""
    dims = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, c))
    bound = (float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))) * max(dims, 1)
    exact = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    scores = q.astype(exact) @ c.astype(exact).T
    scores = scores.astype(np.int64) if exact is not object else scores
    out = []
    for r in range(len(q_ids)):
        row = scores[r]
        own = np.searchsorted(c_ids, q_ids[r], "left"), np.searchsorted(c_ids, q_ids[r], "right")
        allowed = np.r_[0:own[0], own[1]:len(c_ids)]
        row = row[allowed]
        if len(row) > k and exact is not object:
            worst = np.partition(row, len(row) - k)[len(row) - k]
            better = np.flatnonzero(row > worst)
            pick = np.r_[better, np.flatnonzero(row == worst)[:k - len(better)]]
        else:
            pick = np.array(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], dtype=np.int64)
        out.append((np.full(len(pick), r), c_ids[allowed[pick]], row[pick]))
    no, ids, best = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"no": no, "query_id": q_ids[no], "vec_id": ids, "score": best.astype(np.int64)})


def exact_top_k(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5,
                query_rows: int = 1024, shard_rows: int = 8192, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors`` but those with its own id.

    Scores are exact integers; ties go to the smaller id; fewer candidates give fewer rows.  Null
    or non-finite vectors take no part; of unequal lengths the shorter counts as ending in zeros;
    repeated rows count each.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    left = written(_blocks(integer_vectors(queries, id_col, vector).repartition(
        max(1, -(-queries.count() // query_rows))), query_rows), "topk-queries")
    shards = _blocks(integer_vectors(vectors, id_col, vector).repartition(
        max(1, -(-vectors.count() // shard_rows))), shard_rows)
    shards = written(shards.withColumn("shard", F.col("block")), "topk-shards")
    # which block meets which shard is a plain table of names, made in tasks from their number; the matrices join to it
    names = written(shards.select("shard").withColumn("at", F.row_number().over(Window.orderBy("shard")) - 1), "topk-names")
    n_shards = names.count()
    if not n_shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    grid = left.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("at")).join(names, "at")
    tiles = (grid.join(left, "block").join(shards.select("shard", F.col("ids").alias("c_ids"), F.col("dims").alias("c_dims"),
                                                         F.col("matrix").alias("c_matrix")), "shard"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def load(ids, dims, blob):
            ids = np.frombuffer(ids, np.int64)
            return ids, np.frombuffer(blob, np.int64).reshape(len(ids), int(dims))

        for batch in batches:
            for t in batch.itertuples(index=False):
                best = _tile(*load(t.ids, t.dims, t.matrix), *load(t.c_ids, t.c_dims, t.c_matrix), k)
                yield best.assign(at=t.at, no=best["no"] + (t.block << 20))

    merged = tiles.select("block", "at", "ids", "dims", "matrix", "c_ids", "c_dims", "c_matrix") \
        .mapInPandas(run, "no long, query_id long, vec_id long, score long, at long")
    levels, shards_left = 0, n_shards
    while levels == 0 or shards_left > 1:
        merged = merged.withColumn("at", F.floor(F.col("at") / fan_in).cast("long"))
        order = Window.partitionBy("no", "at").orderBy(F.desc("score"), "vec_id")
        merged = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        levels, shards_left = levels + 1, -(-shards_left // fan_in)
    return merged.select("query_id", "rank", "vec_id", "score")
