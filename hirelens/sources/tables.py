"""Readers for the driver tables plus a size-checked broadcast helper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_BOUND_CACHE: dict[tuple[str, int], bool] = {}


def broadcast_if_bounded(df: DataFrame, max_rows: int = 100_000, cache_key: str | None = None) -> DataFrame:
    """Hint a broadcast only after proving the side has at most ``max_rows`` rows.

    ``limit(n + 1).count()`` stops scanning as soon as the bound is exceeded, so
    the check is cheap even when the table turns out to be large; beyond the
    bound the plain frame is returned and Catalyst/AQE choose a shuffle join.
    ``cache_key`` (e.g. the table path) memoises the verdict for a session.
    """
    key = (cache_key, max_rows) if cache_key else None
    if key is not None and key in _BOUND_CACHE:
        bounded = _BOUND_CACHE[key]
    else:
        bounded = df.limit(max_rows + 1).count() <= max_rows
        if key is not None:
            _BOUND_CACHE[key] = bounded
    return F.broadcast(df) if bounded else df
