"""Pipeline aging: days since a reference date, buckets, risk score, per-group view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import aging_days as _aging_days
from ..functions.dates import parse_date_col


@dataclass(frozen=True)
class AgingThresholds:
    healthy_max: int = S.AGING_HEALTHY_MAX
    watch_max: int = S.AGING_WATCH_MAX
    aging_max: int = S.AGING_AGING_MAX


BUCKET_WEIGHT = {"HEALTHY": 0, "WATCH": 1, "AGING": 2, "CRITICAL": 3}


def aging_bucket(days: Column, th: AgingThresholds) -> Column:
    """C11: <= healthy -> HEALTHY, <= watch -> WATCH, <= aging -> AGING, else CRITICAL."""
    return (F.when(days <= th.healthy_max, "HEALTHY")
            .when(days <= th.watch_max, "WATCH")
            .when(days <= th.aging_max, "AGING")
            .otherwise("CRITICAL"))


def aging_days_col(df: DataFrame, date_col: str | None, as_of: str) -> Column:
    """Whole days from the parsed date to the as-of date; NULL when unparseable/absent."""
    if not date_col or date_col not in df.columns:
        return F.lit(None).cast("int")
    return _aging_days(parse_date_col(df, date_col), as_of)


def aging_summary(df: DataFrame, date_col: str | None, as_of: str,
                  th: AgingThresholds = AgingThresholds()) -> DataFrame:
    """Rows with a parseable date, plus ``aging_days`` and ``aging_bucket``."""
    days = aging_days_col(df, date_col, as_of)
    aged = df.withColumn("aging_days", days).filter(F.col("aging_days").isNotNull())
    return aged.withColumn("aging_bucket", aging_bucket(F.col("aging_days"), th))


def aging_buckets(aged: DataFrame) -> DataFrame:
    """A11 histogram: candidates per bucket."""
    return aged.groupBy(F.col("aging_bucket").alias("bucket")) \
               .agg(F.count(F.lit(1)).alias("candidates"))


def bucket_weight(bucket: Column) -> Column:
    m = F.create_map(*[x for k, v in BUCKET_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[bucket], F.lit(0))


def aging_risk_agg(aged_bucket: Column) -> Column:
    """Aggregate expression for A12 (NULL when no rows; callers coalesce to 100)."""
    return F.avg(bucket_weight(aged_bucket))


def aging_risk_from_avg(avg_weight: Column, empty: float = 100.0) -> Column:
    # no aged rows -> ``empty`` (``greatest`` would skip the NULL and give 0)
    return F.when(avg_weight.isNull(), F.lit(empty)).otherwise(
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - avg_weight * 25), 1))


def aging_risk(aged: DataFrame, empty: float = 100.0) -> DataFrame:
    """max(0, 100 - 25 * mean bucket weight), 1 dp; ``empty`` for no rows."""
    return aged.agg(aging_risk_agg(F.col("aging_bucket")).alias("_w")) \
               .select(aging_risk_from_avg(F.col("_w"), empty).alias("aging_risk_score"))


def group_aging(df: DataFrame, group_col: str | None, date_col: str | None, as_of: str,
                th: AgingThresholds = AgingThresholds()) -> DataFrame:
    """Per group count, mean days (1 dp), CRITICAL and AGING counts; NULL keys dropped."""
    if not group_col or group_col not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "group string, candidates long, avg_aging_days double, critical long, aging long")
    aged = aging_summary(df, date_col, as_of, th).filter(F.col(f"`{group_col}`").isNotNull())
    return aged.groupBy(F.col(f"`{group_col}`")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.round(F.avg("aging_days"), 1).alias("avg_aging_days"),
        F.count_if(F.col("aging_bucket") == "CRITICAL").alias("critical"),
        F.count_if(F.col("aging_bucket") == "AGING").alias("aging"),
    )
