"""Batch report job (S5): KPI summary, per-dimension performance and rejection reports.

All dimension reports come from ONE grouping-sets aggregate over the table;
its small result (one row per dimension value) is checkpointed to the shared
checkpoint folder so the per-report writes reuse it instead of rescanning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_small
from ..operators import filters as FL
from ..operators import kpis as K

REPORT_FILES = {
    "recruiter": ["recruiter_performance"],
    "client": ["client_performance"],
    "role": ["role_performance", "role_analysis"],
    "source": ["source_performance", "source_analysis"],
    "technology": ["technology_performance", "technology_analysis"],
}


def build_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Report name -> DataFrame (lazy except the checkpointed all-dimension aggregate)."""
    cm = K.resolve(df)
    alld = checkpoint_small(K.kpis_all_dimensions(df, cm))
    reports: dict[str, DataFrame] = {"kpi_summary": K.kpi_summary(K.compute_kpis(df, cm))}
    for key, names in REPORT_FILES.items():
        col = cm.get(key)
        if not col:
            continue
        part = alld.filter(F.col("dimension") == col).drop("dimension").withColumnRenamed("value", col)
        if key == "source":
            part = part.withColumnRenamed("joining_rate_pct", "conversion_rate_pct") \
                       .orderBy(F.col("conversion_rate_pct").desc())
        elif key == "technology":
            part = part.orderBy(F.col("average_salary").desc_nulls_last())
        for n in names:
            reports[n] = part
    reports["rejection_analysis"] = FL.rejections(df, cm).orderBy(F.col("count").desc())
    return reports


def write_reports(df: DataFrame, out_dir: str) -> list[str]:
    """Write every report as a single header CSV under ``out_dir``."""
    from ..session import ensure_checkpoint_dir
    from ..sources.files import save_reports

    ensure_checkpoint_dir(df.sparkSession)
    return save_reports(build_reports(df), out_dir)
