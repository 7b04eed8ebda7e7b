"""Period trends, period-over-period comparison and join forecasts.

All of these aggregate the fact table to one row per period first (a
partial/final hash aggregate); ranking, lag and the last-N selection then run
on that small per-period frame only, never on the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date_col, period_label
from ..functions.text import one_row
from .kpis import kpi_counts, kpi_metrics, resolve

TREND_COLUMNS = ("period", "applications", "screening_selected", "interviews_completed",
                 "interview_selected", "interview_selection_pct", "offers_accepted",
                 "offer_acceptance_pct", "joined", "joining_rate_pct", "avg_time_to_hire")


def _period(df: DataFrame, date_col: str, freq: str):
    return period_label(parse_date_col(df, date_col), freq)


def trends(df: DataFrame, date_col: str | None, freq: str = "M", col: dict | None = None) -> DataFrame:
    """KPIs per day/week/month period; rows without a parseable date are dropped."""
    if not date_col or date_col not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "period string, applications long, screening_selected long, interviews_completed long, "
                "interview_selected long, interview_selection_pct double, offers_accepted long, "
                "offer_acceptance_pct double, joined long, joining_rate_pct double, avg_time_to_hire double")
    cm = resolve(df, col)
    dated = df.withColumn("_period", _period(df, date_col, freq)).filter(F.col("_period").isNotNull())
    m = kpi_metrics(kpi_counts(dated, [F.col("_period")], cm), ["_period"])
    return m.select(
        F.col("_period").alias("period"), F.col("total").alias("applications"), "screening_selected",
        "interviews_completed", "interview_selected",
        F.col("interview_selection_rate").alias("interview_selection_pct"), "offers_accepted",
        F.col("offer_acceptance_rate").alias("offer_acceptance_pct"), "joined",
        F.col("joining_rate").alias("joining_rate_pct"), "avg_time_to_hire")


def _split_period(d, freq: str):
    if freq == "W":
        return F.date_trunc("week", d).cast("date")
    if freq == "M":
        return F.trunc(d, "month")
    return F.trunc(d, "quarter")


def last_two_periods(df: DataFrame, date_col: str, freq: str = "M") -> DataFrame:
    """Rows of the latest and previous *present* periods, tagged current/previous.

    Needs at least two dated rows and two distinct periods, else no rows.  The
    distinct periods (one row each) are ranked; the two winners are broadcast
    back onto the rows (2 rows, bounded by construction).
    """
    if date_col not in df.columns:
        return df.limit(0).withColumn("period_role", F.lit(None).cast("string"))
    start = _split_period(parse_date_col(df, date_col), freq)
    dated = df.withColumn("_p", start).filter(F.col("_p").isNotNull())
    per = dated.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ranked = per.select("_p", "_n", F.dense_rank().over(Window.orderBy(F.col("_p").desc())).alias("_r"),
                        F.count(F.lit(1)).over(Window.partitionBy()).alias("_np"),
                        F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    picks = ranked.filter((F.col("_r") <= 2) & (F.col("_np") >= 2) & (F.col("_rows") >= 2)) \
                  .select("_p", F.when(F.col("_r") == 1, "current").otherwise("previous").alias("period_role"))
    return dated.join(F.broadcast(picks), "_p").drop("_p")


def _monthly_ranked(df: DataFrame, date_col: str, col: dict | None,
                    monthly: DataFrame | None = None) -> DataFrame:
    t = monthly if monthly is not None else trends(df, date_col, "M", col)
    w = Window.orderBy(F.col("period").desc())
    return t.withColumn("_r", F.row_number().over(w)) \
            .withColumn("_np", F.count(F.lit(1)).over(Window.partitionBy()))


COMPARE_METRICS = (
    ("Applications", "applications"), ("Screening Selected", "screening_selected"),
    ("Interviews Completed", "interviews_completed"),
    ("Interview Selection %", "interview_selection_pct"), ("Offers Accepted", "offers_accepted"),
    ("Offer Acceptance %", "offer_acceptance_pct"), ("Joined", "joined"),
    ("Joining Rate %", "joining_rate_pct"), ("Avg Time to Hire", "avg_time_to_hire"),
)


def period_comparison(df: DataFrame, date_col: str | None, col: dict | None = None,
                      monthly: DataFrame | None = None) -> DataFrame:
    """Latest vs previous present month for 8 metrics (+ time to hire when both exist).

    ``monthly`` may pass an already computed ``trends(df, date_col, "M")`` frame.
    """
    schema = ("metric_order int, metric string, current double, previous double, absolute_change double, "
              "percent_change double, sufficient_data boolean, note string")
    if not date_col or date_col not in df.columns:
        return df.sparkSession.createDataFrame([], schema)
    r = _monthly_ranked(df, date_col, col, monthly).filter("_r <= 2 AND _np >= 2")
    # one aggregate row holding current (rank 1) and previous (rank 2) values, built as SQL text
    pair = r.agg(*[F.expr(f"CAST(max(CASE WHEN _r = {k} THEN {c} END) AS DOUBLE) AS {p}_{c}")
                   for _, c in COMPARE_METRICS for k, p in ((1, "c"), (2, "p"))],
                 F.expr("count(1) AS _rows"))
    structs = ", ".join(f"named_struct('metric_order', {i + 1}, 'metric', '{label}', 'current', c_{c}, "
                        f"'previous', p_{c})" for i, (label, c) in enumerate(COMPARE_METRICS))
    rows = pair.filter("_rows = 2").selectExpr(f"inline(array({structs}))") \
               .filter("current IS NOT NULL AND previous IS NOT NULL")
    return rows.selectExpr(
        "metric_order", "metric", "current", "previous",
        "round(current - previous, 2) AS absolute_change",
        "CASE WHEN previous < 1 THEN CAST(NULL AS DOUBLE) ELSE round((current - previous) / previous * 100, 2) END"
        " AS percent_change",
        "(previous > 0 OR current > 0) AS sufficient_data",
        "CASE WHEN previous = 0 AND current > 0 THEN 'No prior-period baseline' ELSE '' END AS note",
    )


INSUFFICIENT_FORECAST = "Insufficient historical data for reliable forecasting."
FORECAST_MESSAGE = "Based on recent monthly join average (ESTIMATE)."


def forecast_joins(df: DataFrame, date_col: str | None, col: dict | None = None,
                   min_periods: int = 3, monthly: DataFrame | None = None) -> DataFrame:
    """Mean +/- sample std of joins over the last 3 present months (1 dp)."""
    if not date_col or date_col not in df.columns:
        spark = df.sparkSession
        return spark.createDataFrame(
            [("joins", 0.0, 0.0, 0.0, False, INSUFFICIENT_FORECAST, 0)],
            "metric string, estimate_low double, estimate_high double, estimate_mid double, "
            "sufficient_data boolean, message string, historical_periods int")
    r = _monthly_ranked(df, date_col, col, monthly)
    recent = F.col("_r") <= 3
    agg = r.agg(F.count(F.lit(1)).alias("n"),
                F.avg(F.when(recent, F.col("joined"))).alias("mean"),
                F.stddev_samp(F.when(recent, F.col("joined"))).alias("sd"),
                F.count_if(recent).alias("k"))
    ok = F.col("n") >= min_periods
    sd = F.when(F.col("k") > 1, F.col("sd")).otherwise(F.col("mean") * 0.1)
    return agg.select(
        F.lit("joins").alias("metric"),
        F.when(ok, F.round(F.greatest(F.lit(0.0), F.col("mean") - sd), 1)).otherwise(0.0).alias("estimate_low"),
        F.when(ok, F.round(F.col("mean") + sd, 1)).otherwise(0.0).alias("estimate_high"),
        F.when(ok, F.round(F.col("mean"), 1)).otherwise(0.0).alias("estimate_mid"),
        ok.alias("sufficient_data"),
        F.when(ok, F.lit(FORECAST_MESSAGE)).otherwise(F.lit(INSUFFICIENT_FORECAST)).alias("message"),
        F.col("n").cast("int").alias("historical_periods"),
    )


GAP_MESSAGE = "ESTIMATE based on recent join velocity and historical conversion."


def target_gap(df: DataFrame, target_hires, date_col: str | None, col: dict | None = None,
               kpis: DataFrame | None = None) -> DataFrame:
    """Hires gap vs a target and applications needed, from the forecast and join rate.

    ``target_hires`` may be an int or a Column (per-question targets).
    """
    from .kpis import compute_kpis

    fc = forecast_joins(df, date_col, col)
    k = (kpis if kpis is not None else compute_kpis(df, col)).select(
        F.when(F.col("total") > 0, F.col("joined") / F.col("total")).otherwise(0.0).alias("_jr"))
    t = target_hires if not isinstance(target_hires, int) else F.lit(target_hires)
    return gap_columns(one_row(fc, k), t)


def gap_columns(both: DataFrame, t) -> DataFrame:
    ok = F.col("sufficient_data") & (F.col("_jr") > 0)
    gap_low = F.greatest(F.lit(0.0), t - F.col("estimate_high"))
    gap_high = F.greatest(F.lit(0.0), t - F.col("estimate_low"))
    conv = F.greatest(F.col("_jr"), F.lit(0.001))
    return both.select(
        *[c for c in both.columns if c not in ("metric", "estimate_low", "estimate_high", "estimate_mid",
                                               "sufficient_data", "message", "historical_periods", "_jr")],
        t.cast("long").alias("target_hires"),
        F.lit("next period").alias("period_label"),
        F.when(ok, F.col("estimate_low")).otherwise(0.0).alias("expected_low"),
        F.when(ok, F.col("estimate_high")).otherwise(0.0).alias("expected_high"),
        F.when(ok, F.col("estimate_mid")).otherwise(0.0).alias("expected_mid"),
        F.when(ok, F.round(gap_low, 1)).otherwise(t.cast("double")).alias("gap_low"),
        F.when(ok, F.round(gap_high, 1)).otherwise(t.cast("double")).alias("gap_high"),
        F.when(ok, F.round(gap_low / conv, 0)).otherwise(0.0).alias("pipeline_required_low"),
        F.when(ok, F.round(gap_high / conv, 0)).otherwise(0.0).alias("pipeline_required_high"),
        ok.alias("sufficient_data"),
        F.when(ok, F.lit(GAP_MESSAGE)).otherwise(F.col("message")).alias("message"),
        F.lit("ESTIMATE").alias("label"),
    )
