"""Per-dimension intelligence: recruiter, client, role and source scorecards.

Each scorecard is ONE grouped aggregate over the fact table: the KPI counts
and, when an aging date is given, ``avg(aging_days)`` over the rows whose
date parses (the reference's separate aging join folded into the same
aggregate).  Team medians and top/bottom picks then work on the grouped frame
(one row per group); the 1-row median is broadcast onto it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_small
from ..functions.text import fmt1, round_dec
from .aging import aging_days_col
from .kpis import dimension_metrics, group_frame, kpi_counts, kpi_metrics, metrics_for, resolve


def _cap1(rate: Column) -> Column:
    return F.least(rate / 100, F.lit(1.0))


def _velocity(tth: Column) -> Column:
    return F.when(tth.isNotNull() & (tth > 0),
                  F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.lit(45.0) / tth))).otherwise(1.0)


def _cap1_sql(rate: str) -> str:
    return f"least({rate} / 100, 1.0)"


def _velocity_sql(tth: str) -> str:
    return f"CASE WHEN {tth} IS NOT NULL AND {tth} > 0 THEN greatest(0.2, least(1.0, 45.0 / {tth})) ELSE 1.0 END"


def _round_dec_sql(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def efficiency_score() -> Column:
    """C13 over KPI metric columns: weighted stage rates (0.5 when a stage is empty) + velocity."""
    score = (f"({_cap1_sql('screening_rate')} * 0.2"
             f" + (CASE WHEN interviews_completed > 0 THEN {_cap1_sql('interview_selection_rate')} ELSE 0.5 END) * 0.25"
             f" + (CASE WHEN offers_made > 0 THEN {_cap1_sql('offer_acceptance_rate')} ELSE 0.5 END) * 0.2"
             f" + (CASE WHEN offers_accepted > 0 THEN {_cap1_sql('joining_rate')} ELSE 0.5 END) * 0.25"
             f" + ({_velocity_sql('avg_time_to_hire')}) * 0.1) * 100")
    return F.expr(f"CASE WHEN total = 0 THEN 0.0 ELSE {_round_dec_sql(score, 1)} END")


def aging_extra(df: DataFrame, aging_date_col: str | None, as_of: str | None) -> list[Column]:
    if aging_date_col and aging_date_col in df.columns and as_of:
        return [F.avg(aging_days_col(df, aging_date_col, as_of)).alias("x_avg_aging")]
    return []


def shared_metrics(df: DataFrame, col: dict | None = None, aging_date_col: str | None = None,
                   as_of: str | None = None, dims=("recruiter", "client", "role", "source")) -> DataFrame | None:
    """Metrics for all scorecard dimensions in one grouping-sets scan (pass as ``pre=``)."""
    cm = resolve(df, col)
    return dimension_metrics(df, cm, tuple(dims), aging_extra(df, aging_date_col, as_of))


def _grouped(df: DataFrame, group_col: str, cm: dict, aging_date_col: str | None,
             as_of: str | None, pre: DataFrame | None = None) -> DataFrame:
    if pre is not None:
        m = metrics_for(pre, group_col)
        if "x_avg_aging" in m.columns:
            if aging_date_col and as_of:
                m = m.withColumn("x_avg_aging", F.when(F.col(f"`{group_col}`").isNull(), F.lit(None).cast("double"))
                                 .otherwise(F.col("x_avg_aging")))
            else:
                m = m.drop("x_avg_aging")
        return m
    extra = []
    if aging_date_col and aging_date_col in df.columns and as_of:
        extra.append(F.avg(aging_days_col(df, aging_date_col, as_of)).alias("x_avg_aging"))
    counts = kpi_counts(df, [F.col(f"`{group_col}`")], cm, extra)
    m = kpi_metrics(counts, [group_col])
    if extra:
        # the reference drops NULL keys before averaging aging days: NULL group gets NULL
        m = m.withColumn("x_avg_aging",
                         F.when(F.col(f"`{group_col}`").isNull(), F.lit(None).cast("double"))
                          .otherwise(F.col("x_avg_aging")))
    return m


def _with_median_delta(cards: DataFrame, score_col: str = "efficiency_score") -> DataFrame:
    """Score minus the team median; the window spans the grouped frame (one row per group)."""
    med = F.median(score_col).over(Window.partitionBy())
    return cards.withColumn("vs_team_median", F.round(F.col(score_col) - med, 1))


def _empty(df: DataFrame, name: str, extra: str) -> DataFrame:
    base = (f"`{name}` string, applications long, screening_selected long, interviews long, "
            "interview_selected long, offers long, joined long, screening_rate_pct double, "
            "interview_selection_pct double, offer_acceptance_pct double, joining_rate_pct double, "
            "average_salary double, avg_time_to_hire double")
    return df.sparkSession.createDataFrame([], base + extra)


def recruiter_scorecards(df: DataFrame, col: dict | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Per-recruiter KPIs + efficiency score + delta to the team median."""
    cm = resolve(df, col)
    r = cm.get("recruiter")
    if not r:
        return _empty(df, "recruiter", ", efficiency_score double, vs_team_median double")
    m = _grouped(df, r, cm, None, None, pre).withColumn("x_efficiency", efficiency_score())
    cards = group_frame(m, [r]).withColumnRenamed("x_efficiency", "efficiency_score")
    return _with_median_delta(cards)


def recruiter_intelligence(df: DataFrame, col: dict | None = None, aging_date_col: str | None = None,
                           as_of: str | None = None, pre: DataFrame | None = None) -> DataFrame:
    """R2: R1 + interview completion rate + mean aging days."""
    cm = resolve(df, col)
    r = cm.get("recruiter")
    if not r:
        return _empty(df, "recruiter", ", efficiency_score double, vs_team_median double, "
                                       "interview_completion_rate double")
    m = _grouped(df, r, cm, aging_date_col, as_of, pre).withColumn("x_efficiency", efficiency_score())
    cards = group_frame(m, [r]).withColumnRenamed("x_efficiency", "efficiency_score")
    cards = _with_median_delta(cards).withColumn(
        "interview_completion_rate",
        F.when(F.col("applications") > 0, F.round(F.col("interviews") / F.col("applications") * 100, 2)))
    if "x_avg_aging" in cards.columns:
        cards = cards.withColumnRenamed("x_avg_aging", "avg_aging_days")
    return cards


def client_health_score(has_aging: bool) -> Column:
    """C14 over the per-group report columns."""
    penalty = "coalesce(least(0.3, avg_aging_days / 100), 0.0)" if has_aging else "0.0"
    score = (f"({_cap1_sql('joining_rate_pct')} * 0.35 + {_cap1_sql('offer_acceptance_pct')} * 0.25"
             f" + {_cap1_sql('interview_selection_pct')} * 0.2 + ({_velocity_sql('avg_time_to_hire')}) * 0.2"
             f" - {penalty}) * 100")
    return F.expr(_round_dec_sql(f"greatest(0.0, least(100.0, {score}))", 1))


def client_intelligence(df: DataFrame, col: dict | None = None, aging_date_col: str | None = None,
                        as_of: str | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Per-client KPIs + mean aging days + client health score."""
    cm = resolve(df, col)
    c = cm.get("client")
    if not c:
        return _empty(df, "client", ", client_health_score double")
    cards = group_frame(_grouped(df, c, cm, aging_date_col, as_of, pre), [c])
    has_aging = "x_avg_aging" in cards.columns
    if has_aging:
        cards = cards.withColumnRenamed("x_avg_aging", "avg_aging_days")
    return cards.withColumn("client_health_score", client_health_score(has_aging))


# FIXED VALUES: role difficulty factors (points) and reason texts
DIFFICULTY_RULES = (
    ("interview_selection_pct", "<", 50, 25, "low interview selection"),
    ("offer_acceptance_pct", "<", 70, 20, "low offer acceptance"),
    ("joining_rate_pct", "<", 80, 20, "low joining rate"),
    ("avg_time_to_hire", ">", 40, 15, "long time-to-hire"),
    ("avg_aging_days", ">", 21, 20, "pipeline aging"),
)
LOW_VOLUME_POINTS = 10  # applications < 5; scored but not listed as a reason
NORMAL_RANGE = "within normal range"


def _rule_sql(colname: str, op: str, bound: float, present: set[str]) -> str:
    if colname not in present:
        return "false"
    return f"coalesce({colname} {op} {bound}, false)"


def role_intelligence(df: DataFrame, col: dict | None = None, aging_date_col: str | None = None,
                      as_of: str | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Per-role KPIs + mean aging days + hiring difficulty score and reasons."""
    cm = resolve(df, col)
    r = cm.get("role")
    if not r:
        return _empty(df, "role", ", hiring_difficulty_score double, difficulty_reasons string")
    cards = group_frame(_grouped(df, r, cm, aging_date_col, as_of, pre), [r])
    if "x_avg_aging" in cards.columns:
        cards = cards.withColumnRenamed("x_avg_aging", "avg_aging_days")
    present = set(cards.columns)
    hits = [(_rule_sql(c, op, b, present), pts, why) for c, op, b, pts, why in DIFFICULTY_RULES]
    points = " + ".join(f"(CASE WHEN {h} THEN {pts} ELSE 0 END)" for h, pts, _ in hits) \
        + f" + (CASE WHEN applications < 5 THEN {LOW_VOLUME_POINTS} ELSE 0 END)"
    reasons = "concat_ws('; ', " + ", ".join(f"CASE WHEN {h} THEN '{why}' END" for h, _, why in hits) + ")"
    return cards.selectExpr(
        "*", f"CAST(least(100, {points}) AS DOUBLE) AS hiring_difficulty_score",
        f"CASE WHEN {reasons} = '' THEN '{NORMAL_RANGE}' ELSE {reasons} END AS difficulty_reasons")


def source_intelligence(df: DataFrame, col: dict | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Per-source KPIs + quality score (join 0.5, interview selection 0.3, offer 0.2)."""
    cm = resolve(df, col)
    s = cm.get("source")
    if not s:
        return _empty(df, "source", ", application_to_join_pct double, quality_score double")
    cards = group_frame(_grouped(df, s, cm, None, None, pre), [s])
    return cards.withColumn("application_to_join_pct", F.col("joining_rate_pct")) \
                .withColumn("quality_score", round_dec(F.col("application_to_join_pct") * 0.5
                                                       + F.col("interview_selection_pct") * 0.3
                                                       + F.col("offer_acceptance_pct") * 0.2, 2))


def _pick(cards: DataFrame, key: str, order_col: str, highest: bool) -> Column:
    """max_by/min_by with the key as tie-break (a distributed partial aggregate)."""
    k = F.col(f"`{key}`")
    order = F.struct(F.col(order_col), F.coalesce(k.cast("string"), F.lit("")))
    return (F.max_by if highest else F.min_by)(k.cast("string"), order)


def recruiter_highlights(cards: DataFrame, key: str = "recruiter") -> DataFrame:
    """Top performer, underperformer, highest volume, best conversion."""
    picks = cards.agg(
        _pick(cards, key, "efficiency_score", True).alias("top"),
        F.max("efficiency_score").alias("top_v"),
        _pick(cards, key, "efficiency_score", False).alias("bottom"),
        F.min("efficiency_score").alias("bottom_v"),
        _pick(cards, key, "applications", True).alias("vol"),
        F.max("applications").alias("vol_v"),
        _pick(cards, key, "joining_rate_pct", True).alias("conv"),
        F.max("joining_rate_pct").alias("conv_v"),
        F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") > 0)
    rows = F.array(
        F.struct(F.lit("top_performer").alias("highlight"), F.col("top").alias("entity"),
                 F.concat(F.lit("Efficiency "), fmt1(F.col("top_v"))).alias("detail")),
        F.struct(F.lit("underperformer").alias("highlight"), F.col("bottom").alias("entity"),
                 F.concat(F.lit("Efficiency "), fmt1(F.col("bottom_v"))).alias("detail")),
        F.struct(F.lit("high_volume").alias("highlight"), F.col("vol").alias("entity"),
                 F.concat(F.col("vol_v").cast("string"), F.lit(" applications")).alias("detail")),
        F.struct(F.lit("best_conversion").alias("highlight"), F.col("conv").alias("entity"),
                 F.concat(F.lit("Join rate "), fmt1(F.col("conv_v")), F.lit("%")).alias("detail")),
    )
    return picks.select(F.inline(rows))


def best_source(intel: DataFrame, key: str = "source") -> DataFrame:
    """The source with the highest quality score."""
    return intel.agg(_pick(intel, key, "quality_score", True).alias("source"),
                     F.max("quality_score").alias("quality_score"),
                     F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0).drop("_n")


def top_entities(df: DataFrame, col: dict | None = None) -> DataFrame:
    """W10 (legacy dashboard picks): first recruiter of the report (key order, NULL last),
    client with the highest joining rate, technology with the highest average salary.

    All three come from one grouping-sets aggregate; each pick is a ``min_by``/``max_by``
    over one row per group.
    """
    cm = resolve(df, col)
    dims = tuple(d for d in ("recruiter", "client", "technology") if cm.get(d))
    if not dims:
        return df.sparkSession.createDataFrame(
            [], "entity_type string, entity string, metric string, value double, joined bigint")
    # one grouping-sets scan; its tiny result is checkpointed so the three picks share it
    pre = checkpoint_small(dimension_metrics(df, cm, dims))
    parts = []
    for d in dims:
        g = group_frame(metrics_for(pre, cm[d]), [cm[d]])
        k = F.col(f"`{cm[d]}`").cast("string")
        if d == "recruiter":
            metric, pick = "joining_rate_pct", F.min_by(
                F.struct(k.alias("e"), F.col("joining_rate_pct").alias("v"), F.col("joined").alias("j")),
                F.struct(k.isNull(), F.coalesce(k, F.lit(""))))
        else:
            metric = "joining_rate_pct" if d == "client" else "average_salary"
            pick = F.max_by(F.struct(k.alias("e"), F.col(metric).alias("v"), F.col("joined").alias("j")),
                            F.struct(F.col(metric), F.coalesce(k, F.lit(""))))
        parts.append(g.agg(pick.alias("p")).filter(F.col("p").isNotNull()).select(
            F.lit(d).alias("entity_type"), F.col("p.e").alias("entity"), F.lit(metric).alias("metric"),
            F.col("p.v").cast("double").alias("value"), F.col("p.j").cast("long").alias("joined")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
