"""Rule-based insights, executive findings and the recruitment health score.

The rules read one *facts* row: the global KPIs, recruiter-scorecard picks
and source picks — each a tiny aggregate of an already grouped frame — joined
1 x 1.  Every rule is a ``when(condition, struct(...))`` inside one array that
``inline`` expands to the fired rules; there is no per-rule pass over data and
nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_small
from ..functions.text import fmt1, fmt_int, one_row, pct, round_dec
from .kpis import compute_kpis, funnel_conversion, resolve
from .scorecards import recruiter_scorecards, shared_metrics

SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
# FIXED VALUES: insight-type -> card tone
TONE = {"RISK": "risk", "BOTTLENECK": "action", "DECLINE": "risk", "OPPORTUNITY": "highlight",
        "BENCHMARK": "info", "ANOMALY": "risk", "FORECAST": "info"}


NO_AGED_SCORE = 85.0  # the aging part of the health score where no row has a date


def facts(df: DataFrame, col: dict | None = None) -> DataFrame:
    """One row: KPIs + recruiter card picks/median + source picks."""
    cm = resolve(df, col)
    f = compute_kpis(df, cm)
    # one scan for both dimensions; the tiny result is checkpointed so both consumers share it
    pre = shared_metrics(df, cm, dims=("recruiter", "source"))
    pre = checkpoint_small(pre) if pre is not None else None
    if cm.get("recruiter"):
        cards = recruiter_scorecards(df, cm, pre)
        rk = cm["recruiter"]
        k = F.col(f"`{rk}`").cast("string")
        rfacts = cards.agg(
            F.count(F.lit(1)).alias("r_n"),
            F.median("efficiency_score").alias("r_median"),
            F.min_by(F.struct(k.alias("entity"), F.col("efficiency_score").alias("score"),
                              F.col("joined").alias("joined"), F.col("applications").alias("apps")),
                     F.struct(F.col("efficiency_score"), F.coalesce(k, F.lit("")))).alias("r_bottom"),
            F.max_by(F.struct(k.alias("entity"), F.col("efficiency_score").alias("score")),
                     F.struct(F.col("efficiency_score"), F.coalesce(k, F.lit("")))).alias("r_top"),
        )
    else:
        rfacts = df.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("r_n"), F.lit(None).cast("double").alias("r_median"),
            F.lit(None).cast("struct<entity:string,score:double,joined:bigint,apps:bigint>").alias("r_bottom"),
            F.lit(None).cast("struct<entity:string,score:double>").alias("r_top"))
    if cm.get("source"):
        from .kpis import group_frame, metrics_for
        src = group_frame(metrics_for(pre, cm["source"]), [cm["source"]])
        sk = F.col(f"`{cm['source']}`").cast("string")
        sfacts = src.agg(
            F.count(F.lit(1)).alias("s_n"),
            F.max_by(F.struct(sk.alias("entity"), F.col("joining_rate_pct").alias("rate"),
                              F.col("joined").alias("joined"), F.col("applications").alias("apps")),
                     F.struct(F.col("joining_rate_pct"), F.coalesce(sk, F.lit("")))).alias("s_best"),
            F.max_by(F.struct(sk.alias("entity"), F.col("joining_rate_pct").alias("rate"),
                              F.col("applications").alias("apps")),
                     F.struct(F.col("applications"), F.coalesce(sk, F.lit("")))).alias("s_vol"),
        )
    else:
        sfacts = df.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("s_n"),
            F.lit(None).cast("struct<entity:string,rate:double,joined:bigint,apps:bigint>").alias("s_best"),
            F.lit(None).cast("struct<entity:string,rate:double,apps:bigint>").alias("s_vol"))
    return one_row(f, rfacts, sfacts)


def _insight(rule_no: int, title: str, itype: str, severity: Column | str, metric: str,
             current: Column, comparison: Column | None = None, change: Column | None = None,
             entity: Column | None = None, reason: str = "", action: str = "",
             evidence: list[Column] | None = None) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        F.lit(rule_no).alias("rule_no"),
        F.lit(title).alias("title"),
        F.lit(itype).alias("insight_type"),
        sev.alias("severity"),
        F.lit(metric).alias("metric"),
        current.cast("string").alias("current_value"),
        (comparison if comparison is not None else F.lit(None)).cast("string").alias("comparison_value"),
        (change if change is not None else F.lit(None)).cast("double").alias("change"),
        (entity if entity is not None else F.lit(None)).cast("string").alias("entity"),
        F.lit(reason).alias("reason"),
        F.lit(action).alias("recommended_action"),
        F.array(*(evidence or [])).cast("array<string>").alias("evidence"),
    )


def insights_from_facts(fx: DataFrame) -> DataFrame:
    """The ten ordered rules; output sorted by severity, then rule order."""
    c = F.col
    no_show_rate = pct(c("interview_no_show"), c("interviews_completed") + c("interview_no_show"))
    gap = c("offers_accepted") - c("joined")
    med = c("r_median")
    bottom, top = c("r_bottom"), c("r_top")
    best, vol = c("s_best"), c("s_vol")
    rules = [
        (c("interview_not_scheduled") > 0, _insight(
            1, "Interview scheduling backlog", "BOTTLENECK",
            F.when(c("interview_not_scheduled") > 50, "HIGH").otherwise("MEDIUM"),
            "interview_not_scheduled", c("interview_not_scheduled"),
            reason="Candidates awaiting interview scheduling block funnel velocity.",
            action="Assign scheduling owners and clear the interview queue within 48 hours.",
            evidence=[F.concat(fmt_int(c("interview_not_scheduled")), F.lit(" candidates not scheduled"))])),
        (c("interview_no_show") > 0, _insight(
            2, "Interview no-show risk", "RISK", F.when(no_show_rate > 10, "HIGH").otherwise("MEDIUM"),
            "interview_no_show_rate", round_dec(no_show_rate, 1), F.lit(10.0), no_show_rate - 10.0,
            reason="No-shows waste recruiter and interviewer capacity.",
            action="Enable reminder workflows and confirmation before interview slots.",
            evidence=[F.concat(fmt_int(c("interview_no_show")), F.lit(" no-shows ("), fmt1(no_show_rate),
                               F.lit("% of interview activity)"))])),
        (c("offers_accepted") > c("joined"), _insight(
            3, "Offer-to-join gap", "RISK", "HIGH", "offer_join_gap", gap,
            reason="Accepted offers not yet converted to joining.",
            action="Track documentation, release letters, and onboarding readiness.",
            evidence=[F.concat(fmt_int(gap), F.lit(" accepted offers pending join"))])),
        ((c("interview_selection_rate") < 50) & (c("interviews_completed") > 10), _insight(
            4, "Low interview selection rate", "DECLINE", "MEDIUM", "interview_selection_rate",
            c("interview_selection_rate"), F.lit(50.0), c("interview_selection_rate") - 50.0,
            reason="Screening quality or role calibration may be misaligned.",
            action="Review screening criteria and interviewer feedback loops.",
            evidence=[F.concat(F.lit("Selection rate "), fmt1(c("interview_selection_rate")), F.lit("%")),
                      F.concat(fmt_int(c("interview_selected")), F.lit("/"), fmt_int(c("interviews_completed")),
                               F.lit(" interviews selected"))])),
        ((c("r_n") >= 2) & (bottom["score"] < med - 15), _insight(
            5, "Recruiter underperformance signal", "BENCHMARK", "MEDIUM", "recruiter_efficiency_score",
            bottom["score"], round_dec(med, 1), bottom["score"] - med, bottom["entity"],
            reason="Efficiency score materially below team median.",
            action="Review pipeline aging and conversion stages for this recruiter.",
            evidence=[F.concat(F.lit("Score "), fmt1(bottom["score"]), F.lit(" vs median "), fmt1(med)),
                      F.concat(F.lit("Joined "), bottom["joined"].cast("string"), F.lit("/"),
                               bottom["apps"].cast("string"), F.lit(" applications"))])),
        ((c("r_n") >= 2) & (top["score"] >= med + 10), _insight(
            6, "Top recruiter efficiency", "OPPORTUNITY", "LOW", "recruiter_efficiency_score",
            top["score"], round_dec(med, 1), None, top["entity"],
            reason="Strong normalized efficiency across funnel stages.",
            action="Document best practices from this recruiter for team enablement.",
            evidence=[F.concat(F.lit("Efficiency score "), fmt1(top["score"]))])),
        ((c("s_n") > 0) & (best["rate"] > 0), _insight(
            7, "Highest-quality source", "OPPORTUNITY", "LOW", "source_join_rate", best["rate"],
            entity=best["entity"], reason="Best application-to-join conversion among sources.",
            action="Increase investment in this channel if capacity allows.",
            evidence=[F.concat(fmt1(best["rate"]), F.lit("% join rate")),
                      F.concat(best["joined"].cast("string"), F.lit("/"), best["apps"].cast("string"),
                               F.lit(" applications"))])),
        ((c("s_n") > 0) & (vol["apps"] > c("total") * 0.3) & (vol["rate"] < 5), _insight(
            8, "High-volume low-conversion source", "RISK", "MEDIUM", "source_volume_vs_conversion",
            vol["apps"], entity=vol["entity"], reason="Large volume source with weak join conversion.",
            action="Re-evaluate sourcing spend and screening for this channel.",
            evidence=[F.concat(fmt_int(vol["apps"]), F.lit(" applications")),
                      F.concat(F.lit("Join rate "), fmt1(vol["rate"]), F.lit("%"))])),
        ((c("joining_rate") >= 85) & (c("offers_accepted") > 0), _insight(
            9, "Strong offer conversion", "BENCHMARK", "LOW", "joining_rate", c("joining_rate"), F.lit(85.0),
            reason="Healthy offer acceptance and onboarding execution.",
            action="Maintain onboarding SLA and candidate communication.",
            evidence=[F.concat(F.lit("Joining rate "), fmt1(c("joining_rate")), F.lit("%"))])),
    ]
    fired = F.filter(F.array(*[F.when(cond, s) for cond, s in rules]), lambda x: x.isNotNull())
    snapshot = _insight(
        10, "Pipeline snapshot", "BENCHMARK", "LOW", "applications", c("total"),
        reason="Baseline funnel metrics for current filter scope.",
        action="Apply filters or upload data to surface operational signals.",
        evidence=[F.concat(fmt_int(c("total")), F.lit(" applications → "), fmt_int(c("joined")), F.lit(" joined"))])
    all_rules = F.when(F.size(fired) > 0, fired).otherwise(F.array(snapshot))
    sev_rank = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    out = fx.select(F.inline(all_rules))
    return out.withColumn("severity_rank", sev_rank[F.col("severity")])


def insights(df: DataFrame, col: dict | None = None) -> DataFrame:
    return insights_from_facts(facts(df, col))


def insight_cards(ins: DataFrame) -> DataFrame:
    """Display cards — tone, flat strings with em dash for missing values."""
    tone = F.create_map(*[x for k, v in TONE.items() for x in (F.lit(k), F.lit(v))])
    body = F.when(F.col("recommended_action") != "",
                  F.concat(F.col("reason"), F.lit(" "), F.col("recommended_action"))).otherwise(F.col("reason"))
    return ins.select(
        "rule_no", "severity_rank",
        F.coalesce(tone[F.col("insight_type")], F.lit("info")).alias("tone"),
        F.col("insight_type").alias("type"), "severity", "title", "metric",
        F.col("current_value").alias("current"),
        F.coalesce(F.col("comparison_value"), F.lit("—")).alias("comparison"),
        F.coalesce(F.concat(fmt1(F.col("change")), F.lit("%")), F.lit("—")).alias("change"),
        F.coalesce(F.col("entity"), F.lit("—")).alias("entity"),
        "reason", F.col("recommended_action").alias("action"), body.alias("body"),
        F.array_join(F.col("evidence"), "; ").alias("evidence"),
    )


def executive_findings(kpis: DataFrame, comparison: DataFrame) -> DataFrame:
    """Joined trend (+/-10%), funnel bottleneck, offer acceptance risk, joining strength."""
    joined = comparison.filter((F.col("metric") == "Joined") & F.col("percent_change").isNotNull()) \
                       .agg(F.max("percent_change").alias("joined_change"))
    weakest = funnel_conversion(kpis).agg(
        F.min_by(F.struct("conversion", "rate_pct"), F.struct("rate_pct", "step")).alias("w"))
    fx = one_row(kpis, joined, weakest)
    c = F.col
    rows = [
        F.when(c("joined_change") < -10, F.struct(
            F.lit(1).alias("finding_no"), F.lit("DECLINE").alias("category"),
            F.lit("Hiring volume declining").alias("title"),
            F.concat(F.lit("Joined candidates down "), fmt1(c("joined_change")), F.lit("% vs prior period.")).alias("detail"),
            F.lit("HIGH").alias("severity"))),
        F.when(c("joined_change") > 10, F.struct(
            F.lit(1).alias("finding_no"), F.lit("OPPORTUNITY").alias("category"),
            F.lit("Hiring volume increasing").alias("title"),
            F.concat(F.lit("Joined candidates up "), fmt1(c("joined_change")), F.lit("% vs prior period.")).alias("detail"),
            F.lit("LOW").alias("severity"))),
        F.when(c("w").isNotNull(), F.struct(
            F.lit(2).alias("finding_no"), F.lit("BOTTLENECK").alias("category"),
            F.lit("Biggest funnel bottleneck").alias("title"),
            F.concat(c("w.conversion"), F.lit(" at "), fmt1(c("w.rate_pct")), F.lit("%.")).alias("detail"),
            F.lit("HIGH").alias("severity"))),
        F.when((c("offer_acceptance_rate") < 75) & (c("offers_made") > 5), F.struct(
            F.lit(3).alias("finding_no"), F.lit("RISK").alias("category"),
            F.lit("Offer acceptance below target").alias("title"),
            F.concat(F.lit("Offer acceptance at "), fmt1(c("offer_acceptance_rate")), F.lit("%.")).alias("detail"),
            F.lit("MEDIUM").alias("severity"))),
        F.when(c("joining_rate") >= 85, F.struct(
            F.lit(4).alias("finding_no"), F.lit("STRENGTH").alias("category"),
            F.lit("Strong joining execution").alias("title"),
            F.concat(F.lit("Joining rate "), fmt1(c("joining_rate")), F.lit("%.")).alias("detail"),
            F.lit("LOW").alias("severity"))),
    ]
    return fx.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def health_score(kpis: DataFrame, aging_risk: DataFrame | None, data_quality: DataFrame | None) -> DataFrame:
    """Weighted health score (weights sum to 1.05; not clamped) and its components.

    ``aging_risk`` is a one-row frame with ``aging_risk_score`` (or None -> 85; take it
    with ``empty=NO_AGED_SCORE``, so that a table without dated rows counts 85 too),
    ``data_quality`` a one-row frame with ``health_score`` (or None -> 80).
    """
    c = F.col

    def cap1(x):
        return F.least(x / 100, F.lit(1.0))

    parts = [kpis]
    parts.append(aging_risk.select(c("aging_risk_score").alias("_aging")) if aging_risk is not None
                 else kpis.sparkSession.range(1).select(F.lit(NO_AGED_SCORE).alias("_aging")))
    parts.append(data_quality.select(c("health_score").alias("_dq")) if data_quality is not None
                 else kpis.sparkSession.range(1).select(F.lit(80.0).alias("_dq")))
    fx = one_row(*parts)
    funnel = (cap1(c("screening_rate")) * 0.25 + cap1(c("interview_selection_rate")) * 0.25
              + cap1(c("offer_acceptance_rate")) * 0.25 + cap1(c("joining_rate")) * 0.25) * 100
    tth = c("avg_time_to_hire")
    velocity = F.when(tth.isNotNull() & (tth > 0),
                      F.greatest(F.lit(20.0), F.least(F.lit(100.0), F.lit(45.0) / tth * 100))).otherwise(70.0)
    offer = F.least(c("offer_acceptance_rate"), F.lit(100.0))
    joining = F.least(c("joining_rate"), F.lit(100.0))
    total = funnel * 0.3 + velocity * 0.15 + offer * 0.15 + joining * 0.2 + c("_aging") * 0.15 + c("_dq") * 0.1
    return fx.select(
        round_dec(total, 1).alias("score"),
        round_dec(funnel, 1).alias("funnel_efficiency"),
        round_dec(velocity, 1).alias("hiring_velocity"),
        round_dec(offer, 1).alias("offer_acceptance"),
        round_dec(joining, 1).alias("joining"),
        round_dec(c("_aging"), 1).alias("aging"),
        round_dec(c("_dq"), 1).alias("data_quality"),
        F.lit("Internal Recruitment Health Score").alias("label"),
    )


def executive_package(df: DataFrame, date_col: str | None, as_of: str, th=None,
                      data_quality: DataFrame | None = None, col: dict | None = None) -> dict[str, DataFrame]:
    """Health score, period comparisons, findings and funnel rates sharing one KPI row.

    The one-row KPI frame is checkpointed (reliable, shared folder) so the four
    outputs reuse it instead of re-aggregating the table.
    """
    from .aging import AgingThresholds, aging_risk, aging_summary
    from .trends import period_comparison

    cm = resolve(df, col)
    kp = checkpoint_small(compute_kpis(df, cm))
    aged = aging_summary(df, date_col, as_of, th or AgingThresholds()) if date_col else None
    # one row per metric: checkpointed, because the findings read it too
    comps = checkpoint_small(period_comparison(df, date_col, cm))
    return {
        "health": health_score(kp, aging_risk(aged, NO_AGED_SCORE) if aged is not None else None, data_quality),
        "comparisons": comps,
        "findings": executive_findings(kp, comps),
        "funnel_rates": funnel_conversion(kp),
    }


SECTION = ("section string, position int, item string, value double, comparison double, change double, category string, severity string, "
           "detail string")


def package_sections(package: dict[str, DataFrame]) -> DataFrame:
    """R10 as one result: the sections of ``executive_package`` as tagged rows of one form."""
    c = F.col
    health = package["health"]
    scores = [n for n in health.columns if n != "label"]
    parts = {
        "health": health.select(F.inline(F.array(*[F.struct(
            F.lit(k + 1).alias("position"), F.lit(n).alias("item"), c(n).alias("value"), c("label").alias("detail")) for k, n in enumerate(scores)]))),
        "comparisons": package["comparisons"].select(c("metric_order").alias("position"), c("metric").alias("item"), c("current").alias("value"),
                                                     c("previous").alias("comparison"), c("percent_change").alias("change"), c("note").alias("detail")),
        "findings": package["findings"].select(c("finding_no").alias("position"), c("title").alias("item"), "category", "severity", "detail"),
        "funnel_rates": package["funnel_rates"].select(c("step").alias("position"), c("conversion").alias("item"), c("rate_pct").alias("value")),
    }
    names = [f.split() for f in SECTION.split(", ")]
    rows = [frame.withColumn("section", F.lit(tag)) for tag, frame in parts.items()]
    rows = [r.select(*[(c(n) if n in r.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names]) for r in rows]
    return reduce(DataFrame.unionByName, rows)
