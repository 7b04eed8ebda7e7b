"""Batch intent tagging and deterministic answers for a column of questions.

Questions can be many (every user turn of every conversation); the facts
they are answered from are few.  The plan is therefore:

* tag every question with one ``when`` chain (narrow, codegen'd);
* build a tiny facts table keyed by (intent, ranking) from grouped frames;
* for aging questions, aggregate applications to one row per aging day, add
  the distinct thresholds, and take a descending running sum — "rows older
  than N days" for every N in one window over (days + thresholds) rows;
* join questions to both (small sides, size-checked broadcast) and format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_small
from ..functions.text import fmt0, fmt1, fmt_int, one_row, round_dec
from .aging import AgingThresholds, aging_days_col
from .kpis import compute_kpis, funnel_conversion, resolve
from .scorecards import (client_intelligence, recruiter_intelligence, role_intelligence,
                         shared_metrics, source_intelligence)
from .trends import forecast_joins, period_comparison, trends

# FIXED VALUES: answer texts
UNKNOWN_ANSWER = ("I could not interpret that question. Try: 'Which recruiter is underperforming?' "
                  "or 'Where is the biggest funnel bottleneck?'")
ACTIONS = {
    "declining_hires": "Review funnel stages with largest conversion drops.",
    "bottleneck": "Focus operational effort on the weakest conversion stage.",
    "recruiter_ranking": "Review recruiter pipeline aging and stage conversion.",
    "client_ranking": "Align client expectations and screening calibration.",
    "source_ranking": "Balance volume and quality when allocating sourcing spend.",
    "role_ranking": "Review role requirements, compensation, and pipeline aging.",
    "aging_query": "Prioritize recruiter follow-up on aging candidates.",
    "forecast_target": "Increase sourcing or improve conversion at bottleneck stage.",
}
NO_DATA = {"recruiter_ranking": "No recruiter data available.", "client_ranking": "No client data available.",
           "source_ranking": "No source data available.", "role_ranking": "No role data available."}
NO_AGING = "No date data for aging analysis."
EVIDENCE = "array<struct<metric:string,value:double,text:string,comparison:double,change:double,entity:string,detail:string>>"
METRICS = "map<string,double>"


def _evidence(metric: str, value: Column | None = None, text: Column | None = None, comparison: Column | None = None,
              change: Column | None = None, entity: Column | None = None, detail: Column | None = None) -> Column:
    """One piece of evidence: a number in ``value`` or a word in ``text``."""
    def of(x: Column | None, kind: str) -> Column:
        return (F.lit(None) if x is None else x).cast(kind)

    return F.struct(F.lit(metric).alias("metric"), of(value, "double").alias("value"), of(text, "string").alias("text"),
                    of(comparison, "double").alias("comparison"), of(change, "double").alias("change"),
                    of(entity, "string").alias("entity"), of(detail, "string").alias("detail"))


def _metrics(**values: Column) -> Column:
    pairs = [x for name, v in values.items() for x in (F.lit(name), v.cast("double"))]
    return F.create_map(*pairs).cast(METRICS)


def _first_int(q: Column) -> Column:
    return F.regexp_extract(q, r"(\d+)", 1).try_cast("bigint")


def tag_intents(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Adds intent, ranking, aging_days and target_hires (first matching rule wins)."""
    q = F.lower(F.regexp_replace(F.col(text_col).cast("string"), r"^\s+|\s+$", ""))
    has = q.contains
    intent = (
        F.when(F.coalesce(q, F.lit("")) == "", "unknown")
        .when(q.rlike("stuck|aging|days") & q.rlike(r"\d+"), "aging_query")
        .when(has("stuck") | has("aging"), "aging_query")
        .when(has("declin") & (has("hire") | has("join")), "declining_hires")
        .when(has("bottleneck") | has("funnel"), "bottleneck")
        .when(has("recruiter"), "recruiter_ranking")
        .when(has("client"), "client_ranking")
        .when(has("source"), "source_ranking")
        .when(has("role") | has("hard to hire"), "role_ranking")
        .when(q.rlike(r"\d+\s*hire") | has("target"), "forecast_target")
        .otherwise("unknown")
    )
    tagged = questions.withColumn("intent", intent).withColumn("_q", q)
    qq = F.col("_q")
    ranking = (
        F.when(F.col("intent") == "recruiter_ranking",
               F.when(qq.contains("underperform") | qq.contains("worst") | qq.contains("low"), "worst")
               .otherwise("best"))
        .when(F.col("intent") == "client_ranking",
              F.when(qq.contains("worst") | qq.contains("hard"), "worst").otherwise("best"))
        .when(F.col("intent") == "source_ranking",
              F.when(qq.contains("best") | qq.contains("quality"), "best").otherwise("volume"))
        .when(F.col("intent") == "role_ranking", "hard")
    )
    aging = F.when(F.col("intent") == "aging_query",
                   F.when(qq.rlike("stuck|aging|days") & qq.rlike(r"\d+"), _first_int(qq)).otherwise(F.lit(14)))
    target = F.when(F.col("intent") == "forecast_target", F.coalesce(_first_int(qq), F.lit(100)))
    return (tagged.withColumn("ranking", ranking)
                  .withColumn("aging_days", aging.cast("bigint"))
                  .withColumn("target_hires", target.cast("bigint"))
                  .drop("_q"))


def stuck_counts(df: DataFrame, thresholds: DataFrame, date_col: str | None, as_of: str) -> DataFrame:
    """For every threshold N: rows whose aging days are strictly greater than N.

    One aggregate to (aging_day -> rows), then one descending running sum over
    the day rows plus the threshold markers; the window sees only
    #distinct days + #distinct thresholds rows.
    """
    days = aging_days_col(df, date_col, as_of)
    hist = (df.select(days.alias("d")).filter(F.col("d").isNotNull())
              .groupBy("d").agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("d").cast("bigint").alias("d"), "n", F.lit(1).alias("kind")))
    marks = thresholds.select(F.col("threshold").cast("bigint").alias("d"), F.lit(0).cast("long").alias("n"),
                              F.lit(0).alias("kind")).distinct()
    # at equal day the marker (kind 0) sorts before the histogram row, so "> N" excludes day N
    w = Window.orderBy(F.col("d").desc(), F.col("kind").asc()).rowsBetween(Window.unboundedPreceding, -1)
    both = hist.unionByName(marks).withColumn("_gt", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return both.filter(F.col("kind") == 0).select(F.col("d").alias("threshold"),
                                                 F.col("_gt").cast("long").alias("stuck_count"))


def _answer_facts(df: DataFrame, cm: dict, date_col: str | None, as_of: str,
                  th: AgingThresholds, kp: DataFrame | None = None,
                  monthly: DataFrame | None = None) -> DataFrame:
    """One row per (intent, ranking) with the answer text and entity.

    Each part aggregates an already grouped frame (one row per group) to one row.
    """
    parts: list[DataFrame] = []

    def row(intent, ranking, answer, evidence, entity=None, metrics=None):
        return F.struct(F.lit(intent).alias("intent"), F.lit(ranking).cast("string").alias("ranking"),
                        answer.alias("answer"),
                        (entity if entity is not None else F.lit(None)).cast("string").alias("entity"),
                        F.array_compact(F.array(evidence)).cast(EVIDENCE).alias("evidence"),
                        (metrics if metrics is not None else F.create_map()).cast(METRICS).alias("metrics"),
                        (F.array(shown(entity)) if entity is not None else F.array()).cast("array<string>").alias("entities"))

    def emit(frame: DataFrame, *rows: Column) -> None:
        parts.append(frame.select(F.inline(F.array(*rows))))

    def shown(e: Column) -> Column:
        # a missing group key prints as the reference's f-string does for a missing value
        return F.coalesce(e, F.lit("nan"))

    def order_pick(key, col, highest):
        k = F.col(f"`{key}`").cast("string")
        return (F.max_by if highest else F.min_by)(F.struct(k.alias("e"), F.col(col).alias("v")),
                                                   F.struct(F.col(col), F.coalesce(k, F.lit(""))))

    kp = kp if kp is not None else compute_kpis(df, cm)
    # all four scorecards slice one grouping-sets aggregate; its result (one row per
    # dimension value) is checkpointed so the slices share one scan and later plans stay small
    pre = shared_metrics(df, cm, date_col, as_of)
    pre = checkpoint_small(pre) if pre is not None else None
    w = funnel_conversion(kp).agg(F.min_by(F.struct("conversion", "rate_pct"),
                                           F.struct("rate_pct", "step")).alias("w"))
    emit(w, row("bottleneck", None, F.concat(
        F.lit("The biggest funnel bottleneck is "), F.col("w.conversion"), F.lit(" at "),
        fmt1(F.col("w.rate_pct")), F.lit("%.")),
        _evidence("bottleneck", text=F.col("w.conversion"), detail=F.concat(fmt1(F.col("w.rate_pct")), F.lit("%")))))

    comp = period_comparison(df, date_col, cm, monthly).filter(F.col("metric") == "Joined") \
        .agg(F.max("percent_change").alias("pc"), F.max("current").alias("now"), F.max("previous").alias("before"))
    prior = F.when(F.col("pc").isNotNull(), F.concat(
        F.lit(" Prior period comparison: "), fmt1(F.col("pc")), F.lit("% change."))).otherwise(F.lit(""))
    emit(one_row(kp, comp), row("declining_hires", None, F.concat(
        F.lit("Current joined count is "), fmt_int(F.col("joined")), F.lit("."), prior),
        F.when(F.col("now").isNotNull(), _evidence("Joined (current)", F.col("now"), comparison=F.col("before"), change=F.col("pc"))),
        metrics=_metrics(joined=F.col("joined"))))

    if cm.get("recruiter"):
        ri = recruiter_intelligence(df, cm, date_col, as_of, pre)
        rk = cm["recruiter"]
        p = ri.agg(order_pick(rk, "efficiency_score", False).alias("lo"),
                   order_pick(rk, "efficiency_score", True).alias("hi"))
        emit(p,
             row("recruiter_ranking", "worst", F.concat(
                 shown(F.col("lo.e")), F.lit(" has the lowest efficiency score ("), fmt1(F.col("lo.v")), F.lit(").")),
                 _evidence("recruiter", text=shown(F.col("lo.e")), detail=F.concat(F.lit("score "), fmt1(F.col("lo.v")))),
                 F.col("lo.e")),
             row("recruiter_ranking", "best", F.concat(
                 shown(F.col("hi.e")), F.lit(" leads with efficiency score "), fmt1(F.col("hi.v")), F.lit(".")),
                 _evidence("recruiter", text=shown(F.col("hi.e")), detail=F.concat(F.lit("score "), fmt1(F.col("hi.v")))),
                 F.col("hi.e")))
    if cm.get("client"):
        ci = client_intelligence(df, cm, date_col, as_of, pre)
        ck = cm["client"]
        p = ci.agg(order_pick(ck, "client_health_score", False).alias("lo"),
                   order_pick(ck, "client_health_score", True).alias("hi"))
        emit(p,
             row("client_ranking", "worst", F.concat(
                 shown(F.col("lo.e")), F.lit(" is the hardest client (health score "), fmt1(F.col("lo.v")), F.lit(").")),
                 _evidence("client_health", F.col("lo.v"), entity=shown(F.col("lo.e"))), F.col("lo.e")),
             row("client_ranking", "best", F.concat(
                 shown(F.col("hi.e")), F.lit(" is the strongest client (health score "), fmt1(F.col("hi.v")), F.lit(").")),
                 _evidence("client_health", F.col("hi.v"), entity=shown(F.col("hi.e"))), F.col("hi.e")))
    if cm.get("source"):
        si = source_intelligence(df, cm, pre)
        sk = cm["source"]
        p = si.agg(order_pick(sk, "applications", True).alias("vol"),
                   order_pick(sk, "quality_score", True).alias("q"))
        emit(p,
             row("source_ranking", "volume", F.concat(
                 shown(F.col("vol.e")), F.lit(" has highest volume ("), F.col("vol.v").cast("string"),
                 F.lit(" applications).")), _evidence("source", text=shown(F.col("vol.e"))), F.col("vol.e")),
             row("source_ranking", "best", F.concat(
                 shown(F.col("q.e")), F.lit(" has the best quality score ("), fmt1(F.col("q.v")), F.lit(").")),
                 _evidence("source", text=shown(F.col("q.e"))), F.col("q.e")))
    if cm.get("role"):
        ro = role_intelligence(df, cm, date_col, as_of, pre)
        k = F.col(f"`{cm['role']}`").cast("string")
        p = ro.agg(F.max_by(F.struct(k.alias("e"), F.col("hiring_difficulty_score").alias("v"),
                                     F.col("difficulty_reasons").alias("why")),
                            F.struct(F.col("hiring_difficulty_score"), F.coalesce(k, F.lit("")))).alias("hard"))
        emit(p, row("role_ranking", "hard", F.concat(
            shown(F.col("hard.e")), F.lit(" is hardest to hire (difficulty "), fmt1(F.col("hard.v")), F.lit("): "),
            F.col("hard.why"), F.lit(".")), _evidence("difficulty", F.col("hard.v"), entity=shown(F.col("hard.e"))), F.col("hard.e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answers(questions: DataFrame, df: DataFrame, date_col: str | None, as_of: str,
            th: AgingThresholds = AgingThresholds(), col: dict | None = None,
            text_col: str = "question") -> DataFrame:
    """A deterministic answer and recommended action for every question."""
    return full_answers(questions, df, date_col, as_of, th, col, text_col) \
        .drop("evidence", "metrics", "entities", "answer_source")


def full_answers(questions: DataFrame, df: DataFrame, date_col: str | None, as_of: str,
                 th: AgingThresholds = AgingThresholds(), col: dict | None = None,
                 text_col: str = "question") -> DataFrame:
    """R12 with what each answer rests on: ``evidence`` (array of structs), ``metrics`` (map), ``entities``, ``answer_source``.

    Ranking, bottleneck and trend answers take theirs from their facts row; aging and
    forecast answers build theirs from the question's own threshold or target.  A question
    without an answer has empty arrays and an empty map, never NULL.
    """
    cm = resolve(df, col)
    tagged = tag_intents(questions, text_col)
    # the one-row KPIs and the per-month trend rows feed several facts: compute each once
    # (tiny results, reliable checkpoint in the shared folder) instead of once per consumer
    kp_all = checkpoint_small(compute_kpis(df, cm))
    monthly = (checkpoint_small(trends(df, date_col, "M", cm))
               if date_col and date_col in df.columns else None)
    fc = forecast_joins(df, date_col, cm, monthly=monthly)
    jr = kp_all.select(
        F.when(F.col("total") > 0, F.col("joined") / F.col("total")).otherwise(0.0).alias("_jr"))
    # the forecast is one more facts row (intent forecast_target), so every question reaches its
    # facts through the same equi-join on (intent, ranking)
    fc_row = one_row(fc, jr).select(
        F.lit("forecast_target").alias("intent"), F.lit(None).cast("string").alias("ranking"),
        F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("entity"),
        "estimate_low", "estimate_high", "estimate_mid", "sufficient_data", "message", "_jr")
    facts = _answer_facts(df, cm, date_col, as_of, th, kp_all, monthly) \
        .unionByName(fc_row, allowMissingColumns=True)
    thresholds = tagged.filter(F.col("intent") == "aging_query") \
                       .select(F.when(F.col("aging_days") == 0, 14).otherwise(F.col("aging_days"))
                               .alias("threshold")).filter(F.col("threshold").isNotNull()).distinct()
    has_dates = bool(date_col and date_col in df.columns)
    stuck = stuck_counts(df, thresholds, date_col, as_of) if has_dates else None

    # at most one row per (intent, ranking) by construction: a fixed-size broadcast
    facts = F.broadcast(facts.withColumnRenamed("intent", "_f_intent").withColumnRenamed("ranking", "_f_ranking"))
    # null-safe on ranking: bottleneck / declining-hires / forecast answers have no ranking
    j = tagged.join(facts, (F.col("intent") == F.col("_f_intent"))
                    & F.col("ranking").eqNullSafe(F.col("_f_ranking")), "left").drop("_f_intent", "_f_ranking")
    j = j.withColumn("_thr", F.when(F.col("intent") == "aging_query",
                                    F.when(F.col("aging_days") == 0, 14).otherwise(F.col("aging_days"))))
    if stuck is not None:
        # one row per distinct threshold: AQE broadcasts it when its measured size is small
        j = j.join(stuck, F.col("_thr") == F.col("threshold"), "left")
    else:
        j = j.withColumn("stuck_count", F.lit(None).cast("long"))
    tgt = F.when(F.col("target_hires") == 0, 100).otherwise(F.col("target_hires"))
    ok = F.col("sufficient_data") & (F.col("_jr") > 0)
    g_low = F.greatest(F.lit(0.0), tgt - F.col("estimate_high"))
    g_high = F.greatest(F.lit(0.0), tgt - F.col("estimate_low"))
    conv = F.greatest(F.col("_jr"), F.lit(0.001))
    forecast_text = F.when(ok, F.concat(
        F.lit("ESTIMATE: expected joins "), fmt0(F.col("estimate_low")), F.lit("–"), fmt0(F.col("estimate_high")),
        F.lit(" vs target "), tgt.cast("string"),
        F.lit(". Gap "), fmt0(round_dec(g_low, 1)), F.lit("–"), fmt0(round_dec(g_high, 1)),
        F.lit(". Additional pipeline ~"), fmt_int(round_dec(g_low / conv, 0)), F.lit("–"),
        fmt_int(round_dec(g_high / conv, 0)), F.lit(" applications."))).otherwise(F.col("message"))
    intent = F.col("intent")
    answer = (
        F.when(intent == "aging_query",
               F.when(F.lit(has_dates) & F.col("stuck_count").isNotNull(),
                      F.concat(fmt_int(F.col("stuck_count")), F.lit(" candidates are aging beyond "),
                               F.col("_thr").cast("string"), F.lit(" days.")))
               .otherwise(F.lit(NO_AGING)))
        .when(intent == "forecast_target", forecast_text)
        .when(intent == "unknown", F.lit(UNKNOWN_ANSWER))
        .when(intent.isin(*NO_DATA) & F.col("answer").isNull(),
              F.create_map(*[x for k, v in NO_DATA.items() for x in (F.lit(k), F.lit(v))])[intent])
        .otherwise(F.col("answer"))
    )
    action_map = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    action = F.when((intent == "aging_query") & ~(F.lit(has_dates) & F.col("stuck_count").isNotNull()), F.lit(""))\
        .when((intent == "forecast_target") & ~ok, F.lit("")) \
        .when(intent.isin(*NO_DATA) & F.col("answer").isNull(), F.lit("")) \
        .otherwise(F.coalesce(action_map[intent], F.lit("")))
    aged = (intent == "aging_query") & F.lit(has_dates) & F.col("stuck_count").isNotNull()
    forecast = (intent == "forecast_target") & ok
    evidence = (F.when(aged, F.array(_evidence("stuck_candidates", F.col("stuck_count"))))
                .when(forecast, F.array(_evidence("expected_joins_mid", F.col("estimate_mid")),
                                        _evidence("gap_high", round_dec(g_high, 1))))
                .otherwise(F.col("evidence")))
    metrics = (F.when(aged, _metrics(threshold_days=F.col("_thr"), stuck_count=F.col("stuck_count")))
               .when(forecast, _metrics(target=tgt, expected_mid=F.col("estimate_mid")))
               .otherwise(F.col("metrics")))
    keep = [c for c in questions.columns]
    return j.select(*[F.col(f"`{c}`") for c in keep], "intent", "ranking", "aging_days", "target_hires",
                    answer.alias("answer"), F.col("entity"), action.alias("recommended_action"),
                    F.coalesce(evidence, F.array().cast(EVIDENCE)).alias("evidence"),
                    F.coalesce(metrics, F.create_map().cast(METRICS)).alias("metrics"),
                    F.coalesce(F.col("entities"), F.array().cast("array<string>")).alias("entities"),
                    F.lit("deterministic").alias("answer_source"))


def evidence_rows(answered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per question and piece of evidence; a question without evidence keeps one row of NULLs."""
    return answered.select(*keys, "intent", F.posexplode_outer("evidence").alias("evidence_no", "_e")) \
        .select(*keys, "intent", (F.col("evidence_no") + 1).alias("evidence_no"), "_e.*")


def metric_rows(answered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per question and metric of its answer; a question without metrics keeps one row."""
    return answered.select(*keys, "entities", "answer_source", F.explode_outer("metrics").alias("metric", "value"))
