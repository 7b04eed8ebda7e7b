"""Candidate stage, next action and journey (CASE chains on status columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_or_blank, norm
from .kpis import resolve

# FIXED VALUES: stage vocabularies of the candidate-operations view (narrower than the KPI sets)
STAGE_JOINED = ("joined", "joining confirmed")
STAGE_JOINING_OPEN = ("not joined", "pending", "not started")
STAGE_OFFER_ACCEPTED = ("accepted", "offer accepted")
STAGE_OFFER_DECLINED = ("declined", "rejected", "offer declined")
STAGE_INTERVIEW_SELECTED = ("selected", "interview selected", "passed", "selected for offer")
STAGE_INTERVIEW_REJECTED = ("rejected", "declined")
STAGE_NO_SHOW = ("no show", "no-show", "noshow")
STAGE_UNSCHEDULED = ("not scheduled", "pending")
STAGE_SCREEN_PASSED = ("selected", "screened", "passed", "screening selected")

PIPELINE_ORDER = ("Applied", "Screening", "Screening Selected", "Interview — Not Scheduled",
                  "Interview — No Show", "Interview", "Interview Selected", "Offer",
                  "Offer Accepted", "Joining", "Joined")
STAGE_PRIORITY = {"Joined": 7, "Joining": 6, "Offer Accepted": 5, "Offer Declined": 5, "Offer": 4,
                  "Interview Selected": 4, "Interview Rejected": 4, "Interview — No Show": 3,
                  "Interview — Not Scheduled": 3, "Interview": 3, "Screening Selected": 2,
                  "Screening": 1, "Applied": 0}
URGENT_ACTIONS = ("Schedule interview", "Follow up / reschedule", "Initiate offer process",
                  "Confirm joining date")
# end of fixed values


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def current_stage_sql(df: DataFrame, col: dict | None = None) -> str:
    """C1 as one SQL CASE (one JVM call to build): first matching rule wins."""
    from .kpis import sql_combined

    cm = resolve(df, col)
    j = sql_combined(cm.get("joining"), cm.get("joining_result"))
    off = sql_combined(cm.get("offer"), cm.get("offer_result"))
    iv = sql_combined(cm.get("interview"), cm.get("interview_result"))
    scr = sql_combined(cm.get("screening"), cm.get("screening_result"))
    passed = _sql_list(STAGE_SCREEN_PASSED)
    return (
        f"CASE WHEN {j} IN ({_sql_list(STAGE_JOINED)}) THEN 'Joined' "
        f"WHEN {j} <> '' AND NOT {j} IN ({_sql_list(STAGE_JOINING_OPEN)}) THEN 'Joining' "
        f"WHEN {off} IN ({_sql_list(STAGE_OFFER_ACCEPTED)}) THEN 'Offer Accepted' "
        f"WHEN {off} IN ({_sql_list(STAGE_OFFER_DECLINED)}) THEN 'Offer Declined' "
        f"WHEN {off} <> '' THEN 'Offer' "
        f"WHEN {iv} IN ({_sql_list(STAGE_INTERVIEW_SELECTED)}) THEN 'Interview Selected' "
        f"WHEN {iv} IN ({_sql_list(STAGE_INTERVIEW_REJECTED)}) THEN 'Interview Rejected' "
        f"WHEN {iv} IN ({_sql_list(STAGE_NO_SHOW)}) THEN 'Interview — No Show' "
        f"WHEN ({iv} IN ({_sql_list(STAGE_UNSCHEDULED)}) OR {iv} = '') AND {scr} IN ({passed}) "
        f"THEN 'Interview — Not Scheduled' "
        f"WHEN {iv} <> '' THEN 'Interview' "
        f"WHEN {scr} IN ({passed}) THEN 'Screening Selected' "
        f"WHEN {scr} <> '' THEN 'Screening' ELSE 'Applied' END")


def current_stage(df: DataFrame, col: dict | None = None) -> Column:
    """First matching rule wins (result beats status for each step)."""
    return F.expr(current_stage_sql(df, col))


def next_action_sql(df: DataFrame, stage: str, col: dict | None = None) -> str:
    """C2 as one SQL CASE over a stage column."""
    from .kpis import sql_norm

    cm = resolve(df, col)
    offer_blank = f"{sql_norm(cm.get('offer'))} = ''"
    join_date_blank = f"{sql_norm(cm.get('joining_date'))} = ''"
    return (
        f"CASE WHEN {stage} = 'Interview — Not Scheduled' THEN 'Schedule interview' "
        f"WHEN {stage} = 'Interview — No Show' THEN 'Follow up / reschedule' "
        f"WHEN {stage} = 'Interview Selected' AND {offer_blank} THEN 'Initiate offer process' "
        f"WHEN {stage} = 'Interview Selected' THEN 'Complete offer workflow' "
        f"WHEN {stage} = 'Offer Accepted' AND {join_date_blank} THEN 'Confirm joining date' "
        f"WHEN {stage} = 'Offer Accepted' THEN 'Track joining' "
        f"WHEN {stage} = 'Offer' THEN 'Await offer decision' ELSE 'No immediate action' END")


def next_action(df: DataFrame, stage: Column, col: dict | None = None) -> Column:
    """Next action from the stage, a blank offer status and a blank joining date."""
    cm = resolve(df, col)
    offer_blank = norm(col_or_blank(df.columns, cm.get("offer"))) == ""
    join_date_blank = norm(col_or_blank(df.columns, cm.get("joining_date"))) == ""
    return (
        F.when(stage == "Interview — Not Scheduled", "Schedule interview")
        .when(stage == "Interview — No Show", "Follow up / reschedule")
        .when((stage == "Interview Selected") & offer_blank, "Initiate offer process")
        .when(stage == "Interview Selected", "Complete offer workflow")
        .when((stage == "Offer Accepted") & join_date_blank, "Confirm joining date")
        .when(stage == "Offer Accepted", "Track joining")
        .when(stage == "Offer", "Await offer decision")
        .otherwise("No immediate action")
    )


def stage_priority(stage: Column) -> Column:
    """Ordinal 0-7 of a stage (unknown -> 0)."""
    m = F.create_map(*[x for k, v in STAGE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[stage], F.lit(0))


def stage_tone(stage: Column) -> Column:
    """Good / bad / warn / info."""
    return (F.when(stage == "Joined", "good")
            .when(stage.contains("Rejected") | stage.contains("Declined"), "bad")
            .when(stage.contains("No Show") | stage.contains("Not Scheduled") | (stage == "Offer"), "warn")
            .otherwise("info"))


def with_stage(df: DataFrame, col: dict | None = None) -> DataFrame:
    """Adds ``_current_stage`` and ``_action`` helper columns (two projections, SQL CASEs)."""
    staged = df.selectExpr("*", f"{current_stage_sql(df, col)} AS _current_stage")
    return staged.selectExpr("*", f"{next_action_sql(df, '_current_stage', col)} AS _action")


def stage_counts(df: DataFrame, col: dict | None = None) -> DataFrame:
    """Candidates per pipeline stage, zero-filled over the 11 ordered stages.

    One global aggregate (a ``count_if`` per listed stage, partial then final)
    expanded to 11 rows with ``inline`` — no stage table and no join.
    """
    staged = with_stage(df, col)
    row = staged.agg(*[F.expr(f"count_if(_current_stage = '{s}') AS c{i}") for i, s in enumerate(PIPELINE_ORDER)])
    structs = ", ".join(f"named_struct('stage_order', {i + 1}, 'stage', '{s}', 'candidates', CAST(c{i} AS BIGINT))"
                        for i, s in enumerate(PIPELINE_ORDER))
    return row.selectExpr(f"inline(array({structs}))")


def ops_counters(df: DataFrame, col: dict | None = None) -> DataFrame:
    """A10: candidates in view, urgent actions, joined, rejected/declined."""
    s = with_stage(df, col)
    return s.agg(
        F.count(F.lit(1)).alias("candidates_in_view"),
        F.count_if(F.col("_action").isin(*URGENT_ACTIONS)).alias("action_required"),
        F.count_if(F.col("_current_stage") == "Joined").alias("joined"),
        F.count_if(F.col("_current_stage").isin("Interview Rejected", "Offer Declined"))
        .alias("rejected_declined"),
    )


def journey(df: DataFrame, col: dict | None = None) -> DataFrame:
    """C4: six (stage, status) rows per candidate via one ``inline`` (no unions)."""
    cm = resolve(df, col)
    cols = df.columns

    def txt(key):
        return norm(col_or_blank(cols, cm.get(key)))

    def rec(c):
        return F.when(c != "", c).otherwise("Not recorded")

    iv_lower = F.lower(txt("interview"))
    steps = [
        ("Applied", F.when(txt("application_date") != "", "Recorded").otherwise("Not recorded")),
        ("Screening", rec(txt("screening"))),
        ("Interview", rec(txt("interview"))),
        ("Interview Selected", F.when(iv_lower.isin(*STAGE_INTERVIEW_SELECTED), "Selected").otherwise("—")),
        ("Offer", rec(txt("offer"))),
        ("Joined", rec(txt("joining"))),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("stage"), v.alias("status"))
                    for i, (n, v) in enumerate(steps)])
    idc = F.col(f"`{cm['id']}`") if cm.get("id") else F.lit(None).cast("string")
    return df.select(idc.alias("candidate_id"), F.inline(arr))
