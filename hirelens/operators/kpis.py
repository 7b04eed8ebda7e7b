"""Funnel KPIs: one aggregate for the whole table, per dimension, or per period.

Every KPI is a ``count_if``/``avg`` inside a single ``groupBy(keys).agg``, so the
physical plan is HashAggregate(partial) -> Exchange(keys) -> HashAggregate(final):
rows are combined map-side and only one small row per key and task crosses
the shuffle, whatever the skew of the key.  Rates are computed afterwards on
the aggregated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.dates import parse_date_col
from ..functions.text import NUMERIC_PATTERN, col_or_blank, combined_status, norm_lower, parse_number

COUNT_FIELDS = (
    "total", "screening_selected", "interview_selected", "interview_rejected",
    "interview_no_show", "interview_not_scheduled", "completed_status_only",
    "date_completed", "offers_accepted", "offers_declined", "joined",
)

KPI_COLUMNS = (
    "total", "screening_selected", "interviews_completed", "interview_selected",
    "interview_rejected", "interview_no_show", "interview_not_scheduled", "offers_accepted",
    "offers_declined", "offers_made", "joined", "screening_rate", "interview_selection_rate",
    "offer_acceptance_rate", "joining_rate", "avg_salary", "avg_time_to_hire",
)

GROUP_COLUMNS = (
    "applications", "screening_selected", "interviews", "interview_selected", "offers",
    "joined", "screening_rate_pct", "interview_selection_pct", "offer_acceptance_pct",
    "joining_rate_pct", "average_salary", "avg_time_to_hire",
)


def resolve(df: DataFrame, col: dict | None = None) -> dict[str, str | None]:
    """Column map for this frame; entries naming absent columns become None."""
    cm = dict(col) if col is not None else S.build_col_map(df.columns)
    return {k: (v if v in df.columns else None) for k, v in cm.items()}


def numeric_col(df: DataFrame, name: str | None) -> Column:
    """A numeric column as DOUBLE; text is parsed strictly; absent -> NULL."""
    if not name or name not in df.columns:
        return F.lit(None).cast("double")
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.NumericType):
        return c.cast("double")
    return parse_number(c)


def stage_outcomes(df: DataFrame, col: dict) -> dict[str, Column]:
    cols = df.columns
    return {
        "screening": combined_status(col_or_blank(cols, col.get("screening")),
                                     col_or_blank(cols, col.get("screening_result"))),
        "interview": combined_status(col_or_blank(cols, col.get("interview")),
                                     col_or_blank(cols, col.get("interview_result"))),
        "interview_status": norm_lower(col_or_blank(cols, col.get("interview"))),
        "offer": combined_status(col_or_blank(cols, col.get("offer")),
                                 col_or_blank(cols, col.get("offer_result"))),
        "joining": combined_status(col_or_blank(cols, col.get("joining")),
                                   col_or_blank(cols, col.get("joining_result"))),
    }


# SQL text for the hot KPI path: one expression string is one JVM call, whereas
# building the same tree from Column objects costs several calls per literal.
_WS_SQL = "' \\t\\n\\u000B\\u000C\\r'"  # the regex class \s as a btrim character set
_NUM_SQL = "'" + NUMERIC_PATTERN.replace("\\", "\\\\") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def sql_norm(name: str | None) -> str:
    """SQL twin of ``functions.text.norm`` for a column name (absent -> '')."""
    if not name:
        return "''"
    return f"coalesce(btrim(cast({_ident(name)} as string), {_WS_SQL}), '')"


def sql_combined(status: str | None, result: str | None) -> str:
    r, st = sql_norm(result), sql_norm(status)
    if not result:
        return f"lower({st})"
    return f"lower(CASE WHEN {r} <> '' THEN {r} ELSE {st} END)"


def sql_numeric(df: DataFrame, name: str | None) -> str:
    if not name or name not in df.columns:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(df.schema[name].dataType, T.NumericType):
        return f"CAST({_ident(name)} AS DOUBLE)"
    s = f"cast({_ident(name)} as string)"
    return f"CASE WHEN {s} RLIKE {_NUM_SQL} THEN try_cast(btrim({s}, {_WS_SQL}) AS DOUBLE) END"


def with_kpi_flags(df: DataFrame, col: dict) -> DataFrame:
    """Adds one boolean column per counted KPI plus numeric salary / time-to-hire.

    The trimmed, lower-cased stage outcomes are computed once in their own
    projection and the flags test membership on them, so each status column is
    normalised once per row (not once per flag, nor once per grouping set).
    """
    g = col.get
    staged = df.selectExpr(
        "*",
        f"{sql_combined(g('screening'), g('screening_result'))} AS _o_screening",
        f"{sql_combined(g('interview'), g('interview_result'))} AS _o_interview",
        f"lower({sql_norm(g('interview'))}) AS _o_interview_status",
        f"{sql_combined(g('offer'), g('offer_result'))} AS _o_offer",
        f"{sql_combined(g('joining'), g('joining_result'))} AS _o_joining",
        f"{sql_numeric(df, g('salary'))} AS _salary",
        f"{sql_numeric(df, g('time_to_hire'))} AS _tth",
    )
    flags = {
        "screening_selected": f"_o_screening IN ({_sql_list(S.SCREENING_SELECTED)})",
        "interview_selected": f"_o_interview IN ({_sql_list(S.INTERVIEW_SELECTED)})",
        "interview_rejected": f"_o_interview IN ({_sql_list(S.INTERVIEW_REJECTED)})",
        "interview_no_show": f"_o_interview IN ({_sql_list(S.INTERVIEW_NO_SHOW)})",
        "interview_not_scheduled": f"_o_interview_status IN ({_sql_list(S.INTERVIEW_NOT_SCHEDULED)})",
        "completed_status_only": (
            f"_o_interview_status IN ({_sql_list(S.INTERVIEW_COMPLETED_STATUS)}) AND NOT _o_interview IN "
            f"({_sql_list(S.INTERVIEW_SELECTED + S.INTERVIEW_REJECTED + S.INTERVIEW_NO_SHOW)})"),
        "offers_accepted": f"_o_offer IN ({_sql_list(S.OFFERS_ACCEPTED)})",
        "offers_declined": f"_o_offer IN ({_sql_list(S.OFFERS_DECLINED)})",
        "joined": f"_o_joining IN ({_sql_list(S.JOINED)})",
    }
    idate = g("interview_date")
    keep = [_ident(c) for c in df.columns] + ["_salary", "_tth"]
    exprs = [f"({e}) AS _f_{k}" for k, e in flags.items()]
    flagged = staged.selectExpr(*keep, *exprs)
    if idate:
        iv_sql = sql_combined(g("interview"), g("interview_result"))
        excluded = _sql_list(S.INTERVIEW_NO_SHOW + ("not scheduled", "pending"))
        return flagged.withColumn("_f_date_completed",
                                  parse_date_col(df, idate).isNotNull() & ~F.expr(f"{iv_sql} IN ({excluded})"))
    return flagged.selectExpr("*", "false AS _f_date_completed")


def flag_aggs() -> list[Column]:
    exprs = ["count(1) AS total"]
    exprs += [f"count_if(_f_{name}) AS {name}" for name in COUNT_FIELDS if name != "total"]
    exprs += ["avg(_salary) AS _avg_salary", "avg(_tth) AS _avg_tth"]
    return [F.expr(e) for e in exprs]


def kpi_counts(df: DataFrame, keys: list | None = None, col: dict | None = None,
               extra_aggs: list[Column] | None = None) -> DataFrame:
    """Raw counts (+ averages) per key; ``keys=[]`` gives one row for the whole frame."""
    col = resolve(df, col)
    flagged = with_kpi_flags(df, col)
    aggs = flag_aggs() + list(extra_aggs or [])
    if keys:
        return flagged.groupBy(*keys).agg(*aggs)
    return flagged.agg(*aggs)


def _pct2_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE round({num} / {den} * 100, 2) END"


def kpi_metrics(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The 17 KPI fields from ``kpi_counts`` output (keys first)."""
    keys = list(keys or [])
    extra = [_ident(x) for x in counts.columns if x.startswith("x_")]
    base = "(interview_selected + interview_rejected + completed_status_only)"
    c = counts.selectExpr(
        "*", f"CASE WHEN {base} = 0 THEN date_completed ELSE {base} END AS _ic",
        "offers_accepted + offers_declined AS _om")
    return c.selectExpr(
        *[_ident(x) for x in keys],
        "CAST(total AS BIGINT) AS total", "CAST(screening_selected AS BIGINT) AS screening_selected",
        "CAST(_ic AS BIGINT) AS interviews_completed", "CAST(interview_selected AS BIGINT) AS interview_selected",
        "CAST(interview_rejected AS BIGINT) AS interview_rejected",
        "CAST(interview_no_show AS BIGINT) AS interview_no_show",
        "CAST(interview_not_scheduled AS BIGINT) AS interview_not_scheduled",
        "CAST(offers_accepted AS BIGINT) AS offers_accepted", "CAST(offers_declined AS BIGINT) AS offers_declined",
        "CAST(_om AS BIGINT) AS offers_made", "CAST(joined AS BIGINT) AS joined",
        f"{_pct2_sql('screening_selected', 'total')} AS screening_rate",
        f"{_pct2_sql('interview_selected', '_ic')} AS interview_selection_rate",
        f"{_pct2_sql('offers_accepted', '_om')} AS offer_acceptance_rate",
        f"{_pct2_sql('joined', 'offers_accepted')} AS joining_rate",
        "round(_avg_salary, 2) AS avg_salary", "round(_avg_tth, 2) AS avg_time_to_hire",
        *extra,
    )


def compute_kpis(df: DataFrame, col: dict | None = None) -> DataFrame:
    """A1: one row with the 17 KPI fields."""
    return kpi_metrics(kpi_counts(df, [], col))


def group_frame(metrics: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rename KPI metrics to the per-group report layout."""
    extra = [_ident(x) for x in metrics.columns if x.startswith("x_")]
    return metrics.selectExpr(
        *[_ident(k) for k in key_cols],
        "total AS applications", "screening_selected", "interviews_completed AS interviews",
        "interview_selected", "offers_accepted AS offers", "joined",
        "screening_rate AS screening_rate_pct", "interview_selection_rate AS interview_selection_pct",
        "offer_acceptance_rate AS offer_acceptance_pct", "joining_rate AS joining_rate_pct",
        "avg_salary AS average_salary", "avg_time_to_hire", *extra,
    )


def empty_group_frame(df: DataFrame, group_col: str) -> DataFrame:
    spark = df.sparkSession
    schema = T.StructType(
        [T.StructField(group_col, T.StringType())]
        + [T.StructField(n, T.LongType()) for n in GROUP_COLUMNS[:6]]
        + [T.StructField(n, T.DoubleType()) for n in GROUP_COLUMNS[6:]])
    return spark.createDataFrame([], schema)


def group_kpis(df: DataFrame, group_col: str | None, col: dict | None = None,
               extra_aggs: list[Column] | None = None) -> DataFrame:
    """A3: KPIs per value of ``group_col``; the NULL group is kept."""
    if not group_col or group_col not in df.columns:
        return empty_group_frame(df, group_col or "group")
    counts = kpi_counts(df, [F.col(f"`{group_col}`")], col, extra_aggs)
    return group_frame(kpi_metrics(counts, [group_col]), [group_col])


def group_kpis_by_key(df: DataFrame, key: str, col: dict | None = None,
                      extra_aggs: list[Column] | None = None) -> DataFrame:
    """A3 addressed by analytics short key (recruiter, client, ...)."""
    cm = resolve(df, col)
    return group_kpis(df, cm.get(key), cm, extra_aggs)


DIMENSIONS = ("recruiter", "client", "role", "source", "technology")


def dimension_metrics(df: DataFrame, col: dict | None = None, dims: tuple[str, ...] = DIMENSIONS,
                      extra_aggs: list[Column] | None = None) -> DataFrame:
    """KPI metrics for several dimensions in ONE scan via GROUPING SETS (Expand + one exchange).

    Output: ``dimension`` (the column name), ``value`` (the key as text), the 17
    KPI fields and any ``x_*`` extra aggregates.  Only booleans and the two
    numeric columns are expanded — the stage outcomes are computed before Expand.
    """
    cm = resolve(df, col)
    present = [cm[d] for d in dims if cm.get(d)]
    if not present:
        return None
    keys = [F.col(f"`{c}`") for c in present]
    flagged = with_kpi_flags(df, cm)
    extra = list(extra_aggs or [])
    aggs = flag_aggs() + extra + [F.grouping_id(*keys).alias("_gid")]
    counts = flagged.groupingSets([[k] for k in keys], *keys).agg(*aggs)
    n = len(present)
    # grouping_id bit i (from the left) is 1 when column i is aggregated away
    dim_name = reduce(
        lambda acc, i: acc.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i), F.lit(present[i])),
        range(1, n), F.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1), F.lit(present[0])))
    value = reduce(
        lambda acc, i: acc.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i), F.col(f"`{present[i]}`")),
        range(1, n), F.when(F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1), F.col(f"`{present[0]}`")))
    labelled = counts.select(dim_name.alias("dimension"), value.cast("string").alias("value"),
                             *[c for c in counts.columns if c not in present and c != "_gid"])
    return kpi_metrics(labelled, ["dimension", "value"])


def kpis_all_dimensions(df: DataFrame, col: dict | None = None,
                        dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """A3 for several dimensions in ONE scan via GROUPING SETS."""
    m = dimension_metrics(df, col, dims)
    if m is None:
        return empty_group_frame(df, "value").withColumn("dimension", F.lit(None).cast("string"))
    return group_frame(m, ["dimension", "value"])


def metrics_for(dim_metrics: DataFrame, group_col: str) -> DataFrame:
    """One dimension's rows of ``dimension_metrics`` with the key under its own name."""
    return dim_metrics.filter(F.col("dimension") == group_col).drop("dimension") \
                      .withColumnRenamed("value", group_col)


def kpi_summary(kpis: DataFrame) -> DataFrame:
    """A2: the 12 management metrics as (metric, value) rows, in report order."""
    pairs = [
        ("Total Applications", "total"), ("Screening Selected", "screening_selected"),
        ("Interviews Completed", "interviews_completed"), ("Interview Selected", "interview_selected"),
        ("Offers Accepted", "offers_accepted"), ("Candidates Joined", "joined"),
        ("Screening Selection Rate (%)", "screening_rate"),
        ("Interview Selection Rate (%)", "interview_selection_rate"),
        ("Offer Acceptance Rate (%)", "offer_acceptance_rate"), ("Joining Rate (%)", "joining_rate"),
        ("Average Salary (LPA)", "avg_salary"), ("Average Time to Hire (Days)", "avg_time_to_hire"),
    ]
    entries = [F.struct(F.lit(i + 1).alias("metric_order"), F.lit(label).alias("metric"),
                        F.col(name).cast("double").alias("value"))
               for i, (label, name) in enumerate(pairs)]
    return kpis.select(F.inline(F.array(*entries)))


def funnel_stages(kpis: DataFrame) -> DataFrame:
    """Six ordered stages with candidate counts."""
    pairs = [("Applications", "total"), ("Screening Selected", "screening_selected"),
             ("Interviews Completed", "interviews_completed"), ("Interview Selected", "interview_selected"),
             ("Offers Accepted", "offers_accepted"), ("Joined", "joined")]
    entries = [F.struct(F.lit(i + 1).alias("stage_order"), F.lit(s).alias("stage"),
                        F.col(c).cast("long").alias("candidates")) for i, (s, c) in enumerate(pairs)]
    return kpis.select(F.inline(F.array(*entries)))


CONVERSIONS = (
    ("Applications → Screening", "screening_selected", "total"),
    ("Screening → Interviews", "interviews_completed", "screening_selected"),
    ("Interviews → Selected", "interview_selected", "interviews_completed"),
    ("Selected → Offers", "offers_accepted", "interview_selected"),
    ("Offers → Joined", "joined", "offers_accepted"),
)


def funnel_conversion(kpis: DataFrame) -> DataFrame:
    """Five step conversion rates (2 dp) with from/to counts."""
    structs = ", ".join(
        f"named_struct('step', {i + 1}, 'conversion', '{label}', 'rate_pct', {_pct2_sql(num, den)}, "
        f"'from_count', CAST({den} AS BIGINT), 'to_count', CAST({num} AS BIGINT))"
        for i, (label, num, den) in enumerate(CONVERSIONS))
    return kpis.selectExpr(f"inline(array({structs}))")


def kpi_stage_counts(kpis: DataFrame) -> DataFrame:
    """Seven KPI counters as (stage, candidates) rows."""
    pairs = [("Screening Selected", "screening_selected"),
             ("Interview Not Scheduled", "interview_not_scheduled"),
             ("Interview No Show", "interview_no_show"), ("Interview Rejected", "interview_rejected"),
             ("Interview Selected", "interview_selected"), ("Offer Accepted", "offers_accepted"),
             ("Joined", "joined")]
    entries = [F.struct(F.lit(i + 1).alias("stage_order"), F.lit(s).alias("stage"),
                        F.col(c).cast("long").alias("candidates")) for i, (s, c) in enumerate(pairs)]
    return kpis.select(F.inline(F.array(*entries)))


def bottleneck(kpis: DataFrame) -> DataFrame:
    """The weakest conversion step (first on ties)."""
    conv = funnel_conversion(kpis)
    return conv.orderBy(F.col("rate_pct").asc(), F.col("step").asc()).limit(1)
