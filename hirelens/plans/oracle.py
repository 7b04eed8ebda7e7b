"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement derives the application views from the driver tables itself
(``WITH applications AS (...)``) and then states the operator in plain SQL.
"""

from __future__ import annotations

from .. import schema as S
from ..sources import fixtures as FX
from . import params as P

APPLICATIONS_SQL = """
select concat('CAND', case when length(cast(o_orderkey as varchar)) < 7 then lpad(cast(o_orderkey as varchar), 7, '0')
                       else cast(o_orderkey as varchar) end) as candidate_id,
 c_name as candidate_name, cast(o_orderdate as date) as application_date,
 case when o_orderkey % 97 = 0 then null else o_orderpriority end as recruiter,
 c_mktsegment as client, concat('Role ', cast(o_custkey % 12 as varchar)) as role,
 concat('Tech ', cast(o_custkey % 8 as varchar)) as technology, n_name as location, r_name as source,
 case when h1 < 72 then 'Selected' else 'Rejected' end as screening_status,
 case when h1 >= 72 then 'Not Scheduled' when h2 >= 90 then ' No Show ' else 'Completed' end as interview_status,
 case when h1 >= 72 or h2 >= 90 then '' when h2 < 58 then 'Selected' else 'rejected' end as interview_result,
 case when h1 >= 72 or h2 >= 58 then 'Not Applicable' when h3 < 78 then 'Accepted' else 'Declined' end as offer_status,
 case when h1 >= 72 or h2 >= 58 or h3 >= 78 then 'Not Applicable' when h4 < 85 then 'Joined' else 'Candidate Dropped' end as joining_status,
 case when h1 < 72 and h2 < 58 and h3 < 78 then round(o_totalprice / 25000, 2) end as salary_lpa,
 case when h1 < 72 and h2 < 58 and h3 < 78 and h4 < 85 then cast(10 + o_orderkey % 50 as double) end as time_to_hire_days
from (select o.*,
        (o_orderkey * 7919     + o_custkey * 31) % 100       as h1,
        (o_orderkey * 104729   + o_custkey * 17) % 101 % 100 as h2,
        (o_orderkey * 1299709  + o_custkey * 13) % 103 % 100 as h3,
        (o_orderkey * 15485863 + o_custkey * 7)  % 107 % 100 as h4
      from orders o) o
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
"""

RAW_SQL = """
select candidate_id as "Candidate ID", candidate_name as "Full Name",
 case when k % 251 = 0 then 'not-a-date' else strftime(application_date, '%Y-%m-%d') end as "Applied On",
 case when k % 53 = 0 then '   ' else recruiter end as "TA Owner",
 client as "Client Name", role as "Job_Role", technology as "Tech", location as "City", source as "Channel",
 screening_status as "Screening Status", interview_status as "Interview Status",
 interview_result as "Interview Result", offer_status as "Offer Status", joining_status as "Joining Status",
 case when salary_lpa is null then null when k % 31 = 0 then 'n/a'
      else concat('₹', cast(salary_lpa as varchar), ' LPA') end as "CTC",
 cast(k % 5 as varchar) as "Notes", k
from (select *, cast(substr(candidate_id, 5) as bigint) as k from applications) a
"""


def with_apps(body: str, raw: bool = False, v2: bool = False) -> str:
    ctes = [f"applications as ({APPLICATIONS_SQL})"]
    if raw:
        ctes.append(f"raw_k as ({RAW_SQL})")
        ctes.append("applications_raw as (select * exclude (k) from raw_k "
                    "union all select * exclude (k) from raw_k where k % 199 = 0)")
    if v2:
        ctes.append(
            "applications_v2 as (select * replace ("
            "case when cast(substr(candidate_id, 5) as bigint) % 13 = 0 then 'Withdrawn' else offer_status end as offer_status, "
            "case when cast(substr(candidate_id, 5) as bigint) % 17 = 0 then null else recruiter end as recruiter"
            ") from applications)")
    return "with " + ",\n".join(ctes) + "\n" + body


def lit_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(c: str) -> str:
    return f"coalesce(regexp_replace(cast({c} as varchar), '^\\s+|\\s+$', '', 'g'), '')"


def comb(status: str, result: str | None) -> str:
    if result is None:
        return f"lower({norm(status)})"
    return f"lower(case when {norm(result)} <> '' then {norm(result)} else {norm(status)} end)"


def flags_select(src: str = "applications", has_screen_res=False, has_offer_res=False,
                 has_join_res=False, extra: str = "") -> str:
    """Per-row stage flags over the canonical columns (result columns absent unless flagged)."""
    scr = comb("screening_status", "screening_result" if has_screen_res else None)
    iv = comb("interview_status", "interview_result")
    ivs = f"lower({norm('interview_status')})"
    off = comb("offer_status", "offer_result" if has_offer_res else None)
    jn = comb("joining_status", "joining_result" if has_join_res else None)
    sel_rej_ns = lit_list(S.INTERVIEW_SELECTED + S.INTERVIEW_REJECTED + S.INTERVIEW_NO_SHOW)
    return f"""select *{extra},
      {scr} in ({lit_list(S.SCREENING_SELECTED)}) as f_scr,
      {iv} in ({lit_list(S.INTERVIEW_SELECTED)}) as f_isel,
      {iv} in ({lit_list(S.INTERVIEW_REJECTED)}) as f_irej,
      {iv} in ({lit_list(S.INTERVIEW_NO_SHOW)}) as f_ins,
      {ivs} in ({lit_list(S.INTERVIEW_NOT_SCHEDULED)}) as f_inot,
      ({ivs} in ({lit_list(S.INTERVIEW_COMPLETED_STATUS)}) and not ({iv} in ({sel_rej_ns}))) as f_cso,
      {off} in ({lit_list(S.OFFERS_ACCEPTED)}) as f_oacc,
      {off} in ({lit_list(S.OFFERS_DECLINED)}) as f_odec,
      {jn} in ({lit_list(S.JOINED)}) as f_join
    from {src}"""


def counts_cols(salary: str = "salary_lpa", tth: str = "time_to_hire_days") -> str:
    return f"""count(*) as n_total, count_if(f_scr) as n_scr, count_if(f_isel) as n_isel,
      count_if(f_irej) as n_irej, count_if(f_ins) as n_ins, count_if(f_inot) as n_inot,
      count_if(f_cso) as n_cso, count_if(f_oacc) as n_oacc, count_if(f_odec) as n_odec,
      count_if(f_join) as n_join, avg({salary}) as a_sal, avg({tth}) as a_tth"""


def pct(num: str, den: str) -> str:
    return f"round(case when ({den}) = 0 then 0.0 else ({num}) / ({den}) * 100 end, 2)"


def kpi_cols() -> str:
    """17 KPI fields from a counts row (n_* columns); interview-date fallback is absent here."""
    ic = "(n_isel + n_irej + n_cso)"
    return f"""cast(n_total as bigint) as total, cast(n_scr as bigint) as screening_selected,
      cast({ic} as bigint) as interviews_completed, cast(n_isel as bigint) as interview_selected,
      cast(n_irej as bigint) as interview_rejected, cast(n_ins as bigint) as interview_no_show,
      cast(n_inot as bigint) as interview_not_scheduled, cast(n_oacc as bigint) as offers_accepted,
      cast(n_odec as bigint) as offers_declined, cast(n_oacc + n_odec as bigint) as offers_made,
      cast(n_join as bigint) as joined,
      {pct('n_scr', 'n_total')} as screening_rate,
      {pct('n_isel', ic)} as interview_selection_rate,
      {pct('n_oacc', '(n_oacc + n_odec)')} as offer_acceptance_rate,
      {pct('n_join', 'n_oacc')} as joining_rate,
      round(a_sal, 2) as avg_salary, round(a_tth, 2) as avg_time_to_hire"""


def group_cols() -> str:
    ic = "(n_isel + n_irej + n_cso)"
    return f"""cast(n_total as bigint) as applications, cast(n_scr as bigint) as screening_selected,
      cast({ic} as bigint) as interviews, cast(n_isel as bigint) as interview_selected,
      cast(n_oacc as bigint) as offers, cast(n_join as bigint) as joined,
      {pct('n_scr', 'n_total')} as screening_rate_pct,
      {pct('n_isel', ic)} as interview_selection_pct,
      {pct('n_oacc', '(n_oacc + n_odec)')} as offer_acceptance_pct,
      {pct('n_join', 'n_oacc')} as joining_rate_pct,
      round(a_sal, 2) as average_salary, round(a_tth, 2) as avg_time_to_hire"""


def group_kpis_sql(dim: str, src: str = "applications") -> str:
    return with_apps(f"""
, fl as ({flags_select(src)})
, c as (select {dim}, {counts_cols()} from fl group by {dim})
select {dim}, {group_cols()} from c""")


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


for _dim in ("recruiter", "client", "role", "source", "technology"):
    register(f"kpis_by_{_dim}", group_kpis_sql(_dim))


# ---------------------------------------------------------------- shared CTE bodies

AS_OF = "DATE '2001-08-01'"
TH = (365, 1000, 1800)
FL_CTE = f", fl as ({flags_select()})"
KPI_CTE = FL_CTE + f", c as (select {counts_cols()} from fl), k as (select {kpi_cols()} from c)"


def _rows(src: str, items: list[tuple[str, ...]], cols: list[str]) -> str:
    parts = []
    for it in items:
        parts.append("select " + ", ".join(f"{v} as {c}" for v, c in zip(it, cols)) + f" from {src}")
    return "\nunion all\n".join(parts)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


register("kpis_total", with_apps(KPI_CTE + " select * from k"))

_SUMMARY = [("Total Applications", "total"), ("Screening Selected", "screening_selected"),
            ("Interviews Completed", "interviews_completed"), ("Interview Selected", "interview_selected"),
            ("Offers Accepted", "offers_accepted"), ("Candidates Joined", "joined"),
            ("Screening Selection Rate (%)", "screening_rate"),
            ("Interview Selection Rate (%)", "interview_selection_rate"),
            ("Offer Acceptance Rate (%)", "offer_acceptance_rate"), ("Joining Rate (%)", "joining_rate"),
            ("Average Salary (LPA)", "avg_salary"), ("Average Time to Hire (Days)", "avg_time_to_hire")]
register("kpi_summary", with_apps(KPI_CTE + "\n" + _rows(
    "k", [(str(i + 1), q(lbl), f"cast({c} as double)") for i, (lbl, c) in enumerate(_SUMMARY)],
    ["metric_order", "metric", "value"])))

_DIMS = ("recruiter", "client", "role", "source", "technology")
register("kpis_all_dims", with_apps(FL_CTE + "\n" + "\nunion all\n".join(
    f"select '{d}' as dimension, cast({d} as varchar) as value, {group_cols()} "
    f"from (select {d}, {counts_cols()} from fl group by {d})" for d in _DIMS)))

register("report_source", with_apps(FL_CTE + f""", c as (select source, {counts_cols()} from fl group by source)
select * rename (joining_rate_pct as conversion_rate_pct) from (select source, {group_cols()} from c)"""))
register("report_technology", group_kpis_sql("technology"))

_STAGES = [("Applications", "total"), ("Screening Selected", "screening_selected"),
           ("Interviews Completed", "interviews_completed"), ("Interview Selected", "interview_selected"),
           ("Offers Accepted", "offers_accepted"), ("Joined", "joined")]
register("funnel_stages", with_apps(KPI_CTE + "\n" + _rows(
    "k", [(str(i + 1), q(s), f"cast({c} as bigint)") for i, (s, c) in enumerate(_STAGES)],
    ["stage_order", "stage", "candidates"])))

_CONV = [("Applications → Screening", "screening_selected", "total"),
         ("Screening → Interviews", "interviews_completed", "screening_selected"),
         ("Interviews → Selected", "interview_selected", "interviews_completed"),
         ("Selected → Offers", "offers_accepted", "interview_selected"),
         ("Offers → Joined", "joined", "offers_accepted")]
_CONV_SQL = _rows("k", [(str(i + 1), q(lbl), pct(n, d), f"cast({d} as bigint)", f"cast({n} as bigint)")
                        for i, (lbl, n, d) in enumerate(_CONV)],
                  ["step", "conversion", "rate_pct", "from_count", "to_count"])
register("funnel_conversion", with_apps(KPI_CTE + "\n" + _CONV_SQL))
register("bottleneck", with_apps(KPI_CTE + f", fc as ({_CONV_SQL}) select * from fc order by rate_pct, step limit 1"))

_OPS = [("Screening Selected", "screening_selected"), ("Interview Not Scheduled", "interview_not_scheduled"),
        ("Interview No Show", "interview_no_show"), ("Interview Rejected", "interview_rejected"),
        ("Interview Selected", "interview_selected"), ("Offer Accepted", "offers_accepted"), ("Joined", "joined")]
register("kpi_stage_counts", with_apps(KPI_CTE + "\n" + _rows(
    "k", [(str(i + 1), q(s), f"cast({c} as bigint)") for i, (s, c) in enumerate(_OPS)],
    ["stage_order", "stage", "candidates"])))

# ---------------------------------------------------------------- filters and views

_FILTER_WHERE = "recruiter in ('1-URGENT', '2-HIGH') and client in ('BUILDING', 'MACHINERY')"
_SEARCH8 = ("candidate_id", "candidate_name", "recruiter", "client", "role", "technology", "location", "source")


def like_any(cols, text):
    pat = q(f"%{text.strip().lower()}%")
    return "(" + " or ".join(f"lower(cast({c} as varchar)) like {pat}" for c in cols) + ")"


register("filter_in", with_apps(f"select * from applications where {_FILTER_WHERE}"))
register("filter_all_selected", with_apps(
    "select count(*) as row_count from applications where client in ('BUILDING')"))
register("search_like", with_apps(f"select * from applications where {like_any(_SEARCH8, 'nation_1')}"))
register("query_filtered", with_apps(
    f"select candidate_id, candidate_name, recruiter, client, location from applications "
    f"where {_FILTER_WHERE} and {like_any(_SEARCH8, 'role 11')} order by candidate_id limit 250"))
register("count_rows", with_apps(
    f"select count(*) as row_count from applications where {_FILTER_WHERE} and "
    f"{like_any(('candidate_name', 'location', 'source'), 'nation_1')}"))
register("distinct_values", with_apps(
    "select value from (select regexp_replace(cast(v as varchar), '^\\s+|\\s+$', '', 'g') as value from "
    "(select distinct location as v from applications where location is not null order by v limit 500)) "
    "where value <> ''"))
_REGEX = "tech [37]|^role 1[01]$"
register("search_regex", with_apps(
    "select * from applications where " + " or ".join(
        f"regexp_matches(lower(coalesce(cast({c} as varchar), '')), {q(_REGEX)})"
        for c in ("candidate_id", "candidate_name", "recruiter", "client", "role", "technology", "location"))))
register("list_candidates", with_apps(
    "select * from applications where (" + " or ".join(
        f"{c} ilike '%Role 1%'" for c in ("candidate_id", "candidate_name", "role", "technology"))
    + ") and recruiter = '1-URGENT' order by application_date desc, candidate_id asc limit 500"))
register("candidate_lookup", with_apps("select * from applications where candidate_id = 'CAND0000001'"))
_PROFILE = ("candidate_id", "candidate_name", "application_date", "recruiter", "client", "role", "technology",
            "location", "source", "screening_status", "interview_status", "offer_status", "joining_status",
            "salary_lpa")
register("candidate_profile", with_apps(
    ", one as (select * from applications where candidate_id = 'CAND0000001')\n" + _rows(
        "one", [(str(i + 1), q(f), f"coalesce(cast({f} as varchar), '—')") for i, f in enumerate(_PROFILE)],
        ["field_order", "field", "value"])))
register("attention_queue", with_apps(
    "select candidate_id, candidate_name, recruiter, client, role, technology, interview_status "
    f"from applications where lower({norm('interview_status')}) in ('not scheduled', 'no show', 'pending', '') "
    "order by candidate_id limit 200"))
register("interview_ops", with_apps(
    "select candidate_id, candidate_name, recruiter, client, role, interview_status, source "
    "from applications order by candidate_id limit 300"))


def stage_sql() -> str:
    j = comb("joining_status", None)
    o = comb("offer_status", None)
    iv = comb("interview_status", "interview_result")
    s = comb("screening_status", None)
    passed = "('selected', 'screened', 'passed', 'screening selected')"
    return f"""case when {j} in ('joined', 'joining confirmed') then 'Joined'
      when {j} <> '' and {j} not in ('not joined', 'pending', 'not started') then 'Joining'
      when {o} in ('accepted', 'offer accepted') then 'Offer Accepted'
      when {o} in ('declined', 'rejected', 'offer declined') then 'Offer Declined'
      when {o} <> '' then 'Offer'
      when {iv} in ('selected', 'interview selected', 'passed', 'selected for offer') then 'Interview Selected'
      when {iv} in ('rejected', 'declined') then 'Interview Rejected'
      when {iv} in ('no show', 'no-show', 'noshow') then 'Interview — No Show'
      when ({iv} in ('not scheduled', 'pending') or {iv} = '') and {s} in {passed} then 'Interview — Not Scheduled'
      when {iv} <> '' then 'Interview'
      when {s} in {passed} then 'Screening Selected'
      when {s} <> '' then 'Screening'
      else 'Applied' end"""


def action_sql(stage: str = "current_stage") -> str:
    return f"""case when {stage} = 'Interview — Not Scheduled' then 'Schedule interview'
      when {stage} = 'Interview — No Show' then 'Follow up / reschedule'
      when {stage} = 'Interview Selected' and {norm('offer_status')} = '' then 'Initiate offer process'
      when {stage} = 'Interview Selected' then 'Complete offer workflow'
      when {stage} = 'Offer Accepted' then 'Confirm joining date'
      when {stage} = 'Offer' then 'Await offer decision'
      else 'No immediate action' end"""


STAGED = f", s0 as (select *, {stage_sql()} as current_stage from applications), " \
         f"staged as (select *, {action_sql()} as next_action from s0)"

register("stage_filter", with_apps(
    STAGED + " select * from staged where coalesce(client, '') in ('BUILDING', 'HOUSEHOLD') "
    "and current_stage in ('Joined', 'Offer Declined', 'Interview — No Show')"))
register("candidate_queue", with_apps(
    STAGED + " select candidate_id, candidate_name, recruiter, client, role, technology, location, "
    "interview_status, offer_status, joining_status, current_stage, next_action from staged "
    "order by candidate_id limit 500"))
register("export_view", with_apps("select * from applications"))
register("group_count", with_apps(
    "select recruiter as group_key, count(*) as count from applications "
    "where client in ('BUILDING', 'AUTOMOBILE') group by recruiter"))
register("interview_mix", with_apps(
    f"select case when {norm('interview_status')} = '' then 'Unknown' else {norm('interview_status')} end "
    "as interview_status, count(*) as candidates from applications group by 1"))


def low(c):
    return f"lower(coalesce(cast({c} as varchar), ''))"


register("status_only_counts", with_apps(f"""select count(*) as applications,
  cast(count_if({low('screening_status')} in ({lit_list(S.OPS_SCREENING)})) as bigint) as screening_selected,
  cast(count_if({low('interview_status')} in ({lit_list(S.OPS_INTERVIEW)})) as bigint) as interview_selected,
  cast(count_if({low('offer_status')} in ({lit_list(S.OPS_OFFER)})) as bigint) as offers_accepted,
  cast(count_if({low('joining_status')} in ({lit_list(S.OPS_JOINING)})) as bigint) as joined from applications"""))

# ---------------------------------------------------------------- stages

_PRIORITY = {"Joined": 7, "Joining": 6, "Offer Accepted": 5, "Offer Declined": 5, "Offer": 4,
             "Interview Selected": 4, "Interview Rejected": 4, "Interview — No Show": 3,
             "Interview — Not Scheduled": 3, "Interview": 3, "Screening Selected": 2, "Screening": 1,
             "Applied": 0}
_PRIO_SQL = "case current_stage " + " ".join(f"when {q(k)} then {v}" for k, v in _PRIORITY.items()) + " else 0 end"
_TONE_SQL = ("case when current_stage = 'Joined' then 'good' "
             "when contains(current_stage, 'Rejected') or contains(current_stage, 'Declined') then 'bad' "
             "when contains(current_stage, 'No Show') or contains(current_stage, 'Not Scheduled') "
             "or current_stage = 'Offer' then 'warn' else 'info' end")
register("current_stage", with_apps(
    STAGED + f" select candidate_id, current_stage, {_PRIO_SQL} as stage_priority, {_TONE_SQL} as stage_tone from staged"))
register("next_action", with_apps(STAGED + " select candidate_id, current_stage, next_action from staged"))


def rec(c):
    return f"case when {norm(c)} <> '' then {norm(c)} else 'Not recorded' end"


register("journey", with_apps("\n" + _rows("applications", [
    ("candidate_id", "1", "'Applied'",
     f"case when {norm('application_date')} <> '' then 'Recorded' else 'Not recorded' end"),
    ("candidate_id", "2", "'Screening'", rec("screening_status")),
    ("candidate_id", "3", "'Interview'", rec("interview_status")),
    ("candidate_id", "4", "'Interview Selected'",
     f"case when lower({norm('interview_status')}) in ('selected', 'interview selected', 'passed', "
     "'selected for offer') then 'Selected' else '—' end"),
    ("candidate_id", "5", "'Offer'", rec("offer_status")),
    ("candidate_id", "6", "'Joined'", rec("joining_status")),
], ["candidate_id", "step", "stage", "status"])))
register("combined_status", with_apps(
    f"select candidate_id, {comb('screening_status', None)} as screening_outcome, "
    f"{comb('interview_status', 'interview_result')} as interview_outcome, "
    f"{comb('offer_status', None)} as offer_outcome, {comb('joining_status', None)} as joining_outcome "
    "from applications"))
_ORDER = ("Applied", "Screening", "Screening Selected", "Interview — Not Scheduled", "Interview — No Show",
          "Interview", "Interview Selected", "Offer", "Offer Accepted", "Joining", "Joined")
register("stage_counts", with_apps(
    STAGED + ", dim as (select * from (values " + ", ".join(f"({i + 1}, {q(s)})" for i, s in enumerate(_ORDER))
    + ") t(stage_order, stage)), cnt as (select current_stage as stage, count(*) as n from staged group by 1) "
    "select stage_order, dim.stage, cast(coalesce(n, 0) as bigint) as candidates from dim "
    "left join cnt on dim.stage = cnt.stage"))
register("ops_counters", with_apps(
    STAGED + " select count(*) as candidates_in_view, cast(count_if(next_action in ('Schedule interview', "
    "'Follow up / reschedule', 'Initiate offer process', 'Confirm joining date')) as bigint) as action_required, "
    "cast(count_if(current_stage = 'Joined') as bigint) as joined, "
    "cast(count_if(current_stage in ('Interview Rejected', 'Offer Declined')) as bigint) as rejected_declined from staged"))

# ---------------------------------------------------------------- aging


def bucket_sql(days="aging_days", th=TH):
    return (f"case when {days} <= {th[0]} then 'HEALTHY' when {days} <= {th[1]} then 'WATCH' "
            f"when {days} <= {th[2]} then 'AGING' else 'CRITICAL' end")


AGED = (f", aged0 as (select *, cast(date_diff('day', application_date, {AS_OF}) as integer) as aging_days "
        "from applications where application_date is not null), "
        f"aged as (select *, {bucket_sql()} as aging_bucket from aged0)")
register("aging_summary", with_apps(AGED + " select * from aged"))
register("aging_buckets", with_apps(AGED + " select aging_bucket as bucket, count(*) as candidates from aged group by 1"))
register("aging_risk", with_apps(
    AGED + ", w as (select avg(case aging_bucket when 'HEALTHY' then 0 when 'WATCH' then 1 when 'AGING' then 2 "
    "when 'CRITICAL' then 3 else 0 end) as w from aged) "
    "select case when w is null then 100.0 else round(greatest(0.0, 100.0 - w * 25), 1) end as aging_risk_score from w"))
register("group_aging", with_apps(
    AGED + " select recruiter, count(*) as candidates, round(avg(aging_days), 1) as avg_aging_days, "
    "cast(count_if(aging_bucket = 'CRITICAL') as bigint) as critical, cast(count_if(aging_bucket = 'AGING') as bigint) as aging "
    "from aged where recruiter is not null group by recruiter"))

# ---------------------------------------------------------------- trends


def period_sql(freq: str, d: str = "application_date") -> str:
    if freq == "D":
        return f"strftime({d}, '%Y-%m-%d')"
    if freq == "W":
        return (f"strftime(date_trunc('week', {d}), '%Y-%m-%d') || '/' || "
                f"strftime(date_trunc('week', {d}) + interval 6 day, '%Y-%m-%d')")
    return f"strftime({d}, '%Y-%m')"


def trend_body(freq: str) -> str:
    ic = "(n_isel + n_irej + n_cso)"
    return (FL_CTE + f""", tc as (select {period_sql(freq)} as period, {counts_cols()} from fl
      where application_date is not null group by 1),
    trend as (select period, cast(n_total as bigint) as applications, cast(n_scr as bigint) as screening_selected,
      cast({ic} as bigint) as interviews_completed, cast(n_isel as bigint) as interview_selected,
      {pct('n_isel', ic)} as interview_selection_pct, cast(n_oacc as bigint) as offers_accepted,
      {pct('n_oacc', '(n_oacc + n_odec)')} as offer_acceptance_pct, cast(n_join as bigint) as joined,
      {pct('n_join', 'n_oacc')} as joining_rate_pct, round(a_tth, 2) as avg_time_to_hire from tc)""")


for _f, _n in (("M", "month"), ("W", "week"), ("D", "day")):
    register(f"trends_{_n}", with_apps(trend_body(_f) + " select * from trend"))

register("last_two_periods", with_apps(
    """, p as (select date_trunc('month', application_date) as p, count(*) as n from applications
         where application_date is not null group by 1),
       r as (select p, dense_rank() over (order by p desc) as r, count(*) over () as np, sum(n) over () as nrows from p)
    select a.*, case when r.r = 1 then 'current' else 'previous' end as period_role
    from applications a join r on date_trunc('month', a.application_date) = r.p
    where r.r <= 2 and r.np >= 2 and r.nrows >= 2"""))

_CMP = [("Applications", "applications"), ("Screening Selected", "screening_selected"),
        ("Interviews Completed", "interviews_completed"), ("Interview Selection %", "interview_selection_pct"),
        ("Offers Accepted", "offers_accepted"), ("Offer Acceptance %", "offer_acceptance_pct"),
        ("Joined", "joined"), ("Joining Rate %", "joining_rate_pct"), ("Avg Time to Hire", "avg_time_to_hire")]
RANKED = ", ranked as (select *, row_number() over (order by period desc) as rn, count(*) over () as np from trend)"
CMP_CTE = (trend_body("M") + RANKED + ", two as (select * from ranked where rn <= 2 and np >= 2), pairs as (\n"
           + "\nunion all\n".join(
               f"select {i + 1} as metric_order, {q(lbl)} as metric, "
               f"cast(max(case when rn = 1 then {c} end) as double) as current, "
               f"cast(max(case when rn = 2 then {c} end) as double) as previous from two having count(*) = 2"
               for i, (lbl, c) in enumerate(_CMP)) + ")"
           + """, cmp as (select metric_order, metric, current, previous, round(current - previous, 2) as absolute_change,
      case when previous < 1 then null else round((current - previous) / previous * 100, 2) end as percent_change,
      (previous > 0 or current > 0) as sufficient_data,
      case when previous = 0 and current > 0 then 'No prior-period baseline' else '' end as note
    from pairs where current is not null and previous is not null)""")
register("period_comparison", with_apps(CMP_CTE + " select * from cmp"))

FC_CTE = (trend_body("M") + RANKED + """, fa as (select count(*) as n, avg(case when rn <= 3 then joined end) as mean,
      stddev_samp(case when rn <= 3 then joined end) as sd0, count_if(rn <= 3) as kk from ranked),
    fb as (select *, case when kk > 1 then sd0 else mean * 0.1 end as sd from fa),
    fc as (select 'joins' as metric,
      case when n >= 3 then round(greatest(0.0, mean - sd), 1) else 0.0 end as estimate_low,
      case when n >= 3 then round(mean + sd, 1) else 0.0 end as estimate_high,
      case when n >= 3 then round(mean, 1) else 0.0 end as estimate_mid,
      n >= 3 as sufficient_data,
      case when n >= 3 then 'Based on recent monthly join average (ESTIMATE).'
           else 'Insufficient historical data for reliable forecasting.' end as message,
      cast(n as integer) as historical_periods from fb)""")
register("forecast_joins", with_apps(FC_CTE + " select * from fc"))


def gap_select(t: str, src: str) -> str:
    ok = "(fc.sufficient_data and jr > 0)"
    return f"""select cast({t} as bigint) as target_hires, 'next period' as period_label,
      case when {ok} then estimate_low else 0.0 end as expected_low,
      case when {ok} then estimate_high else 0.0 end as expected_high,
      case when {ok} then estimate_mid else 0.0 end as expected_mid,
      case when {ok} then round(greatest(0.0, {t} - estimate_high), 1) else cast({t} as double) end as gap_low,
      case when {ok} then round(greatest(0.0, {t} - estimate_low), 1) else cast({t} as double) end as gap_high,
      case when {ok} then round(greatest(0.0, {t} - estimate_high) / greatest(jr, 0.001), 0) else 0.0 end as pipeline_required_low,
      case when {ok} then round(greatest(0.0, {t} - estimate_low) / greatest(jr, 0.001), 0) else 0.0 end as pipeline_required_high,
      {ok} as sufficient_data,
      case when {ok} then 'ESTIMATE based on recent join velocity and historical conversion.' else fc.message end as message,
      'ESTIMATE' as label from {src}"""


JR_CTE = (", c2 as (select " + counts_cols() + " from fl), "
          "jr as (select case when n_total > 0 then n_join / n_total else 0.0 end as jr from c2)")
register("target_gap", with_apps(FC_CTE + JR_CTE + " " + gap_select("500", "fc cross join jr")))

# ---------------------------------------------------------------- scorecards


def rdec(x: str, d: int) -> str:
    return f"cast(round(cast({x} as decimal(38,12)), {d}) as double)"


def fmt1(x: str) -> str:
    return f"cast({rdec(x, 1)} as varchar)"


def velocity(t: str) -> str:
    return f"case when {t} is not null and {t} > 0 then greatest(0.2, least(1.0, 45.0 / {t})) else 1.0 end"


_EFF_RAW = ("(least(screening_rate / 100, 1.0) * 0.2 "
            "+ (case when interviews_completed > 0 then least(interview_selection_rate / 100, 1.0) else 0.5 end) * 0.25 "
            "+ (case when offers_made > 0 then least(offer_acceptance_rate / 100, 1.0) else 0.5 end) * 0.2 "
            "+ (case when offers_accepted > 0 then least(joining_rate / 100, 1.0) else 0.5 end) * 0.25 "
            f"+ ({velocity('avg_time_to_hire')}) * 0.1) * 100")
EFF = f"case when total = 0 then 0.0 else {rdec(_EFF_RAW, 1)} end"


def group_from_metrics(dim: str) -> str:
    return (f"{dim}, total as applications, screening_selected, interviews_completed as interviews, "
            "interview_selected, offers_accepted as offers, joined, screening_rate as screening_rate_pct, "
            "interview_selection_rate as interview_selection_pct, offer_acceptance_rate as offer_acceptance_pct, "
            "joining_rate as joining_rate_pct, avg_salary as average_salary, avg_time_to_hire")


def grouped_metrics(dim: str, aging: bool) -> str:
    extra = (f", avg(date_diff('day', application_date, {AS_OF})) as x_aging") if aging else ""
    ag = f", case when {dim} is null then null else x_aging end as avg_aging_days" if aging else ""
    return (FL_CTE + f", gc as (select {dim}, {counts_cols()}{extra} from fl group by {dim}), "
            f"gm as (select {dim}, {kpi_cols()}{', x_aging' if aging else ''} from gc), "
            f"gme as (select *, {EFF} as efficiency_score from gm), "
            f"cards as (select {group_from_metrics(dim)}, efficiency_score{ag} from gme)")


register("recruiter_scorecards", with_apps(
    grouped_metrics("recruiter", False).replace(", efficiency_score from gme)", ", efficiency_score from gme)")
    + " select c.* , round(efficiency_score - (select median(efficiency_score) from cards), 1) as vs_team_median from cards c"))

_RI = (grouped_metrics("recruiter", True)
       + ", ri as (select c.*, round(efficiency_score - (select median(efficiency_score) from cards), 1) as vs_team_median, "
       "case when applications > 0 then round(interviews / applications * 100, 2) end as interview_completion_rate from cards c)")
register("recruiter_intelligence", with_apps(_RI + " select * from ri"))


def no_eff(dim):
    return grouped_metrics(dim, True).replace(", efficiency_score,", ",").replace(
        ", efficiency_score from gme", " from gme")


_CH = rdec(f"greatest(0.0, least(100.0, (least(joining_rate_pct / 100, 1.0) * 0.35 + "
       f"least(offer_acceptance_pct / 100, 1.0) * 0.25 + least(interview_selection_pct / 100, 1.0) * 0.2 + "
       f"({velocity('avg_time_to_hire')}) * 0.2 - coalesce(least(0.3, avg_aging_days / 100), 0.0)) * 100))", 1)
register("client_intelligence", with_apps(no_eff("client") + f" select *, {_CH} as client_health_score from cards"))

_DIFF = [("interview_selection_pct < 50", 25, "low interview selection"),
         ("offer_acceptance_pct < 70", 20, "low offer acceptance"),
         ("joining_rate_pct < 80", 20, "low joining rate"),
         ("avg_time_to_hire > 40", 15, "long time-to-hire"),
         ("avg_aging_days > 21", 20, "pipeline aging")]
_PTS = " + ".join(f"(case when coalesce({c}, false) then {p} else 0 end)" for c, p, _ in _DIFF) \
    + " + (case when applications < 5 then 10 else 0 end)"
_WHY = "concat_ws('; ', " + ", ".join(f"case when coalesce({c}, false) then {q(w)} end" for c, _, w in _DIFF) + ")"
register("role_intelligence", with_apps(
    no_eff("role") + f", rd as (select *, cast(least(100, {_PTS}) as double) as hiring_difficulty_score, "
    f"{_WHY} as _why from cards) select * exclude (_why), case when _why = '' then 'within normal range' "
    "else _why end as difficulty_reasons from rd"))
register("source_intelligence", with_apps(
    grouped_metrics("source", False).replace(", efficiency_score from gme", " from gme")
    + " select *, joining_rate_pct as application_to_join_pct, "
    + rdec("joining_rate_pct * 0.5 + interview_selection_pct * 0.3 + offer_acceptance_pct * 0.2", 2)
    + " as quality_score from cards"))


def pick(src, key, col, highest=True):
    d = "desc" if highest else "asc"
    return f"(select cast({key} as varchar) from {src} order by {col} {d}, coalesce(cast({key} as varchar), '') {d} limit 1)"


register("recruiter_highlights", with_apps(
    _RI + f""", hl as (
    select 'top_performer' as highlight, {pick('ri', 'recruiter', 'efficiency_score')} as entity,
           'Efficiency ' || {fmt1('(select max(efficiency_score) from ri)')} as detail
    union all select 'underperformer', {pick('ri', 'recruiter', 'efficiency_score', False)},
           'Efficiency ' || {fmt1('(select min(efficiency_score) from ri)')}
    union all select 'high_volume', {pick('ri', 'recruiter', 'applications')},
           cast((select max(applications) from ri) as varchar) || ' applications'
    union all select 'best_conversion', {pick('ri', 'recruiter', 'joining_rate_pct')},
           'Join rate ' || {fmt1('(select max(joining_rate_pct) from ri)')} || '%')
    select * from hl"""))
register("best_source", with_apps(
    grouped_metrics("source", False).replace(", efficiency_score from gme", " from gme")
    + ", si as (select *, "
    + rdec("joining_rate_pct * 0.5 + interview_selection_pct * 0.3 + offer_acceptance_pct * 0.2", 2)
    + " as quality_score from cards) "
    f"select {pick('si', 'source', 'quality_score')} as source, max(quality_score) as quality_score from si"))


# ---------------------------------------------------------------- ingest (normalised upload)

NUM_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def edge(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"(case when regexp_matches({x}, '^\\s*$') then null else {x} end)"


def parse_num(x: str) -> str:
    return f"(case when regexp_matches(cast({x} as varchar), '{NUM_RE}') then try_cast({edge(f'cast({x} as varchar)')} as double) end)"


def currency(x: str) -> str:
    s = f"regexp_replace(regexp_replace(coalesce(cast({x} as varchar), ''), 'lpa', '', 'gi'), '[^\\d.\\-]', '', 'g')"
    return parse_num(s)


def iso_date(x: str) -> str:
    return f"try_strptime({edge(x)}, '%Y-%m-%d')"


def date_text(x: str) -> str:
    return f"coalesce(strftime({iso_date(x)}, '%Y-%m-%d'), {x})"


_RAW_MAP = [("Candidate ID", "candidate_id"), ("Full Name", "candidate_name"), ("Applied On", "application_date"),
            ("TA Owner", "recruiter"), ("Client Name", "client"), ("Job_Role", "role"), ("Tech", "technology"),
            ("City", "location"), ("Channel", "source"), ("Screening Status", "screening_status"),
            ("Interview Status", "interview_status"), ("Interview Result", "interview_result"),
            ("Offer Status", "offer_status"), ("Joining Status", "joining_status"), ("CTC", "salary_lpa")]


def _norm_col(raw_name: str, canon: str) -> str:
    b = blank(f'"{raw_name}"')
    if canon == "application_date":
        return f"{date_text(b)} as {canon}"
    if canon == "salary_lpa":
        return f"{currency(b)} as {canon}"
    return f"{b} as {canon}"


NORM = (", norm as (select " + ", ".join(_norm_col(r, c) for r, c in _RAW_MAP)
        + f", {blank(chr(34) + 'Notes' + chr(34))} as \"Notes\" from applications_raw)")
NORM_COLS = [c for _, c in _RAW_MAP] + ['"Notes"']

register("normalize_all", with_apps(NORM + " select * from norm", raw=True))
register("parquet_roundtrip", with_apps(NORM + " select * from norm", raw=True))
# empty fields and the word n/a read back as NULL
register("csv_flexible", with_apps(" select " + ", ".join(
    f'case when "{r}" not in (\'\', \'n/a\') then "{r}" end as "{r}"' for r in [r for r, _ in _RAW_MAP] + ["Notes"]) + " from applications_raw",
    raw=True))
register("drop_blank_rows", with_apps(
    " select * from applications_raw where coalesce(" + ", ".join(f'"{r}"' for r, _ in _RAW_MAP) + ', "Notes") is not null',
    raw=True))
register("clean_currency", with_apps(
    f' select "Candidate ID" as candidate_id, "CTC" as raw_value, {currency(chr(34) + "CTC" + chr(34))} as salary_lpa '
    "from applications_raw", raw=True))
register("normalize_dates", with_apps(
    f' select "Candidate ID" as candidate_id, "Applied On" as raw_value, '
    f'{date_text(chr(34) + "Applied On" + chr(34))} as application_date from applications_raw', raw=True))
register("blank_to_null", with_apps(
    f' select "Candidate ID" as candidate_id, {blank(chr(34) + "TA Owner" + chr(34))} as recruiter from applications_raw',
    raw=True))
_BATCH = [(r, r.strip().lower().replace(" ", "_")) for r, _ in _RAW_MAP] + [("Notes", "notes")]
register("clean_batch", with_apps(
    " select " + ", ".join(f'{edge(chr(34) + r + chr(34))} as {n}' for r, n in _BATCH)
    + " from (select distinct * from applications_raw)", raw=True))

# ---------------------------------------------------------------- data quality

register("duplicate_rows", with_apps(
    NORM + " select cast((select count(*) from norm) - (select count(*) from (select distinct * from norm)) as bigint)"
    " as duplicate_rows", raw=True))
register("id_quality", with_apps(
    NORM + " select cast(count_if(candidate_id is null) as bigint) as missing_ids, "
    "cast(count(candidate_id) - count(distinct candidate_id) as bigint) as duplicate_ids from norm", raw=True))
register("invalid_dates", with_apps(
    NORM + f", b as (select cast(count(application_date) - count({iso_date('application_date')}) as bigint) as n from norm) "
    "select 'application_date' as field, n as invalid from b where n > 0", raw=True))
register("invalid_numeric", with_apps(
    f' , b as (select cast(count({blank(chr(34) + "CTC" + chr(34))}) - count({currency(chr(34) + "CTC" + chr(34))}) as bigint) as n from applications_raw) '
    "select 'salary_lpa' as field, n as invalid from b where n > 0", raw=True))
register("missing_by_field", with_apps(
    NORM + ", m as (select " + ", ".join(f"cast(count_if({c} is null) as bigint) as m{i}" for i, c in enumerate(NORM_COLS))
    + " from norm) " + " union all ".join(
        f"select {q(c.strip(chr(34)))} as field, m{i} as missing from m where m{i} > 0" for i, c in enumerate(NORM_COLS)),
    raw=True))
_REPORT_FIELDS = ["candidate_id", "candidate_name", "application_date", "recruiter", "client", "role", "technology",
                  "location", "source", "screening_status", "interview_status", "interview_result", "offer_status",
                  "joining_status", "salary_lpa"]
register("missing_report", with_apps(
    NORM + ", m as (select count(*) as r, " + ", ".join(f"count_if({c} is null) as m{i}" for i, c in enumerate(_REPORT_FIELDS))
    + " from norm) " + " union all ".join(
        f"select {q(c)} as field, cast(m{i} as bigint) as missing, {pct(f'm{i}', 'r')} as missing_pct from m"
        for i, c in enumerate(_REPORT_FIELDS)), raw=True))

STATS = (NORM + ", st as (select count(*) as row_count, count_if(candidate_id is null) as miss_cid, "
         "count_if(interview_status is null) as miss_iv, count_if(offer_status is null) as miss_off, "
         f"count(application_date) - count({iso_date('application_date')}) as bad_date, "
         f"(select count({blank(chr(34) + 'CTC' + chr(34))}) - count({currency(chr(34) + 'CTC' + chr(34))}) from applications_raw) as bad_num, "
         "count(candidate_id) - count(distinct candidate_id) as dup_ids, "
         "(select count(*) from norm) - (select count(*) from (select distinct * from norm)) as dup_rows from norm)")


def _share(x):
    return f"{x} / greatest(row_count, 1) * 100"


_PENALTY = (f"least(25.0, {_share('dup_rows')} * 0.5) + least(10.0, {_share('miss_cid')} * 0.3) + "
            f"least(10.0, {_share('miss_iv')} * 0.3) + least(10.0, {_share('miss_off')} * 0.3) + "
            f"least(8.0, {_share('bad_date')} * 0.4) + least(5.0, {_share('bad_num')} * 0.3)")
register("health_score_data", with_apps(
    STATS + f" select greatest(0.0, {rdec(f'100.0 - ({_PENALTY}) - 2.0', 1)}) as health_score, "
    "cast(row_count as bigint) as row_count, cast(16 as bigint) as column_count, cast(dup_rows as bigint) as duplicate_rows, "
    "list_filter([case when dup_rows > 0 then format('{:,}', dup_rows) || ' duplicate rows' end, "
    "case when bad_date > 0 then cast(bad_date as varchar) || ' invalid Application Date' end, "
    "'1 unmapped columns'], lambda x: x is not null) as issues from st", raw=True))
register("validation_report", with_apps(
    STATS + " select true as valid, cast([] as varchar[]) as errors, list_filter(["
    "case when dup_rows > 0 then format('{:,}', dup_rows) || ' duplicate row(s) detected.' end, "
    "'1 column(s) were not mapped automatically: Notes', "
    "case when miss_cid > 0 then format('{:,}', miss_cid) || ' record(s) have a missing Candidate ID.' end, "
    "case when dup_ids > 0 then format('{:,}', dup_ids) || ' duplicate Candidate ID value(s) detected.' end, "
    "case when bad_date > 0 then format('{:,}', bad_date) || ' invalid application date value(s) detected.' end, "
    "case when bad_num > 0 then format('{:,}', bad_num) || ' salary value(s) could not be interpreted as numbers.' end"
    "], lambda x: x is not null) as warnings, cast(row_count as bigint) as rows, cast(16 as bigint) as columns, "
    "[" + ", ".join(q(c) for c in _REPORT_FIELDS) + "] as recognized_fields, "
    "[" + ", ".join(q(f"{r} -> {c}") for r, c in _RAW_MAP) + "] as mapping, "
    "['Notes'] as unmapped_columns, cast([] as varchar[]) as low_confidence_columns, "
    "cast(dup_rows as bigint) as duplicate_rows, cast(15 as bigint) as mapped_count, cast(1 as bigint) as unmapped_count "
    "from st", raw=True))

_APP_COLS = ["candidate_id", "candidate_name", "application_date", "recruiter", "client", "role", "technology",
             "location", "source", "screening_status", "interview_status", "interview_result", "offer_status",
             "joining_status", "salary_lpa", "time_to_hire_days"]
register("fingerprint_table", with_apps(
    " , h as (select sha256(concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '')" for c in _APP_COLS)
    + ")) as h from applications), s as (select count(*) as row_count, "
    + ", ".join(f"cast(sum(('0x' || substr(h, {1 + 16 * k}, 16))::hugeint) as decimal(38,0)) as sum_{k + 1}" for k in range(4))
    + " from h) select *, sha256(concat_ws('|', row_count, sum_1, sum_2, sum_3, sum_4)) as fingerprint from s"))
register("fingerprint_pages",
         "select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as size_bytes, sha256(coalesce(html, '') || concat_ws('|', "
         "coalesce(url, ''), octet_length(encode(coalesce(html, ''))), page_id)) as fingerprint from pages")

# ---------------------------------------------------------------- change capture

_AUDIT = ["candidate_name", "application_date", "recruiter", "client", "role", "technology", "location", "source",
          "screening_status", "interview_status", "offer_status", "joining_status", "salary_lpa", "time_to_hire_days"]
_TXT = ", ".join(f"coalesce(cast({c} as varchar), '') as t{i}" for i, c in enumerate(_AUDIT))
_FIRST = ("(select * from (select candidate_id, " + _TXT + ", row_number() over (partition by candidate_id order by "
          + ", ".join(f"t{i}" for i in range(len(_AUDIT))) + ") as rn from {src}) where rn = 1)")
AUDIT_CTE = (", j as (select a.candidate_id, " + ", ".join(
    f"a.t{i} as o{i}, b.t{i} as n{i}" for i in range(len(_AUDIT)))
    + " from " + _FIRST.format(src="applications") + " a join " + _FIRST.format(src="applications_v2")
    + " b using (candidate_id)), audit as ("
    + " union all ".join(f"select candidate_id, {i + 1} as field_order, 'UPDATE {c}' as action, o{i} as old_value, "
                         f"n{i} as new_value, 'recruiter' as changed_by from j where o{i} <> n{i}"
                         for i, c in enumerate(_AUDIT)) + ")")
register("change_audit", with_apps(AUDIT_CTE + " select * from audit", v2=True))
register("audit_history", with_apps(AUDIT_CTE + " select * from audit where candidate_id = 'CAND0000013'", v2=True))
register("append_validated", with_apps(
    NORM + f", ok as (select distinct * replace ({edge('candidate_id')} as candidate_id) from norm where "
    + " and ".join(f"coalesce({edge(c)}, '') <> ''" for c in ("candidate_id", "candidate_name", "role"))
    + ") select *, 'CREATE' as action, cast(null as varchar) as old_value, 'Candidate created' as new_value, "
    "'recruiter' as changed_by from ok where candidate_id not in "
    "(select candidate_id from applications where application_date < DATE '1998-01-01')", raw=True))
register("import_if_new", with_apps(
    NORM + ", inc as (select distinct " + ", ".join(_APP_COLS[:-1]) + ", cast(null as varchar) as time_to_hire_days "
    "from norm) select * from inc where candidate_id not in "
    "(select candidate_id from applications where application_date < DATE '1998-01-01')", raw=True))

# ---------------------------------------------------------------- questions


def tag_sql(src: str) -> str:
    qx = f"lower({edge('question')})"
    return f"""({src}), tq as (select *, {qx} as _q from qs),
    ti as (select *, case when coalesce(_q, '') = '' then 'unknown'
      when regexp_matches(_q, 'stuck|aging|days') and regexp_matches(_q, '\\d+') then 'aging_query'
      when contains(_q, 'stuck') or contains(_q, 'aging') then 'aging_query'
      when contains(_q, 'declin') and (contains(_q, 'hire') or contains(_q, 'join')) then 'declining_hires'
      when contains(_q, 'bottleneck') or contains(_q, 'funnel') then 'bottleneck'
      when contains(_q, 'recruiter') then 'recruiter_ranking'
      when contains(_q, 'client') then 'client_ranking'
      when contains(_q, 'source') then 'source_ranking'
      when contains(_q, 'role') or contains(_q, 'hard to hire') then 'role_ranking'
      when regexp_matches(_q, '\\d+\\s*hire') or contains(_q, 'target') then 'forecast_target'
      else 'unknown' end as intent,
      try_cast(nullif(regexp_extract(_q, '(\\d+)', 1), '') as bigint) as _n from tq),
    tagged as (select * exclude (_q, _n),
      case when intent = 'recruiter_ranking' then (case when contains(_q, 'underperform') or contains(_q, 'worst')
             or contains(_q, 'low') then 'worst' else 'best' end)
           when intent = 'client_ranking' then (case when contains(_q, 'worst') or contains(_q, 'hard') then 'worst' else 'best' end)
           when intent = 'source_ranking' then (case when contains(_q, 'best') or contains(_q, 'quality') then 'best' else 'volume' end)
           when intent = 'role_ranking' then 'hard' end as ranking,
      case when intent = 'aging_query' then (case when regexp_matches(_q, 'stuck|aging|days') and regexp_matches(_q, '\\d+')
           then _n else 14 end) end as aging_days,
      case when intent = 'forecast_target' then coalesce(_n, 100) end as target_hires from ti)"""


QS_SRC = "select conv_id, turn, text as question from conversations where role = 'user'"
register("intent_tags", "with qs as " + tag_sql(QS_SRC) + " select * from tagged")
register("stuck_over_n", with_apps(
    AGED + ", t(threshold) as (values (14), (1500), (2000), (2400)) "
    "select cast(threshold as bigint) as threshold, cast(count(aged.aging_days) as bigint) as stuck_count "
    "from t left join aged on aged.aging_days > t.threshold group by threshold"))


# ---------------------------------------------------------------- insights and executive view


def fint(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def top1(src: str, fields: str, order: str, key: str) -> str:
    return f"(select {fields} from {src} order by {order}, coalesce(cast({key} as varchar), '') limit 1)"


_REC_CARDS = grouped_metrics("recruiter", False)
_SRC = ", sc as (select source, " + group_cols() + " from (select source, " + counts_cols() + " from fl group by source))"
FACTS = (KPI_CTE + _REC_CARDS.replace(FL_CTE, "", 1) + _SRC + f""", fx as (select k.*,
    (select count(*) from cards) as r_n, (select median(efficiency_score) from cards) as r_median,
    {top1('cards', "struct_pack(entity := cast(recruiter as varchar), score := efficiency_score, joined := joined, apps := applications)", 'efficiency_score asc', 'recruiter').replace("'') limit", "'') asc limit")} as r_bottom,
    {top1('cards', "struct_pack(entity := cast(recruiter as varchar), score := efficiency_score)", 'efficiency_score desc', 'recruiter').replace("'') limit", "'') desc limit")} as r_top,
    (select count(*) from sc) as s_n,
    {top1('sc', "struct_pack(entity := cast(source as varchar), rate := joining_rate_pct, joined := joined, apps := applications)", 'joining_rate_pct desc', 'source').replace("'') limit", "'') desc limit")} as s_best,
    {top1('sc', "struct_pack(entity := cast(source as varchar), rate := joining_rate_pct, apps := applications)", 'applications desc', 'source').replace("'') limit", "'') desc limit")} as s_vol
  from k)""")

_NS = pct("interview_no_show", "(interviews_completed + interview_no_show)")


def ins_row(no, title, itype, sev, metric, current, comparison="null", change="null", entity="null",
            reason="", action="", evidence=(), cond="true"):
    ev = "[" + ", ".join(evidence) + "]" if evidence else "cast([] as varchar[])"
    return (f"select {no} as rule_no, {q(title)} as insight_type_title_placeholder" if False else
            f"select {no} as rule_no, {q(title)} as title, {q(itype)} as insight_type, {sev} as severity, "
            f"{q(metric)} as metric, cast({current} as varchar) as current_value, "
            f"cast({comparison} as varchar) as comparison_value, cast({change} as double) as change, "
            f"cast({entity} as varchar) as entity, {q(reason)} as reason, {q(action)} as recommended_action, "
            f"cast({ev} as varchar[]) as evidence from fx where {cond}")


_RULES = [
    ins_row(1, "Interview scheduling backlog", "BOTTLENECK",
            "case when interview_not_scheduled > 50 then 'HIGH' else 'MEDIUM' end", "interview_not_scheduled",
            "interview_not_scheduled", reason="Candidates awaiting interview scheduling block funnel velocity.",
            action="Assign scheduling owners and clear the interview queue within 48 hours.",
            evidence=[f"{fint('interview_not_scheduled')} || ' candidates not scheduled'"],
            cond="interview_not_scheduled > 0"),
    ins_row(2, "Interview no-show risk", "RISK", f"case when {_NS.replace('round(', '(', 1).rsplit(', 2)', 1)[0]}) > 10 then 'HIGH' else 'MEDIUM' end",
            "interview_no_show_rate", rdec(f"case when (interviews_completed + interview_no_show) = 0 then 0.0 else interview_no_show / (interviews_completed + interview_no_show) * 100 end", 1),
            "10.0", "case when (interviews_completed + interview_no_show) = 0 then 0.0 else interview_no_show / (interviews_completed + interview_no_show) * 100 end - 10.0",
            reason="No-shows waste recruiter and interviewer capacity.",
            action="Enable reminder workflows and confirmation before interview slots.",
            evidence=[f"{fint('interview_no_show')} || ' no-shows (' || " + fmt1("case when (interviews_completed + interview_no_show) = 0 then 0.0 else interview_no_show / (interviews_completed + interview_no_show) * 100 end") + " || '% of interview activity)'"],
            cond="interview_no_show > 0"),
    ins_row(3, "Offer-to-join gap", "RISK", "'HIGH'", "offer_join_gap", "offers_accepted - joined",
            reason="Accepted offers not yet converted to joining.",
            action="Track documentation, release letters, and onboarding readiness.",
            evidence=[f"{fint('offers_accepted - joined')} || ' accepted offers pending join'"],
            cond="offers_accepted > joined"),
    ins_row(4, "Low interview selection rate", "DECLINE", "'MEDIUM'", "interview_selection_rate",
            "interview_selection_rate", "50.0", "interview_selection_rate - 50.0",
            reason="Screening quality or role calibration may be misaligned.",
            action="Review screening criteria and interviewer feedback loops.",
            evidence=["'Selection rate ' || " + fmt1("interview_selection_rate") + " || '%'",
                      f"{fint('interview_selected')} || '/' || {fint('interviews_completed')} || ' interviews selected'"],
            cond="interview_selection_rate < 50 and interviews_completed > 10"),
    ins_row(5, "Recruiter underperformance signal", "BENCHMARK", "'MEDIUM'", "recruiter_efficiency_score",
            "r_bottom.score", rdec("r_median", 1), "r_bottom.score - r_median", "r_bottom.entity",
            reason="Efficiency score materially below team median.",
            action="Review pipeline aging and conversion stages for this recruiter.",
            evidence=["'Score ' || " + fmt1("r_bottom.score") + " || ' vs median ' || " + fmt1("r_median"),
                      "'Joined ' || cast(r_bottom.joined as varchar) || '/' || cast(r_bottom.apps as varchar) || ' applications'"],
            cond="r_n >= 2 and r_bottom.score < r_median - 15"),
    ins_row(6, "Top recruiter efficiency", "OPPORTUNITY", "'LOW'", "recruiter_efficiency_score",
            "r_top.score", rdec("r_median", 1), entity="r_top.entity",
            reason="Strong normalized efficiency across funnel stages.",
            action="Document best practices from this recruiter for team enablement.",
            evidence=["'Efficiency score ' || " + fmt1("r_top.score")],
            cond="r_n >= 2 and r_top.score >= r_median + 10"),
    ins_row(7, "Highest-quality source", "OPPORTUNITY", "'LOW'", "source_join_rate", "s_best.rate",
            entity="s_best.entity", reason="Best application-to-join conversion among sources.",
            action="Increase investment in this channel if capacity allows.",
            evidence=[fmt1("s_best.rate") + " || '% join rate'",
                      "cast(s_best.joined as varchar) || '/' || cast(s_best.apps as varchar) || ' applications'"],
            cond="s_n > 0 and s_best.rate > 0"),
    ins_row(8, "High-volume low-conversion source", "RISK", "'MEDIUM'", "source_volume_vs_conversion",
            "s_vol.apps", entity="s_vol.entity", reason="Large volume source with weak join conversion.",
            action="Re-evaluate sourcing spend and screening for this channel.",
            evidence=[f"{fint('s_vol.apps')} || ' applications'", "'Join rate ' || " + fmt1("s_vol.rate") + " || '%'"],
            cond="s_n > 0 and s_vol.apps > total * 0.3 and s_vol.rate < 5"),
    ins_row(9, "Strong offer conversion", "BENCHMARK", "'LOW'", "joining_rate", "joining_rate", "85.0",
            reason="Healthy offer acceptance and onboarding execution.",
            action="Maintain onboarding SLA and candidate communication.",
            evidence=["'Joining rate ' || " + fmt1("joining_rate") + " || '%'"],
            cond="joining_rate >= 85 and offers_accepted > 0"),
]
_SNAP = ins_row(10, "Pipeline snapshot", "BENCHMARK", "'LOW'", "applications", "total",
                reason="Baseline funnel metrics for current filter scope.",
                action="Apply filters or upload data to surface operational signals.",
                evidence=[f"{fint('total')} || ' applications → ' || {fint('joined')} || ' joined'"],
                cond="not exists (select 1 from fired)")
INSIGHTS_CTE = (FACTS + ", fired as (" + " union all ".join(_RULES) + "), ins0 as (select * from fired union all "
                + _SNAP + "), ins as (select *, case severity when 'CRITICAL' then 0 when 'HIGH' then 1 "
                "when 'MEDIUM' then 2 when 'LOW' then 3 end as severity_rank from ins0)")
register("insights", with_apps(INSIGHTS_CTE + " select * from ins"))
register("insight_cards", with_apps(
    INSIGHTS_CTE + """ select rule_no, severity_rank,
      case insight_type when 'RISK' then 'risk' when 'BOTTLENECK' then 'action' when 'DECLINE' then 'risk'
        when 'OPPORTUNITY' then 'highlight' when 'BENCHMARK' then 'info' when 'ANOMALY' then 'risk'
        when 'FORECAST' then 'info' else 'info' end as tone,
      insight_type as type, severity, title, metric, current_value as current,
      coalesce(comparison_value, '—') as comparison, coalesce(""" + fmt1("change") + """ || '%', '—') as change,
      coalesce(entity, '—') as entity, reason, recommended_action as action,
      case when recommended_action <> '' then reason || ' ' || recommended_action else reason end as body,
      array_to_string(evidence, '; ') as evidence from ins"""))

register("executive_findings", with_apps(
    CMP_CTE.replace(trend_body("M"), trend_body("M") + KPI_CTE.replace(FL_CTE, "", 1), 1)
    + ", fc5 as (" + _CONV_SQL.replace("from k", "from k") + "), w as (select conversion, rate_pct from fc5 "
    "order by rate_pct, step limit 1), jc as (select max(percent_change) as joined_change from cmp "
    "where metric = 'Joined' and percent_change is not null), fx as (select * from k, jc, w) "
    "select 1 as finding_no, 'DECLINE' as category, 'Hiring volume declining' as title, "
    "'Joined candidates down ' || " + fmt1("joined_change") + " || '% vs prior period.' as detail, 'HIGH' as severity "
    "from fx where joined_change < -10 union all "
    "select 1, 'OPPORTUNITY', 'Hiring volume increasing', 'Joined candidates up ' || " + fmt1("joined_change")
    + " || '% vs prior period.', 'LOW' from fx where joined_change > 10 union all "
    "select 2, 'BOTTLENECK', 'Biggest funnel bottleneck', conversion || ' at ' || " + fmt1("rate_pct")
    + " || '%.', 'HIGH' from fx union all "
    "select 3, 'RISK', 'Offer acceptance below target', 'Offer acceptance at ' || " + fmt1("offer_acceptance_rate")
    + " || '%.', 'MEDIUM' from fx where offer_acceptance_rate < 75 and offers_made > 5 union all "
    "select 4, 'STRENGTH', 'Strong joining execution', 'Joining rate ' || " + fmt1("joining_rate")
    + " || '%.', 'LOW' from fx where joining_rate >= 85"))

_DQ = (", dqs as (select count(*) as row_count, count_if(candidate_id is null) as miss_cid, "
       "count_if(interview_status is null) as miss_iv, count_if(offer_status is null) as miss_off, "
       f"count(salary_lpa) - count({parse_num('salary_lpa')}) as bad_sal, "
       f"count(time_to_hire_days) - count({parse_num('time_to_hire_days')}) as bad_tth, "
       "(select count(*) from applications) - (select count(*) from (select distinct * from applications)) as dup_rows "
       "from applications), dq as (select greatest(0.0, " + rdec(
           "100.0 - (" + " + ".join([f"least(25.0, {_share('dup_rows')} * 0.5)", f"least(10.0, {_share('miss_cid')} * 0.3)",
                                     f"least(10.0, {_share('miss_iv')} * 0.3)", f"least(10.0, {_share('miss_off')} * 0.3)",
                                     f"least(8.0, 0 / greatest(row_count, 1) * 100 * 0.4)",
                                     f"least(5.0, {_share('bad_sal')} * 0.3)", f"least(5.0, {_share('bad_tth')} * 0.3)"])
           + ") - 0.0", 1) + ") as dq from dqs)")
_AR = (", arw as (select avg(case aging_bucket when 'HEALTHY' then 0 when 'WATCH' then 1 when 'AGING' then 2 "
       "when 'CRITICAL' then 3 else 0 end) as w from aged), "
       "ar as (select case when w is null then 100.0 else round(greatest(0.0, 100.0 - w * 25), 1) end as aging from arw)")
_FUNNEL = ("(least(screening_rate / 100, 1.0) * 0.25 + least(interview_selection_rate / 100, 1.0) * 0.25 + "
           "least(offer_acceptance_rate / 100, 1.0) * 0.25 + least(joining_rate / 100, 1.0) * 0.25) * 100")
_VEL = ("case when avg_time_to_hire is not null and avg_time_to_hire > 0 then "
        "greatest(20.0, least(100.0, 45.0 / avg_time_to_hire * 100)) else 70.0 end")
register("health_score", with_apps(
    KPI_CTE + AGED + _AR + _DQ + " select "
    + rdec(f"({_FUNNEL}) * 0.3 + ({_VEL}) * 0.15 + least(offer_acceptance_rate, 100.0) * 0.15 + "
           "least(joining_rate, 100.0) * 0.2 + aging * 0.15 + dq * 0.1", 1) + " as score, "
    + rdec(_FUNNEL, 1) + " as funnel_efficiency, " + rdec(_VEL, 1) + " as hiring_velocity, "
    + rdec("least(offer_acceptance_rate, 100.0)", 1) + " as offer_acceptance, "
    + rdec("least(joining_rate, 100.0)", 1) + " as joining, " + rdec("aging", 1) + " as aging, "
    + rdec("dq", 1) + " as data_quality, 'Internal Recruitment Health Score' as label from k, ar, dq"))


# ---------------------------------------------------------------- answers


def _sub(fragment: str, select: str) -> str:
    """A subquery with its own CTE scope built from a ', name as (...)' fragment."""
    return f"(with _s as (select 1){fragment} {select})"


def _nan(e: str) -> str:
    return f"coalesce(cast({e} as varchar), 'nan')"


def _pick_row(src: str, key: str, order_col: str, asc: bool) -> str:
    d = "asc" if asc else "desc"
    return f"from {src} order by {order_col} {d}, coalesce(cast({key} as varchar), '') {d} limit 1"


_ANS_FACTS = " union all ".join([
    "select * from " + _sub(KPI_CTE + f", fc5 as ({_CONV_SQL})",
                             "select 'bottleneck' as intent, cast(null as varchar) as ranking, "
                             "'The biggest funnel bottleneck is ' || conversion || ' at ' || " + fmt1("rate_pct")
                             + " || '%.' as answer, cast(null as varchar) as entity from fc5 order by rate_pct, step limit 1"),
    "select * from " + _sub(CMP_CTE.replace(trend_body("M"), trend_body("M") + KPI_CTE.replace(FL_CTE, "", 1), 1),
                             "select 'declining_hires', cast(null as varchar), 'Current joined count is ' || "
                             + fint("joined") + " || '.' || coalesce(' Prior period comparison: ' || "
                             + fmt1("(select max(percent_change) from cmp where metric = 'Joined' and percent_change is not null)")
                             + " || '% change.', ''), cast(null as varchar) from k"),
    "select * from " + _sub(_RI, "select 'recruiter_ranking', 'worst', " + _nan("recruiter")
                             + " || ' has the lowest efficiency score (' || " + fmt1("efficiency_score")
                             + " || ').', cast(recruiter as varchar) " + _pick_row("ri", "recruiter", "efficiency_score", True)),
    "select * from " + _sub(_RI, "select 'recruiter_ranking', 'best', " + _nan("recruiter")
                             + " || ' leads with efficiency score ' || " + fmt1("efficiency_score")
                             + " || '.', cast(recruiter as varchar) " + _pick_row("ri", "recruiter", "efficiency_score", False)),
    "select * from " + _sub(no_eff("client") + f", ch as (select *, {_CH} as client_health_score from cards)",
                             "select 'client_ranking', 'worst', " + _nan("client") + " || ' is the hardest client (health score ' || "
                             + fmt1("client_health_score") + " || ').', cast(client as varchar) "
                             + _pick_row("ch", "client", "client_health_score", True)),
    "select * from " + _sub(no_eff("client") + f", ch as (select *, {_CH} as client_health_score from cards)",
                             "select 'client_ranking', 'best', " + _nan("client") + " || ' is the strongest client (health score ' || "
                             + fmt1("client_health_score") + " || ').', cast(client as varchar) "
                             + _pick_row("ch", "client", "client_health_score", False)),
    "select * from " + _sub(grouped_metrics("source", False).replace(", efficiency_score from gme", " from gme"),
                             "select 'source_ranking', 'volume', " + _nan("source") + " || ' has highest volume (' || "
                             "cast(applications as varchar) || ' applications).', cast(source as varchar) "
                             + _pick_row("cards", "source", "applications", False)),
    "select * from " + _sub(grouped_metrics("source", False).replace(", efficiency_score from gme", " from gme")
                             + ", sq as (select *, " + rdec("joining_rate_pct * 0.5 + interview_selection_pct * 0.3 + "
                                                           "offer_acceptance_pct * 0.2", 2) + " as quality_score from cards)",
                             "select 'source_ranking', 'best', " + _nan("source") + " || ' has the best quality score (' || "
                             + fmt1("quality_score") + " || ').', cast(source as varchar) "
                             + _pick_row("sq", "source", "quality_score", False)),
    "select * from " + _sub(no_eff("role") + f", rd as (select *, cast(least(100, {_PTS}) as double) as hd, "
                             f"{_WHY} as _why from cards)",
                             "select 'role_ranking', 'hard', " + _nan("role") + " || ' is hardest to hire (difficulty ' || "
                             + fmt1("hd") + " || '): ' || case when _why = '' then 'within normal range' else _why end || '.', "
                             "cast(role as varchar) " + _pick_row("rd", "role", "hd", False)),
])

_ANS_ACTIONS = {
    "declining_hires": "Review funnel stages with largest conversion drops.",
    "bottleneck": "Focus operational effort on the weakest conversion stage.",
    "recruiter_ranking": "Review recruiter pipeline aging and stage conversion.",
    "client_ranking": "Align client expectations and screening calibration.",
    "source_ranking": "Balance volume and quality when allocating sourcing spend.",
    "role_ranking": "Review role requirements, compensation, and pipeline aging.",
    "aging_query": "Prioritize recruiter follow-up on aging candidates.",
    "forecast_target": "Increase sourcing or improve conversion at bottleneck stage.",
}
_UNKNOWN = ("I could not interpret that question. Try: 'Which recruiter is underperforming?' "
            "or 'Where is the biggest funnel bottleneck?'")
_FCX = "(" + FC_CTE.replace(", fl as (", ", fl_unused as (", 0) + ")"
_TGT = "(case when t.target_hires = 0 then 100 else t.target_hires end)"
_OK = "(f.sufficient_data and f.jr > 0)"


def _fmt0(x: str) -> str:
    return f"cast(cast({rdec(x, 0)} as bigint) as varchar)"


_FORECAST_TEXT = (
    "case when " + _OK + " then 'ESTIMATE: expected joins ' || " + _fmt0("f.estimate_low") + " || '–' || "
    + _fmt0("f.estimate_high") + " || ' vs target ' || cast(" + _TGT + " as varchar) || '. Gap ' || "
    + _fmt0(rdec(f"greatest(0.0, {_TGT} - f.estimate_high)", 1)) + " || '–' || "
    + _fmt0(rdec(f"greatest(0.0, {_TGT} - f.estimate_low)", 1)) + " || '. Additional pipeline ~' || "
    + fint(rdec(f"greatest(0.0, {_TGT} - f.estimate_high) / greatest(f.jr, 0.001)", 0)) + " || '–' || "
    + fint(rdec(f"greatest(0.0, {_TGT} - f.estimate_low) / greatest(f.jr, 0.001)", 0))
    + " || ' applications.' else f.message end")

register("answers", with_apps(
    ", qs as (" + QS_SRC + ")" + tag_sql("select * from qs").replace("(select * from qs), tq", ", tq", 1)
    .replace("(select * from qs)", "", 0)
    + ", facts as (" + _ANS_FACTS + ")"
    + AGED
    + ", fcr as " + _sub(FC_CTE + JR_CTE, "select fc.*, jr.jr from fc, jr")
    + """ select t.conv_id, t.turn, t.question, t.intent, t.ranking, t.aging_days, t.target_hires,
      case when t.intent = 'aging_query' then
             (case when (case when t.aging_days = 0 then 14 else t.aging_days end) is null
                   then 'No date data for aging analysis.'
                   else """ + fint("(select count(*) from aged where aging_days > (case when t.aging_days = 0 then 14 else t.aging_days end))")
    + """ || ' candidates are aging beyond ' || cast(case when t.aging_days = 0 then 14 else t.aging_days end as varchar)
                        || ' days.' end)
           when t.intent = 'forecast_target' then """ + _FORECAST_TEXT + f"""
           when t.intent = 'unknown' then {q(_UNKNOWN)}
           else x.answer end as answer,
      x.entity,
      case when t.intent = 'aging_query' and (case when t.aging_days = 0 then 14 else t.aging_days end) is null then ''
           when t.intent = 'forecast_target' and not {_OK} then ''
           """ + " ".join(f"when t.intent = {q(k)} then {q(v)}" for k, v in _ANS_ACTIONS.items()) + """
           else '' end as recommended_action
    from tagged t left join facts x on t.intent = x.intent and t.ranking is not distinct from x.ranking
    left join fcr f on t.intent = 'forecast_target'"""))


# ---------------------------------------------------------------- legacy picks, report read-back, summary

_TOP_SRC = FL_CTE + "".join(
    f", {d}_g as (select {d}, {group_cols()} from (select {d}, {counts_cols()} from fl group by {d}))"
    for d in ("recruiter", "client", "technology"))
register("top_entities", with_apps(
    _TOP_SRC + " select * from (select 'recruiter' as entity_type, cast(recruiter as varchar) as entity, "
    "'joining_rate_pct' as metric, cast(joining_rate_pct as double) as value, joined from recruiter_g "
    "order by recruiter is null, coalesce(recruiter, '') limit 1) union all "
    "select * from (select 'client', cast(client as varchar), 'joining_rate_pct', cast(joining_rate_pct as double), joined "
    "from client_g order by joining_rate_pct desc, coalesce(client, '') desc limit 1) union all "
    "select * from (select 'technology', cast(technology as varchar), 'average_salary', cast(average_salary as double), "
    "joined from technology_g order by average_salary desc nulls last, coalesce(technology, '') desc limit 1)"))
register("report_kpi_lookup", with_apps(KPI_CTE + "\n" + _rows(
    "k", [(q(lbl), f"coalesce(cast({c} as double), 0.0)") for lbl, c in _SUMMARY], ["metric", "value"])))
register("database_summary", with_apps(
    AUDIT_CTE + " select (select count(*) from applications) as candidates, (select count(*) from audit) as audit_events",
    v2=True))
register("fingerprint_rows", with_apps(
    " select candidate_id, sha256(concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '')" for c in _APP_COLS)
    + ")) as row_sha256 from applications"))
register("coerce_numeric", with_apps(
    ' select "Candidate ID" as candidate_id, "Notes" as raw_value, ' + parse_num('"Notes"') + " as value "
    "from applications_raw", raw=True))

# ---------------------------------------------------------------- uploads in other layouts, catalogues of uploads

_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])? ?(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
_DAY_LAYOUTS = [("iso", r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), ("year_slash", r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"),
                ("compact", r"\d{8}", "%Y%m%d"), ("month_first", r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
                ("day_first", r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y")]
_DATED = [("Applied On", "application_date"), ("Interview Date", "interview_date"), ("Offer Date", "offer_date"), ("Start Date", "joining_date")]


def _dated_text(days: str, fmt: str, after: str = "") -> str:
    return (f"case when k % 251 = 0 then 'not-a-date' when k % 53 = 0 then '   ' "
            f"else strftime(application_date + cast({days} as integer), '{fmt}') || '{after}' end")


DATED_SQL = f"""
, dated_k as (select candidate_id as "Candidate ID",
 case when k % 97 = 0 then strftime(application_date, '%Y-%m-%d') else {_dated_text('0', '%d/%m/%Y')} end as "Applied On",
 {_dated_text('k % 20', '%-m/%-d/%Y')} as "Interview Date",
 {_dated_text('k % 40', '%Y%m%d')} || case when k % 7 = 0 then '  ' else '' end as "Offer Date",
 {_dated_text('k % 60', '%Y-%m-%d', 'T23:30:00-05:00')} as "Start Date",
 case when k % 31 = 0 then 'n/a' when k % 11 = 0 then '12,5%' else concat(k % 101, case when k % 3 = 0 then '' else '%' end) end as "Match",
 case when k % 4 = 0 then concat('Reason ', k % 9) end as "Reason for Rejection", k
 from (select *, cast(substr(candidate_id, 5) as bigint) as k from applications) a)"""


def _day(name: str, shape: str, fmt: str) -> str:
    return f"try_strptime(nullif(regexp_extract(\"{name}\", '^\\s*({shape}){_TIME}\\s*$', 1), ''), '{fmt}')"


# the layout that most values of a column fit, the earlier of equal ones, found by counting
_VOTES = DATED_SQL + ", votes as (" + " union all ".join(
    f"select '{field}' as field, '{layout}' as layout, {k} as place, count({_day(name, shape, fmt)}) as fitting from dated_k"
    for name, field in _DATED for k, (layout, shape, fmt) in enumerate(_DAY_LAYOUTS)) + \
    "), chosen as (select field, arg_max(layout, fitting * 100 - place) as layout, max(fitting) as fitting from votes group by field)"


def _chosen_day(name: str, field: str) -> str:
    cases = " ".join(f"when '{layout}' then {_day(name, shape, fmt)}" for layout, shape, fmt in _DAY_LAYOUTS)
    return f"cast(case (select layout from chosen where field = '{field}') {cases} end as date)"


register("normalize_date_columns", with_apps(_VOTES + ' select "Candidate ID" as candidate_id, ' + ", ".join(
    f"coalesce(strftime({_chosen_day(name, field)}, '%Y-%m-%d'), \"{name}\") as {field}" for name, field in _DATED) + " from dated_k"))
register("date_layouts", with_apps(_VOTES + " select field, layout, fitting from chosen"))
register("time_to_hire", with_apps(
    _VOTES + f""" select "Candidate ID" as candidate_id, cast({_chosen_day('Start Date', 'joining_date')}
 - {_chosen_day('Applied On', 'application_date')} as double) as time_to_hire_days from dated_k"""))
register("clean_percent", with_apps(
    DATED_SQL + ", every as (select \"Candidate ID\" as candidate_id, \"Match\" as raw_value from dated_k"
    " union all select null, null from dated_k where k % 401 = 0)"
    f" select candidate_id, raw_value, {parse_num(chr(39).join(['replace(raw_value, ', '%', ', ', '', ')']))} as value from every"))
register("rejections", with_apps(
    DATED_SQL + ' select "Reason for Rejection" as rejection_reason, count(*) as count from dated_k'
    ' where "Reason for Rejection" is not null group by 1'))
register("drop_blank_lines", with_apps(DATED_SQL + ' select "Candidate ID" as candidate_id, "Match" from dated_k'))

_ALIASES = [a for names in S.CANONICAL_ALIASES.values() for a in names]
_FIELDS = list(S.CANONICAL_ALIASES)
_PLAIN_NAME = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), '_')"
_ALIAS_ROWS = ", ".join(f"({k}, {q(a)}, {q(f)})" for k, (f, a) in enumerate((f, a) for f, names in S.CANONICAL_ALIASES.items() for a in names))
CATALOGUE_SQL = f"""with recursive catalogue as (
 select c_custkey as upload_id, cast(j as bigint) as position,
  case (c_custkey + j * 3) % 6 when 1 then upper(replace(a, '_', ' ')) when 2 then a || ' x2' when 3 then 'My-' || a
   when 4 then concat('Zz ', j) else a end as header,
  case when (c_custkey * 3 + j) % 13 = 0 then [{lit_list(_FIELDS)}][(c_custkey + j) % {len(_FIELDS)} + 1] end as override
 from (select c_custkey, j, [{lit_list(_ALIASES)}][(c_custkey * 31 + j * 17 + c_nationkey * 7) % {len(_ALIASES)} + 1] as a
       from customer, range(10) as r(j)) x)"""
MAPPED_SQL = CATALOGUE_SQL + f""",
aliases as (select place, {_PLAIN_NAME.format('a')} as alias, field from (values {_ALIAS_ROWS}) as t(place, a, field)),
lookup as (select alias, arg_max(field, place) as field from aliases group by alias),
own as (select upload_id, header, min(position) as position, arg_min(override, position) as o from catalogue group by upload_id, header),
named as (select own.upload_id, own.header, own.position, c.override, {_PLAIN_NAME.format('own.header')} as normalized
          from own join catalogue c on c.upload_id = own.upload_id and c.position = own.position),
wishes as (select named.*, coalesce(override, field) as wish from named left join lookup on alias = normalized),
claims as (select upload_id, position, wish, row_number() over (partition by upload_id, wish order by position) = 1 and wish is not null as ok from wishes),
used as (select upload_id, list(wish) filter (where ok) as taken from claims group by upload_id),
inside as (select w.upload_id, w.position, list(distinct a.field) as fields from wishes w
           join aliases a on length(a.alias) >= 5 and contains(w.normalized, a.alias) group by w.upload_id, w.position),
left_over as (select c.upload_id, c.position, coalesce(i.fields, []) as fields, row_number() over (partition by c.upload_id order by c.position) as step
              from claims c left join inside i on i.upload_id = c.upload_id and i.position = c.position where not c.ok),
fold as (
 select upload_id, cast(0 as bigint) as step, coalesce(taken, []) as taken, cast(null as bigint) as position, cast(null as varchar) as pick from used
 union all
 select x.upload_id, x.step, case when len(free) = 1 then list_append(x.taken, free[1]) else x.taken end, x.position, case when len(free) = 1 then free[1] end
 from (select l.upload_id, l.step, f.taken, l.position, list_filter(l.fields, lambda z: not list_contains(f.taken, z)) as free
       from fold f join left_over l on l.upload_id = f.upload_id and l.step = f.step + 1) x),
mapped as (select w.upload_id, w.position, w.header, w.normalized, case when c.ok then w.wish else f.pick end as field,
            case when c.ok then case when w.override is not null then 'override' else 'alias' end when f.pick is not null then 'fuzzy' end as how
           from wishes w join claims c using (upload_id, position) left join fold f on f.upload_id = w.upload_id and f.position = w.position)"""
register("header_normalize", CATALOGUE_SQL + f" select upload_id, position, header, {_PLAIN_NAME.format('header')} as normalized from catalogue")
register("column_mapping", MAPPED_SQL + " select * from mapped")
register("mapping_table", MAPPED_SQL + " select upload_id, position, header as uploaded_column, case field " + " ".join(
    f"when {q(f)} then {q(S.DISPLAY_NAMES[f])}" for f in _FIELDS) + " end as recognized_as from mapped where field is not null")

_PROFILE_MISSING = ", ".join(f"case when m{i} > 0 then concat({q(c.strip(chr(34)))}, '=', m{i}) end" for i, c in enumerate(NORM_COLS))
_HEALTH_SQL, _VALID_SQL = ORACLE["health_score_data"], ORACLE["validation_report"]
register("data_profile", with_apps(
    STATS + ", m as (select " + ", ".join(f"count_if({c} is null) as m{i}" for i, c in enumerate(NORM_COLS)) + " from norm), "
    "h as (select" + _HEALTH_SQL[_HEALTH_SQL.index(" greatest(0.0"):] + "), v as (select" + _VALID_SQL[_VALID_SQL.index(" true as valid"):] + ") "
    f"select health_score, row_count, column_count, h.duplicate_rows, list_sort(list_filter([{_PROFILE_MISSING}], lambda x: x is not null)) as missing_by_field, "
    "list_filter([case when bad_date > 0 then concat('application_date=', bad_date) end], lambda x: x is not null) as invalid_dates, "
    "list_filter([case when bad_num > 0 then concat('salary_lpa=', bad_num) end], lambda x: x is not null) as invalid_numeric, "
    "v.unmapped_columns, h.issues, v.warnings as normalization_notes "
    "from (select health_score, row_count, column_count, duplicate_rows, issues from h) h, (select unmapped_columns, warnings from v) v, m, "
    "(select bad_date, bad_num from st) b", raw=True))

# ---------------------------------------------------------------- executive package, SQL over a view, bundles, source fallback

_SCORES = ["score", "funnel_efficiency", "hiring_velocity", "offer_acceptance", "joining", "aging", "data_quality"]
_NO = "cast(null as double)"
register("executive_package", " union all ".join([
    *[f"select 'health' as section, {k + 1} as position, '{n}' as item, cast({n} as double) as value, {_NO} as comparison, {_NO} as change, "
      f"cast(null as varchar) as category, cast(null as varchar) as severity, label as detail from ({ORACLE['health_score']})"
      for k, n in enumerate(_SCORES)],
    "select 'comparisons', cast(metric_order as integer), metric, current, previous, percent_change, null, null, note from (" + ORACLE["period_comparison"] + ")",
    f"select 'findings', cast(finding_no as integer), title, {_NO}, {_NO}, {_NO}, category, severity, detail from (" + ORACLE["executive_findings"] + ")",
    f"select 'funnel_rates', cast(step as integer), conversion, rate_pct, {_NO}, {_NO}, null, null, null from (" + ORACLE["funnel_conversion"] + ")"]))
register("view_filtered", ORACLE["query_filtered"].replace(" order by candidate_id limit 250", ""))
register("view_count", with_apps(f"select count(*) as row_count from applications where {_FILTER_WHERE} and "
                                 f"{like_any(('candidate_name', 'location', 'source'), P.SEARCH_TEXT)}"))
register("view_group_count", ORACLE["group_count"])
register("view_distinct", ORACLE["distinct_values"])
register("bundle_mappings", MAPPED_SQL + """, u as (select upload_id, concat('upload-', upload_id) as source_name,
 coalesce(list(header order by position) filter (where field is null), []) as unmapped,
 coalesce(list(header order by position) filter (where how = 'fuzzy'), []) as low_confidence from mapped where upload_id % 7 <> 0 group by upload_id)
 select u.*, header, field from u left join (select upload_id, header, field from mapped where field is not null) m using (upload_id)""")
register("bundle_broken", "select c_custkey as upload_id, true as has_text from customer where c_custkey % 7 = 0")
register("bundle_profile", ORACLE["data_profile"])
register("source_fallback", "select o_orderpriority, count(*) as orders, 'orders.parquet' as source from orders group by o_orderpriority")

# ---------------------------------------------------------------- statuses of every kind, questions of every rule

_MIXED_SQL = "select * exclude (k, r) replace (" + ", ".join(f"{e} as {c}" for c, e in FX.MIXED.items()) + (
    ") from (select *, cast(substr(candidate_id, 5) as bigint) as k, cast(substr(role, 6) as int) as r from (" + APPLICATIONS_SQL + ") a) a")
for _name in ("current_stage", "next_action", "stage_counts", "ops_counters", "stage_filter", "candidate_queue", "role_intelligence", "kpis_total",
              "journey"):
    register(f"{_name}_mixed", ORACLE[_name].replace(f"applications as ({APPLICATIONS_SQL})", f"applications as ({_MIXED_SQL})"))
_FORMED_SRC = f"select conv_id, turn, {FX.FORMED_QUESTION} as question from conversations where role = 'user'"
for _name in ("intent_tags", "answers"):
    register(f"{_name}_formed", ORACLE[_name].replace(QS_SRC, _FORMED_SRC))

# evidence and metrics of the answers: one row per intent, ranking and piece


def _piece(intent: str, ranking: str | None, metric: str, tail: str, value="null", text="null", comparison="null", change="null",
           entity="null", detail="null") -> str:
    return (f"select {q(intent)} as intent, cast({q(ranking) if ranking else 'null'} as varchar) as ranking, {q(metric)} as metric, "
            f"cast({value} as double) as value, cast({text} as varchar) as text, cast({comparison} as double) as comparison, "
            f"cast({change} as double) as change, cast({entity} as varchar) as entity, cast({detail} as varchar) as detail {tail}")


_CLIENT_SCORED = no_eff("client") + f", ch as (select *, {_CH} as client_health_score from cards)"
_SOURCE_CARDS = grouped_metrics("source", False).replace(", efficiency_score from gme", " from gme")
_SOURCE_SCORED = _SOURCE_CARDS + ", sq as (select *, " + rdec(
    "joining_rate_pct * 0.5 + interview_selection_pct * 0.3 + offer_acceptance_pct * 0.2", 2) + " as quality_score from cards)"
_JOINED_NOW = "(select * from cmp where metric = 'Joined')"
_EVIDENCE = " union all ".join("select * from " + _sub(fragment, piece) for fragment, piece in [
    (KPI_CTE + f", fc5 as ({_CONV_SQL})", _piece("bottleneck", None, "bottleneck", "from fc5 order by rate_pct, step limit 1", text="conversion",
                                                 detail=fmt1("rate_pct") + " || '%'")),
    (CMP_CTE, _piece("declining_hires", None, "Joined (current)", f"from {_JOINED_NOW}", value="current", comparison="previous",
                     change="percent_change")),
    *[(_RI, _piece("recruiter_ranking", rank, "recruiter", _pick_row("ri", "recruiter", "efficiency_score", rank == "worst"),
                   text=_nan("recruiter"), detail="'score ' || " + fmt1("efficiency_score"))) for rank in ("worst", "best")],
    *[(_CLIENT_SCORED, _piece("client_ranking", rank, "client_health", _pick_row("ch", "client", "client_health_score", rank == "worst"),
                              value="client_health_score", entity=_nan("client"))) for rank in ("worst", "best")],
    (_SOURCE_CARDS, _piece("source_ranking", "volume", "source", _pick_row("cards", "source", "applications", False), text=_nan("source"))),
    (_SOURCE_SCORED, _piece("source_ranking", "best", "source", _pick_row("sq", "source", "quality_score", False), text=_nan("source"))),
    (no_eff("role") + f", rd as (select *, cast(least(100, {_PTS}) as double) as hd, {_WHY} as _why from cards)",
     _piece("role_ranking", "hard", "difficulty", _pick_row("rd", "role", "hd", False), value="hd", entity=_nan("role"))),
])
_THR = "(case when t.aging_days = 0 then 14 else t.aging_days end)"
_STUCK = f"(select count(*) from aged where aging_days > {_THR})"
_ANSWERED = (
    ", qs as (" + _FORMED_SRC + ")" + tag_sql("select * from qs").replace("(select * from qs), tq", ", tq", 1)
    + AGED + ", fcr as " + _sub(FC_CTE + JR_CTE, "select fc.*, jr.jr from fc, jr")
    + ", asked as (select t.*, f.estimate_mid, f.estimate_low, coalesce(" + _OK + f", false) as ok, {_TGT} as tgt, {_THR} as thr, "
      f"case when t.intent = 'aging_query' and {_THR} is not null then {_STUCK} end as stuck "
      "from tagged t left join fcr f on t.intent = 'forecast_target')")
register("answer_evidence", with_apps(
    _ANSWERED + ", pieces as (select a.conv_id, a.turn, a.intent, 1 as evidence_no, e.metric, e.value, e.text, e.comparison, e.change, e.entity, "
    "e.detail from asked a join (" + _EVIDENCE + ") e on a.intent = e.intent and a.ranking is not distinct from e.ranking union all "
    "select conv_id, turn, intent, 1, 'stuck_candidates', cast(stuck as double), null, null, null, null, null from asked where stuck is not null "
    "union all select conv_id, turn, intent, 1, 'expected_joins_mid', estimate_mid, null, null, null, null, null from asked where ok union all "
    f"select conv_id, turn, intent, 2, 'gap_high', {rdec('greatest(0.0, tgt - estimate_low)', 1)}, null, null, null, null, null from asked where ok) "
    "select conv_id, turn, a.intent, cast(evidence_no as integer) as evidence_no, metric, value, text, comparison, change, entity, detail "
    "from asked a left join pieces using (conv_id, turn)"))
register("answer_metrics", with_apps(
    _ANSWERED + ", named as (select intent, ranking, entity from (" + _ANS_FACTS + ")), k as " + _sub(KPI_CTE, "select * from k")
    + ", pieces as (select conv_id, turn, 'joined' as metric, cast((select joined from k) as double) as value from asked "
    "where intent = 'declining_hires' union all "
    "select conv_id, turn, 'threshold_days', cast(thr as double) from asked where stuck is not null union all "
    "select conv_id, turn, 'stuck_count', cast(stuck as double) from asked where stuck is not null union all "
    "select conv_id, turn, 'target', cast(tgt as double) from asked where ok union all "
    "select conv_id, turn, 'expected_mid', estimate_mid from asked where ok) "
    "select a.conv_id, a.turn, case when a.intent like '%ranking' then [coalesce(n.entity, 'nan')] else cast([] as varchar[]) end as entities, "
    "'deterministic' as answer_source, p.metric, p.value from asked a left join pieces p using (conv_id, turn) "
    "left join named n on n.intent = a.intent and n.ranking is not distinct from a.ranking"))

# ---------------------------------------------------------------- history over several snapshots

HISTORY_CTE = (
    ", snap_k as (select *, cast(substr(candidate_id, 5) as bigint) as k from applications), "
    "snap_v as (select * exclude (k, v) replace (" + ", ".join(f"{e} as {c}" for c, e in FX.SNAPSHOT.items()) + "), v, k "
    f"from snap_k, range(1, 4) as g(v) where {FX.SNAPSHOT_ROWS}), "
    "snap_all as (select * from snap_v union all select * from snap_v where k % 199 = 0), "
    "versions as (select distinct candidate_id, v, " + _TXT + " from snap_all), "
    "chains as (select *, row_number() over w as nth, " + ", ".join(f"lag(t{i}) over w as o{i}" for i in range(len(_AUDIT)))
    + " from versions window w as (partition by candidate_id order by v)), events as ("
    + " union all ".join([
        f"select candidate_id, v, {i + 1} as field_order, 'UPDATE {c}' as action, o{i} as old_value, t{i} as new_value from chains "
        f"where nth > 1 and o{i} <> t{i}" for i, c in enumerate(_AUDIT)] + [
        "select candidate_id, v, 0, 'CREATE', null, 'Candidate created' from chains where nth = 1 and v > 1"])
    + "), history as (select candidate_id, cast(v as integer) as snapshot_no, cast(date '2001-08-01' + cast((v - 1) * 7 as integer) as date) as changed_at, "
    "field_order, action, old_value, new_value, 'recruiter' as changed_by from events)")
register("change_history", with_apps(HISTORY_CTE + " select * from history"))
register("audit_timeline", with_apps(
    HISTORY_CTE + " select *, cast(row_number() over (partition by candidate_id order by changed_at desc, snapshot_no desc, field_order desc) as integer) "
    f"as place from history where candidate_id in ({lit_list(P.TIMELINE_IDS)})"))
