"""Empty input and absent columns: every operator still plans and runs."""

from pyspark.sql import functions as F

from hirelens.operators import aging as AG
from hirelens.operators import filters as FL
from hirelens.operators import insights as INS
from hirelens.operators import kpis as K
from hirelens.operators import quality as QA
from hirelens.operators import scorecards as SC
from hirelens.operators import stages as ST
from hirelens.operators import trends as TR
from hirelens.schema import canonical_schema

AS_OF = "2001-08-01"


def _run_all(df):
    out = {
        "kpis": K.compute_kpis(df),
        "by_recruiter": K.group_kpis_by_key(df, "recruiter"),
        "all_dims": K.kpis_all_dimensions(df),
        "funnel": K.funnel_conversion(K.compute_kpis(df)),
        "stage_counts": ST.stage_counts(df),
        "ops": ST.ops_counters(df),
        "aging": AG.aging_risk(AG.aging_summary(df, "application_date", AS_OF)),
        "group_aging": AG.group_aging(df, "recruiter", "application_date", AS_OF),
        "trends": TR.trends(df, "application_date"),
        "comparison": TR.period_comparison(df, "application_date"),
        "forecast": TR.forecast_joins(df, "application_date"),
        "gap": TR.target_gap(df, 100, "application_date"),
        "recruiters": SC.recruiter_intelligence(df, None, "application_date", AS_OF),
        "clients": SC.client_intelligence(df, None, "application_date", AS_OF),
        "roles": SC.role_intelligence(df, None, "application_date", AS_OF),
        "sources": SC.source_intelligence(df),
        "insights": INS.insights(df),
        "missing": QA.missing_report(df),
        "queue": FL.candidate_queue(df),
        "mix": FL.interview_mix(df),
    }
    return {k: v.collect() for k, v in out.items()}


def test_empty_canonical_table(spark):
    df = spark.createDataFrame([], canonical_schema())
    res = _run_all(df)
    assert res["kpis"][0].total == 0
    assert res["by_recruiter"] == [] and res["trends"] == [] and res["comparison"] == []
    assert res["forecast"][0].sufficient_data is False
    assert res["gap"][0].gap_low == 100.0 and res["gap"][0].sufficient_data is False
    assert res["aging"][0].aging_risk_score == 100.0
    assert [r.candidates for r in res["stage_counts"]] == [0] * 11
    assert [r.title for r in res["insights"]] == ["Pipeline snapshot"]


def test_table_without_dimensions_or_dates(spark):
    df = spark.createDataFrame([("C1", "Selected", "Completed", "Selected", "Accepted", "Joined"),
                                ("C2", "Rejected", "Not Scheduled", "", "", "")],
                               "candidate_id string, screening_status string, interview_status string, "
                               "interview_result string, offer_status string, joining_status string")
    res = _run_all(df)
    assert res["kpis"][0].total == 2 and res["kpis"][0].joined == 1
    assert res["by_recruiter"] == [] and res["recruiters"] == [] and res["sources"] == []
    assert res["trends"] == [] and res["forecast"][0].sufficient_data is False
    titles = {r.title for r in res["insights"]}
    assert "Interview scheduling backlog" in titles


def test_only_null_keys_group(spark):
    df = spark.createDataFrame([(None, "Selected"), (None, "Rejected")],
                               "recruiter string, screening_status string")
    g = K.group_kpis_by_key(df, "recruiter").collect()
    assert len(g) == 1 and g[0].recruiter is None and g[0].applications == 2
    assert AG.group_aging(df, "recruiter", None, AS_OF).count() == 0
    assert F is not None
