"""Property test: the Spark KPI aggregate equals a brute-force evaluation of the counting rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hirelens import schema as S
from hirelens.operators import kpis as K

WORDS = sorted(set(S.SCREENING_SELECTED + S.INTERVIEW_SELECTED + S.INTERVIEW_REJECTED + S.INTERVIEW_NO_SHOW
                   + S.INTERVIEW_NOT_SCHEDULED + S.INTERVIEW_COMPLETED_STATUS + S.OFFERS_ACCEPTED
                   + S.OFFERS_DECLINED + S.JOINED + ("candidate dropped", "not applicable", "")))


def variant(word):
    return st.sampled_from([word, word.upper(), word.title(), f"  {word}\t", f"\n{word} "])


status = st.one_of(st.none(), st.sampled_from(WORDS).flatmap(variant))
row = st.tuples(st.sampled_from(["A", "B", None]), status, status, status, status, status)


def _norm(v):
    return "" if v is None else v.strip(" \t\n\x0b\f\r")


def _comb(st_v, res_v):
    r = _norm(res_v)
    return (r if r != "" else _norm(st_v)).lower()


def brute(rows):
    total = len(rows)
    scr = sum(_comb(r[1], None) in S.SCREENING_SELECTED for r in rows)
    iv = [_comb(r[2], r[3]) for r in rows]
    ivs = [_norm(r[2]).lower() for r in rows]
    sel = sum(x in S.INTERVIEW_SELECTED for x in iv)
    rej = sum(x in S.INTERVIEW_REJECTED for x in iv)
    done = sum(s in S.INTERVIEW_COMPLETED_STATUS and x not in
               (S.INTERVIEW_SELECTED + S.INTERVIEW_REJECTED + S.INTERVIEW_NO_SHOW) for s, x in zip(ivs, iv))
    acc = sum(_comb(r[4], None) in S.OFFERS_ACCEPTED for r in rows)
    dec = sum(_comb(r[4], None) in S.OFFERS_DECLINED for r in rows)
    joined = sum(_comb(r[5], None) in S.JOINED for r in rows)
    return {"total": total, "screening_selected": scr, "interview_selected": sel, "interview_rejected": rej,
            "interviews_completed": sel + rej + done, "offers_accepted": acc, "offers_made": acc + dec,
            "joined": joined, "interview_no_show": sum(x in S.INTERVIEW_NO_SHOW for x in iv),
            "interview_not_scheduled": sum(s in S.INTERVIEW_NOT_SCHEDULED for s in ivs)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=0, max_size=25))
def test_kpis_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "recruiter string, screening_status string, interview_status string, "
                                     "interview_result string, offer_status string, joining_status string")
    got = K.compute_kpis(df).first().asDict()
    want = brute(rows)
    assert {k: got[k] for k in want} == want
    per = {r.recruiter: r.applications for r in K.group_kpis_by_key(df, "recruiter").collect()}
    assert sum(per.values()) == len(rows)
