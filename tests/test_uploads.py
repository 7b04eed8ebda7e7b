"""Date layouts, catalogues of uploads, the data profile, snapshot history, and queries that meet every rule."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hirelens import schema as S
from hirelens.functions import dates as D
from hirelens.operators import audit as AU
from hirelens.operators import ingest as IN
from hirelens.operators import quality as QA
from hirelens.sources import fixtures as FX


@pytest.mark.parametrize("values, layout, days", [
    (["13/05/2024", "01/02/2024", None, " 03/04/2024 "], "day_first", ["2024-05-13", "2024-02-01", None, "2024-04-03"]),
    (["05/13/2024", "1/2/2024"], "month_first", ["2024-05-13", "2024-01-02"]),
    (["1/2/2024", "3/4/2024"], "month_first", ["2024-01-02", "2024-03-04"]),
    (["20240105", "20241231", "junk"], "compact", ["2024-01-05", "2024-12-31", "junk"]),
    (["2024-01-05T23:00:00-05:00", "2024-01-05 00:30:00+14:00", "2024-1-7"], "iso", ["2024-01-05", "2024-01-05", "2024-01-07"]),
    (["5 jan 2024", "17 FEB 2024"], "day_short_month", ["2024-01-05", "2024-02-17"]),
    (["January 5, 2024 10:15 PM"], "long_month_day", ["2024-01-05"]),
    (["31.12.2023", "12/31/2023", "30.12.2023"], "day_first_dot", ["2023-12-31", "12/31/2023", "2023-12-30"]),
    (["2024-02-30", "soon", ""], None, ["2024-02-30", "soon", ""]),
])
def test_a_column_has_the_layout_of_most_of_its_values(spark, values, layout, days):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, application_date string")
    found = D.infer_layouts(df, ["application_date"])
    assert (found["application_date"].name if found["application_date"] else None) == layout
    got = df.select("i", IN.normalize_date_text(df, "application_date", found).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == days


def test_normalised_upload_takes_the_layout_of_each_column(spark):
    df = spark.createDataFrame([("1", "13/05/2024", "05/13/2024"), ("2", "02/03/2024", "02/03/2024")], ["id", "Applied On", "Start Date"])
    got = IN.normalize_all(df).data.orderBy("candidate_id").collect()
    assert [(r.application_date, r.joining_date) for r in got] == [("2024-05-13", "2024-05-13"), ("2024-03-02", "2024-02-03")]
    with pytest.raises(ValueError, match="no rows"):
        IN.normalize_all(df.limit(0))


def test_catalogue_maps_each_upload_as_it_would_alone(spark):
    rng = random.Random(3)
    aliases = [a for names in S.CANONICAL_ALIASES.values() for a in names]
    uploads = {}
    for u in range(60):
        headers = []
        for _ in range(rng.randint(1, 14)):
            a = rng.choice(aliases)
            headers.append(rng.choice([a, a.upper(), f"my {a}", f"{a} 2", f"{a} {rng.choice(aliases)}", "zz", f"no {rng.randint(1, 9)}"]))
        headers = list(dict.fromkeys(headers))
        uploads[u] = headers, {h: rng.choice(list(S.CANONICAL_ALIASES)) for h in headers if rng.random() < 0.1}
    rows = [(u, p, h, wishes.get(h)) for u, (headers, wishes) in uploads.items() for p, h in enumerate(headers)]
    rows += [(u, len(headers) + 5, headers[0], "role") for u, (headers, _) in uploads.items()]  # a header again counts once
    mapped = IN.map_catalogue(spark.createDataFrame(rows, "upload_id int, position int, header string, override string")).collect()
    low = 0
    for u, (headers, wishes) in uploads.items():
        mapping, unmapped, guessed = IN.map_columns(headers, wishes)
        own = [r for r in mapped if r.upload_id == u]
        assert {r.header: r.field for r in own if r.field} == mapping
        assert sorted(r.header for r in own if not r.field) == sorted(unmapped)
        assert sorted(r.header for r in own if r.how == "fuzzy") == sorted(guessed)
        assert all(r.how == ("override" if r.header in wishes else "alias") for r in own if r.how not in ("fuzzy", None))
        low += len(guessed)
    assert low > 20


def test_profile_counts_what_did_not_become_a_number_or_a_day(spark):
    rows = [("1", "₹12.5 LPA", "2024-01-05", "3"), ("2", "n/a", "soon", "x"), ("3", None, None, " "), ("3", "18", "2024-02-05", "4"), ("1", "₹12.5 LPA", "2024-01-05", "3")]
    n = IN.normalize_all(spark.createDataFrame(rows, ["Candidate ID", "CTC", "Applied On", "Experience"]))
    p = QA.profile(n.with_raw, n.mapping, n.unmapped, n.low_confidence).first()
    assert (p.row_count, p.column_count, p.duplicate_rows) == (5, 4, 1)
    assert p.missing_by_field == {"salary_lpa": 2, "application_date": 1, "experience_years": 2}
    assert p.invalid_dates == {"application_date": 1} and p.invalid_numeric == {"salary_lpa": 1, "experience_years": 1}
    assert {r.field: r.invalid for r in QA.invalid_numeric(n.with_raw).collect()} == p.invalid_numeric
    report = QA.validation_report(n.with_raw, n.mapping).first()
    assert report.warnings == p.normalization_notes and "1 salary value(s) could not be interpreted as numbers." in report.warnings
    assert "2 duplicate Candidate ID value(s) detected." in report.warnings
    assert QA.health_score(n.with_raw).first().health_score == p.health_score


def test_history_is_appended_once(spark, small_dir):
    events = AU.change_history(FX.snapshots(spark, small_dir))
    path = tempfile.mkdtemp(prefix="hl-history-") + "/log"
    once = sorted(map(tuple, AU.append_history(events, path).collect()), key=str)
    again = sorted(map(tuple, AU.append_history(events.where("snapshot_no = 2"), path).collect()), key=str)
    assert once == again == sorted(map(tuple, events.collect()), key=str)
    assert {r.action for r in events.select("action").collect()} >= {"CREATE", "UPDATE offer_status", "UPDATE recruiter", "UPDATE salary_lpa"}
    ids = [r[0] for r in events.groupBy("candidate_id").count().where("count > 1").limit(3).collect()]
    for rows in [AU.newest_first(events, [i]).orderBy("place").collect() for i in ids]:
        assert [r.changed_at for r in rows] == sorted((r.changed_at for r in rows), reverse=True)


def distinct(spark, folder, name, column):
    return {r[0] for r in E.queries()[name](spark, folder).select(column).distinct().collect()}


def test_registered_queries_meet_every_rule(spark):
    folder = "/root/testdata/sf0.01"
    assert len(distinct(spark, folder, "current_stage_mixed", "current_stage")) >= 12
    assert len(distinct(spark, folder, "next_action_mixed", "next_action")) >= 6  # two need an offer result or a joining date
    assert len(distinct(spark, folder, "intent_tags_formed", "intent")) == 9
    assert len(distinct(spark, folder, "answers_formed", "answer")) > 30
    assert len(distinct(spark, folder, "role_intelligence_mixed", "hiring_difficulty_score")) >= 3  # four of the six rules
    assert distinct(spark, folder, "column_mapping", "how") == {"alias", "override", "fuzzy", None}
    assert len(distinct(spark, folder, "date_layouts", "layout")) == 4
    assert E.queries()["stage_filter_mixed"](spark, folder).select("current_stage").distinct().count() > 1
    assert E.queries()["candidate_queue_mixed"](spark, folder).count() > 0
    counters = E.queries()["ops_counters_mixed"](spark, folder).first()
    assert all(v > 0 for v in counters)


def test_headers_are_spread_before_they_are_sorted(spark, small_dir):
    """One shuffle by upload, nothing sorted in the tasks that read the files, and the customers dealt out before they become many."""
    given = spark.createDataFrame([(1, 0, "Recruiter", None), (1, 1, "My Recruiter", None)],
                                  "upload_id long, position long, header string, override string")
    for headers in (given, FX.upload_catalogue(spark, small_dir)):
        plan = IN.map_catalogue(headers)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert "Sort" not in plan[plan.index("Exchange"):] and "Generate" not in plan[plan.index("Exchange"):]


def test_change_history_shuffles_values_once(spark):
    """Versions of an id meet in one shuffle; an id with very many rows gives the same events, and is reduced before it."""
    def snapshots(many):
        ids = [("a", 1, "x"), ("a", 2, "y"), ("b", 2, "z"), (None, 2, "z"), ("c", 1, "p"), ("c", 3, None)]
        rows = ids + [("a", 2, "z")] * many + [("h", 1 + k % 3, f"r{k % 3}{k % 7}") for k in range(many)]
        return spark.createDataFrame(rows, "candidate_id string, snapshot_no int, recruiter string") \
            .withColumn("taken_at", F.timestamp_seconds(F.col("snapshot_no") * 86400))

    few, hot = (AU.change_history(snapshots(many)) for many in (42, AU.MANY_ROWS + 50))
    got = [{tuple(r) for r in x.select("candidate_id", "snapshot_no", "field_order", "old_value", "new_value").collect()} for x in (few, hot)]
    assert got[0] == got[1] == {("a", 2, 1, "x", "y"), ("b", 2, 0, None, "Candidate created"), ("c", 3, 1, "p", ""),
                                ("h", 2, 1, "r00", "r10"), ("h", 3, 1, "r10", "r20")}
    assert few.count() == len(got[0]) == hot.count()
    plan = AU.change_history(snapshots(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange"):]
