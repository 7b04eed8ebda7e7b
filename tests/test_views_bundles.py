"""SQL over a view against the DataFrame forms, bundles, fingerprints, source fallback, answers with evidence."""

import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hirelens.operators import bundles as BU
from hirelens.operators import filters as FL
from hirelens.operators import questions as QS
from hirelens.operators import sqlview as SV
from hirelens.sources import files as FS


def odd_table(spark):
    rows = [("1", "O'Brien", "a`b", r"50%\off"), ("2", "x' OR '1'='1", "plain", "50 off"), ("3", None, "{braces}", "100%"), ("4", "O'Brien", " ", None)]
    return spark.createDataFrame(rows, ["id", "na`me", "select", "no te"])


@pytest.mark.parametrize("filters, search, columns, order_by, limit", [
    ({"na`me": ["O'Brien"]}, None, None, None, None),
    ({"na`me": ["x' OR '1'='1", "zz"], "nope": ["1"], "select": []}, None, ["id", "nope"], "id", None),
    ({}, r"%\o", ["nope"], "na`me", 2),
    ({"select": ["a`b", "plain", "{braces}"]}, "50_", ["select", "no te"], "select", None),
    (None, " OFF ", None, "missing", 1),
    (None, "'; DROP VIEW x; --", None, None, None),
])
def test_view_gives_the_rows_of_the_dataframe_forms(spark, filters, search, columns, order_by, limit):
    df = odd_table(spark)
    view, looked = SV.TableView(df), ["no te", "na`me", "nope"]
    text, args = view.where(filters, search, looked)
    assert "'" not in text.replace(f"ESCAPE '{SV.LITERAL}'", "") and (search is None or args["search"] == f"%{search.strip().lower()}%")
    if "na`me" not in (order_by, *(filters or {})) and not search:  # the DataFrame forms quote no backticks
        want = FL.query_filtered(df, filters, search, looked, columns, limit, order_by)
        assert view.filtered(filters, search, looked, columns, limit, order_by).collect() == want.collect()
    got = view.filtered(filters, search, looked, None, None, "id").collect()

    def fits(r):
        import re
        chosen = all(r[c] in v for c, v in (filters or {}).items() if v and c in df.columns)
        if not search:
            return chosen
        pattern = "".join({"%": ".*", "_": "."}.get(x, re.escape(x)) for x in search.strip().lower())
        return chosen and any(re.search(pattern, (r[c] or "").lower(), re.S) for c in ("no te", "na`me"))

    assert [r["id"] for r in got] == [r["id"] for r in df.collect() if fits(r)]
    assert view.count(filters, search, looked).first()["row_count"] == len(got)


def test_view_groups_and_distinct_values(spark):
    df = odd_table(spark)
    view = SV.TableView(df)
    assert [tuple(r) for r in view.group_count("na`me").collect()][0] == ("O'Brien", 2)
    assert view.group_count("nope").count() == view.distinct_values("nope").count() == 0
    assert [r[0] for r in view.distinct_values("select").collect()] == ["a`b", "plain", "{braces}"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("table_view_")]


def test_like_takes_a_backslash_as_itself(spark):
    assert [r.id for r in FL.search_like(odd_table(spark), "\\", ["no te"]).collect()] == ["1"]


def test_bundles_come_back_and_broken_ones_stay_apart(spark):
    made = spark.range(3).select("id", BU.to_bundle({
        "fingerprint": F.lit("é\"\\\n"), "mapping": F.create_map(F.lit("A b"), F.lit("role")), "unmapped": F.array().cast("array<string>"),
        "ingest_timings_ms": F.create_map(F.lit("parse"), F.lit(1.5))}).alias("bundle"))
    assert json.loads(made.first()["bundle"])["mapping"] == {"A b": "role"}
    broken = [(10, None), (11, ""), (12, "[1]"), (13, '{"mapping": {"A b"'), (14, '{"mapping": 5}'), (15, "no json")]
    good, bad = BU.read_bundles(made.unionByName(spark.createDataFrame(broken, "id long, bundle string")), ["id"])
    rows = good.collect()
    assert sorted(r.id for r in rows) == [0, 1, 2] and sorted(r.id for r in bad.collect()) == [10, 11, 12, 13, 14, 15]
    assert all((r.fingerprint, r.mapping, r.unmapped, r.low_confidence, r.profile, r.ingest_timings_ms)
               == ("é\"\\\n", {"A b": "role"}, [], None, None, {"parse": 1.5}) for r in rows)


def test_files_have_one_fingerprint_whole_or_in_pieces(spark):
    folder = tempfile.mkdtemp(prefix="hl-files-")
    bodies = {"empty.bin": b"", "small.bin": b"abc", "large.bin": bytes(range(256)) * 400}
    for name, body in bodies.items():
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(body)
    want = {n: (len(b), hashlib.sha256(b + f"{n}|{len(b)}|x".encode()).hexdigest()) for n, b in bodies.items() if b}
    for limit in (FS.WHOLE_BYTES, 100, -1):
        got = FS.file_fingerprints(spark, f"{folder}/*.bin", "x", limit)
        assert {r.file_name: (r.size_bytes, r.fingerprint) for r in got.collect()} == want
    assert "Python" not in FS.file_fingerprints(spark, f"{folder}/*.bin")._jdf.queryExecution().executedPlan().toString()


def test_table_fingerprint_reads_the_whole_row_hash(spark):
    rows = [(1, "a"), (1, "a"), (2, None)]
    a = FS.table_fingerprint(spark.createDataFrame(rows, "i int, t string")).first()
    b = FS.table_fingerprint(spark.createDataFrame(rows[::-1], "i int, t string").repartition(3)).first()
    hashes = [hashlib.sha256(f"{i}|{t or ''}".encode()).hexdigest() for i, t in rows]
    assert a == b and [int(a[f"sum_{k + 1}"]) for k in range(4)] == [sum(int(h[16 * k:16 * k + 16], 16) for h in hashes) for k in range(4)]
    assert a != FS.table_fingerprint(spark.createDataFrame(rows[1:], "i int, t string")).first()
    assert FS.table_fingerprint(spark.createDataFrame([], "i int")).first()["row_count"] == 0


def test_the_first_readable_source_is_taken(spark):
    folder = tempfile.mkdtemp(prefix="hl-sources-")
    os.mkdir(f"{folder}/bare")
    os.mkdir(f"{folder}/broken")
    with open(f"{folder}/broken/part-0.parquet", "wb") as fh:
        fh.write(b"this is no parquet file at all")
    spark.range(0).write.parquet(f"{folder}/empty")
    spark.range(3).write.parquet(f"{folder}/good")
    passed = [f"{folder}/{n}" for n in ("absent", "bare", "broken", "empty")]
    found, path = FS.first_readable(spark, [*passed, f"{folder}/good", f"{folder}/absent"])
    assert path == f"{folder}/good" and found.count() == 3
    with pytest.raises(FileNotFoundError):
        FS.first_readable(spark, passed)


def test_answers_carry_what_they_rest_on(spark):
    df = spark.createDataFrame(
        [(str(i), "Ann" if i % 3 else "Bob", f"2024-0{1 + i % 4}-03", "Joined" if i % 2 else "Pending") for i in range(40)],
        ["candidate_id", "recruiter", "application_date", "joining_status"])
    asked = ["Who is the best recruiter?", "Which client is hardest?", "candidates stuck more than 20 days", "Can we make 250 hires?",
             "Why are hires declining?", "Where is the funnel bottleneck?", "hello", None]
    questions = spark.createDataFrame(list(enumerate(asked)), "no int, question string")
    rows = {r.no: r for r in QS.full_answers(questions, df, "application_date", "2024-06-01").collect()}
    assert len(rows[0].evidence) == 1 and rows[0].entities == [rows[0].entity] and rows[0].evidence[0].text == rows[0].entity
    assert rows[1].answer == "No client data available." and rows[1].evidence == [] and rows[1].metrics == {}
    assert rows[2].metrics == {"threshold_days": 20.0, "stuck_count": 40.0} and rows[2].evidence[0].value == 40.0
    assert rows[3].metrics["target"] == 250.0 and [e.metric for e in rows[3].evidence] == ["expected_joins_mid", "gap_high"]
    assert rows[4].metrics == {"joined": 20.0} and rows[4].evidence[0].comparison is not None
    assert rows[5].evidence[0].detail.endswith("%") and rows[5].entities == []
    assert all(rows[n].evidence == [] and rows[n].entities == [] and rows[n].metrics == {} for n in (6, 7))
    flat = QS.evidence_rows(QS.full_answers(questions, df, "application_date", "2024-06-01"), ["no"]).collect()
    assert len(flat) == 9 and sum(r.metric is None for r in flat) == 3
