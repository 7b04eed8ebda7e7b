"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` over the derived tables.

Every query reads the whole derived ``applications`` table (or the raw /
snapshot variants), so its work grows with the driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import infer_layouts
from ..operators import aging as AG
from ..operators import audit as AU
from ..operators import bundles as BU
from ..operators import filters as FL
from ..operators import ingest as IN
from ..operators import insights as INS
from ..operators import kpis as K
from ..operators import quality as QA
from ..operators import questions as QS
from ..operators import scorecards as SC
from ..operators import sqlview as SV
from ..operators import stages as ST
from ..operators import trends as TR
from ..session import scratch_path
from ..sources import files as FS
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import params as P

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.applications(spark, sf_dir)


# ---------------------------------------------------------------- KPIs

def _dim_query(dim: str) -> QueryFn:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return K.group_kpis_by_key(apps(spark, sf_dir), dim)
    fn.__name__ = f"kpis_by_{dim}"
    return fn


for _dim in K.DIMENSIONS:
    query(f"kpis_by_{_dim}")(_dim_query(_dim))


@query("kpis_total")
def kpis_total(spark, sf_dir):
    return K.compute_kpis(apps(spark, sf_dir))


@query("kpi_summary")
def kpi_summary(spark, sf_dir):
    return K.kpi_summary(K.compute_kpis(apps(spark, sf_dir)))


@query("kpis_all_dims")
def kpis_all_dims(spark, sf_dir):
    return K.kpis_all_dimensions(apps(spark, sf_dir))


@query("report_source")
def report_source(spark, sf_dir):
    return K.group_kpis_by_key(apps(spark, sf_dir), "source") \
            .withColumnRenamed("joining_rate_pct", "conversion_rate_pct") \
            .orderBy(F.col("conversion_rate_pct").desc())


@query("report_technology")
def report_technology(spark, sf_dir):
    return K.group_kpis_by_key(apps(spark, sf_dir), "technology") \
            .orderBy(F.col("average_salary").desc())


@query("funnel_stages")
def funnel_stages(spark, sf_dir):
    return K.funnel_stages(K.compute_kpis(apps(spark, sf_dir)))


@query("funnel_conversion")
def funnel_conversion(spark, sf_dir):
    return K.funnel_conversion(K.compute_kpis(apps(spark, sf_dir)))


@query("kpi_stage_counts")
def kpi_stage_counts(spark, sf_dir):
    return K.kpi_stage_counts(K.compute_kpis(apps(spark, sf_dir)))


@query("bottleneck")
def bottleneck(spark, sf_dir):
    return K.bottleneck(K.compute_kpis(apps(spark, sf_dir)))


# ---------------------------------------------------------------- filters, search, views (F*, A5-A7, A14)

@query("filter_in")
def filter_in(spark, sf_dir):
    a = apps(spark, sf_dir)
    return FL.filter_in(a, FL.resolve_filters(a, P.FILTERS))


@query("filter_all_selected")
def filter_all_selected(spark, sf_dir):
    a = apps(spark, sf_dir)
    every = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    sel = {"recruiter": FL.selection_for_query(every, every),
           "client": FL.selection_for_query(["BUILDING"], ["BUILDING", "MACHINERY"])}
    return FL.count_rows(a, FL.resolve_filters(a, sel))


@query("search_like")
def search_like(spark, sf_dir):
    return FL.search_like(apps(spark, sf_dir), P.SEARCH_TEXT)


@query("query_filtered")
def query_filtered(spark, sf_dir):
    a = apps(spark, sf_dir)
    cols = [c for c in ("candidate_id", "candidate_name", "recruiter", "client", "role",
                        "technology", "location", "source")]
    return FL.query_filtered(a, FL.resolve_filters(a, P.FILTERS), P.QUERY_SEARCH, cols,
                             P.QUERY_COLUMNS, P.QUERY_LIMIT, "candidate_id")


@query("count_rows")
def count_rows(spark, sf_dir):
    a = apps(spark, sf_dir)
    return FL.count_rows(a, FL.resolve_filters(a, P.FILTERS), P.SEARCH_TEXT,
                         ["candidate_name", "location", "source"])


@query("distinct_values")
def distinct_values(spark, sf_dir):
    return FL.distinct_values(apps(spark, sf_dir), "location")


@query("search_regex")
def search_regex(spark, sf_dir):
    return FL.search_regex(apps(spark, sf_dir), P.REGEX)


@query("list_candidates")
def list_candidates(spark, sf_dir):
    return FL.list_candidates(apps(spark, sf_dir), P.LIST_SEARCH, P.LIST_RECRUITER,
                              limit=500, order_col="application_date")


@query("candidate_lookup")
def candidate_lookup(spark, sf_dir):
    return FL.candidate_lookup(apps(spark, sf_dir), P.LOOKUP_ID)


@query("candidate_profile")
def candidate_profile(spark, sf_dir):
    return FL.candidate_profile(apps(spark, sf_dir), P.LOOKUP_ID)


@query("attention_queue")
def attention_queue(spark, sf_dir):
    return FL.attention_queue(apps(spark, sf_dir))


@query("interview_ops")
def interview_ops(spark, sf_dir):
    return FL.interview_ops(apps(spark, sf_dir))


@query("stage_filter")
def stage_filter(spark, sf_dir):
    out = FL.stage_filter(apps(spark, sf_dir), P.STAGE_DIMS, P.STAGE_LIST)
    return out.withColumnRenamed("_current_stage", "current_stage").withColumnRenamed("_action", "next_action")


@query("candidate_queue")
def candidate_queue(spark, sf_dir):
    return FL.candidate_queue(apps(spark, sf_dir))


@query("export_view")
def export_view(spark, sf_dir):
    return FL.export_view(ST.with_stage(apps(spark, sf_dir)))


@query("group_count")
def group_count(spark, sf_dir):
    a = apps(spark, sf_dir)
    return FL.group_count(a, "recruiter", FL.resolve_filters(a, {"client": ["BUILDING", "AUTOMOBILE"]}))


@query("interview_mix")
def interview_mix(spark, sf_dir):
    return FL.interview_mix(apps(spark, sf_dir))


@query("status_only_counts")
def status_only_counts(spark, sf_dir):
    return FL.status_only_counts(apps(spark, sf_dir))


# ---------------------------------------------------------------- stages

@query("current_stage")
def current_stage(spark, sf_dir):
    a = apps(spark, sf_dir)
    stage = ST.current_stage(a)
    return a.select("candidate_id", stage.alias("current_stage")) \
            .withColumn("stage_priority", ST.stage_priority(F.col("current_stage"))) \
            .withColumn("stage_tone", ST.stage_tone(F.col("current_stage")))


@query("next_action")
def next_action(spark, sf_dir):
    s = ST.with_stage(apps(spark, sf_dir))
    return s.select("candidate_id", F.col("_current_stage").alias("current_stage"),
                    F.col("_action").alias("next_action"))


@query("journey")
def journey(spark, sf_dir):
    return ST.journey(apps(spark, sf_dir))


@query("combined_status")
def combined_status(spark, sf_dir):
    a = apps(spark, sf_dir)
    o = K.stage_outcomes(a, K.resolve(a))
    return a.select("candidate_id", o["screening"].alias("screening_outcome"),
                    o["interview"].alias("interview_outcome"), o["offer"].alias("offer_outcome"),
                    o["joining"].alias("joining_outcome"))


@query("stage_counts")
def stage_counts(spark, sf_dir):
    return ST.stage_counts(apps(spark, sf_dir))


@query("ops_counters")
def ops_counters(spark, sf_dir):
    return ST.ops_counters(apps(spark, sf_dir))


# ---------------------------------------------------------------- aging

def _aged(spark, sf_dir):
    return AG.aging_summary(apps(spark, sf_dir), "application_date", P.AS_OF, P.THRESHOLDS)


@query("aging_summary")
def aging_summary(spark, sf_dir):
    return _aged(spark, sf_dir)


@query("aging_buckets")
def aging_buckets(spark, sf_dir):
    return AG.aging_buckets(_aged(spark, sf_dir))


@query("aging_risk")
def aging_risk(spark, sf_dir):
    return AG.aging_risk(_aged(spark, sf_dir))


@query("group_aging")
def group_aging(spark, sf_dir):
    return AG.group_aging(apps(spark, sf_dir), "recruiter", "application_date", P.AS_OF, P.THRESHOLDS)


# ---------------------------------------------------------------- time series

def _trend(freq):
    def fn(spark, sf_dir):
        return TR.trends(apps(spark, sf_dir), "application_date", freq)
    return fn


query("trends_month")(_trend("M"))
query("trends_week")(_trend("W"))
query("trends_day")(_trend("D"))


@query("last_two_periods")
def last_two_periods(spark, sf_dir):
    return TR.last_two_periods(apps(spark, sf_dir), "application_date", "M")


@query("period_comparison")
def period_comparison(spark, sf_dir):
    return TR.period_comparison(apps(spark, sf_dir), "application_date")


@query("forecast_joins")
def forecast_joins(spark, sf_dir):
    return TR.forecast_joins(apps(spark, sf_dir), "application_date")


@query("target_gap")
def target_gap(spark, sf_dir):
    return TR.target_gap(apps(spark, sf_dir), P.TARGET_HIRES, "application_date")


# ---------------------------------------------------------------- scorecards

@query("recruiter_scorecards")
def recruiter_scorecards(spark, sf_dir):
    return SC.recruiter_scorecards(apps(spark, sf_dir))


@query("recruiter_intelligence")
def recruiter_intelligence(spark, sf_dir):
    return SC.recruiter_intelligence(apps(spark, sf_dir), None, "application_date", P.AS_OF)


@query("client_intelligence")
def client_intelligence(spark, sf_dir):
    return SC.client_intelligence(apps(spark, sf_dir), None, "application_date", P.AS_OF)


@query("role_intelligence")
def role_intelligence(spark, sf_dir):
    return SC.role_intelligence(apps(spark, sf_dir), None, "application_date", P.AS_OF)


@query("source_intelligence")
def source_intelligence(spark, sf_dir):
    return SC.source_intelligence(apps(spark, sf_dir))


@query("recruiter_highlights")
def recruiter_highlights(spark, sf_dir):
    return SC.recruiter_highlights(
        SC.recruiter_intelligence(apps(spark, sf_dir), None, "application_date", P.AS_OF))


@query("best_source")
def best_source(spark, sf_dir):
    return SC.best_source(SC.source_intelligence(apps(spark, sf_dir)))


# ---------------------------------------------------------------- ingest and data quality (N*, Q*, S1, S2, S8)



def raw(spark, sf_dir):
    return FX.applications_raw(spark, sf_dir)


_NORMALIZED: dict[tuple, str] = {}


def normalized(spark, sf_dir, materialize: bool = True) -> IN.Normalized:
    """The normalised upload; by default written once per session to the shared checkpoint
    folder and read back, as the ingest job does (quality checks then scan plain parquet)."""
    n = IN.normalize_all(raw(spark, sf_dir))
    if materialize:
        key = (spark.sparkContext.applicationId, FX._source_signature(sf_dir))
        with FX.MATERIALIZE_LOCK:
            path = _NORMALIZED.get(key)
            if path is None:
                path = scratch_path(spark, "normalized")
                n.with_raw.write.mode("overwrite").parquet(path)
                _NORMALIZED[key] = path
        n.with_raw = spark.read.parquet(path)
        n.data = IN.without_raw(n.with_raw)
    return n


@query("normalize_all")
def normalize_all(spark, sf_dir):
    return normalized(spark, sf_dir, materialize=False).data


@query("drop_blank_rows")
def drop_blank_rows(spark, sf_dir):
    return IN.drop_blank_rows(raw(spark, sf_dir))


@query("clean_currency")
def clean_currency(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select(F.col("`Candidate ID`").alias("candidate_id"), F.col("CTC").alias("raw_value"),
                    IN.clean_currency(F.col("CTC")).alias("salary_lpa"))


@query("normalize_dates")
def normalize_dates(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select(F.col("`Candidate ID`").alias("candidate_id"), F.col("`Applied On`").alias("raw_value"),
                    IN.normalize_date_text(r, "Applied On").alias("application_date"))


@query("blank_to_null")
def blank_to_null(spark, sf_dir):
    r = raw(spark, sf_dir)
    from ..functions.text import blank_to_null as b2n
    return r.select(F.col("`Candidate ID`").alias("candidate_id"), b2n(F.col("`TA Owner`")).alias("recruiter"))


@query("clean_batch")
def clean_batch(spark, sf_dir):
    return IN.clean_batch(raw(spark, sf_dir))


@query("duplicate_rows")
def duplicate_rows(spark, sf_dir):
    return QA.duplicate_rows(normalized(spark, sf_dir).data)


@query("id_quality")
def id_quality(spark, sf_dir):
    return QA.id_quality(normalized(spark, sf_dir).data)


@query("invalid_dates")
def invalid_dates(spark, sf_dir):
    return QA.invalid_dates(normalized(spark, sf_dir).data)


@query("invalid_numeric")
def invalid_numeric(spark, sf_dir):
    return QA.invalid_numeric(normalized(spark, sf_dir).with_raw)


@query("missing_by_field")
def missing_by_field(spark, sf_dir):
    return QA.missing_by_field(normalized(spark, sf_dir).data)


@query("missing_report")
def missing_report(spark, sf_dir):
    return QA.missing_report(normalized(spark, sf_dir).data)


@query("health_score_data")
def health_score_data(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return QA.health_score(n.with_raw, n.unmapped, n.low_confidence)


@query("validation_report")
def validation_report(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return QA.validation_report(n.with_raw, n.mapping, n.unmapped, n.low_confidence)


@query("csv_flexible")
def csv_flexible(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    FS.write_csv(raw(spark, sf_dir), path, sep=";")
    return FS.read_csv_flexible(spark, path)


@query("parquet_roundtrip")
def parquet_roundtrip(spark, sf_dir):
    return FS.parquet_roundtrip(normalized(spark, sf_dir, materialize=False).data,
                                scratch_path(spark, "normalized"))


@query("fingerprint_files")
def fingerprint_files(spark, sf_dir):
    return FS.file_fingerprints(spark, f"{sf_dir.rstrip('/')}/*.parquet")


@query("fingerprint_pages")
def fingerprint_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size_bytes"), FS.content_fingerprint(
        F.col("html").cast("binary"), F.coalesce("url", F.lit("")), F.col("page_id").cast("string")).alias("fingerprint"))


@query("fingerprint_table")
def fingerprint_table(spark, sf_dir):
    return FS.table_fingerprint(apps(spark, sf_dir))


# ---------------------------------------------------------------- insights and executive view

@query("insights")
def insights(spark, sf_dir):
    return INS.insights(apps(spark, sf_dir))


@query("insight_cards")
def insight_cards(spark, sf_dir):
    return INS.insight_cards(INS.insights(apps(spark, sf_dir)))


@query("executive_findings")
def executive_findings(spark, sf_dir):
    a = apps(spark, sf_dir)
    return INS.executive_findings(K.compute_kpis(a), TR.period_comparison(a, "application_date"))


@query("health_score")
def health_score(spark, sf_dir):
    a = apps(spark, sf_dir)
    aged = AG.aging_summary(a, "application_date", P.AS_OF, P.THRESHOLDS)
    return INS.health_score(K.compute_kpis(a), AG.aging_risk(aged, INS.NO_AGED_SCORE), QA.health_score(a))


# ---------------------------------------------------------------- questions

def user_questions(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


@query("intent_tags")
def intent_tags(spark, sf_dir):
    return QS.tag_intents(user_questions(spark, sf_dir))


@query("answers")
def answers(spark, sf_dir):
    return QS.answers(user_questions(spark, sf_dir), apps(spark, sf_dir), "application_date", P.AS_OF,
                      P.THRESHOLDS)


@query("stuck_over_n")
def stuck_over_n(spark, sf_dir):
    th = spark.createDataFrame([(n,) for n in P.STUCK_DAYS], "threshold bigint")
    return QS.stuck_counts(apps(spark, sf_dir), th, "application_date", P.AS_OF)


# ---------------------------------------------------------------- change capture

@query("change_audit")
def change_audit(spark, sf_dir):
    return AU.change_audit(apps(spark, sf_dir), FX.applications_v2(spark, sf_dir))


@query("audit_history")
def audit_history(spark, sf_dir):
    audit = AU.change_audit(apps(spark, sf_dir), FX.applications_v2(spark, sf_dir))
    return AU.audit_history(audit, P.AUDIT_ID)


def _earlier_snapshot(spark, sf_dir):
    return apps(spark, sf_dir).filter(F.col("application_date") < F.lit(P.SNAPSHOT_BEFORE).cast("date"))


@query("append_validated")
def append_validated(spark, sf_dir):
    return AU.append_validated(_earlier_snapshot(spark, sf_dir), normalized(spark, sf_dir).data)


@query("import_if_new")
def import_if_new(spark, sf_dir):
    return AU.import_if_new(_earlier_snapshot(spark, sf_dir), normalized(spark, sf_dir).data)


# ---------------------------------------------------------------- legacy picks, report read-back, summary

@query("top_entities")
def top_entities(spark, sf_dir):
    return SC.top_entities(apps(spark, sf_dir))


@query("report_kpi_lookup")
def report_kpi_lookup(spark, sf_dir):
    path = scratch_path(spark, "kpi-summary")
    FS.save_reports({"kpi_summary": K.kpi_summary(K.compute_kpis(apps(spark, sf_dir)))
                     .select("metric", "value")}, path)
    return FS.kpi_lookup(FS.read_report(spark, f"{path}/kpi_summary"))


@query("database_summary")
def database_summary(spark, sf_dir):
    return AU.database_summary(apps(spark, sf_dir),
                               AU.change_audit(apps(spark, sf_dir), FX.applications_v2(spark, sf_dir)))


@query("fingerprint_rows")
def fingerprint_rows(spark, sf_dir):
    a = apps(spark, sf_dir)
    return a.select("candidate_id", FS.row_fingerprint(a).alias("row_sha256"))


@query("coerce_numeric")
def coerce_numeric(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select(F.col("`Candidate ID`").alias("candidate_id"), F.col("Notes").alias("raw_value"),
                    IN.coerce_numeric(r, "Notes").alias("value"))


# ---------------------------------------------------------------- uploads in other layouts, catalogues of uploads

def dated(spark, sf_dir):
    """The upload of other date layouts under its canonical names, and the layout of each date column."""
    rows = IN.drop_blank_rows(FX.dated_upload(spark, sf_dir))
    mapping, _, _ = IN.map_columns(list(rows.columns))
    rows = IN.rename_mapped(rows, mapping)
    return rows, infer_layouts(rows, ["application_date", "interview_date", "offer_date", "joining_date"])


@query("normalize_date_columns")
def normalize_date_columns(spark, sf_dir):
    rows, layouts = dated(spark, sf_dir)
    return rows.select("candidate_id", *[IN.normalize_date_text(rows, c, layouts).alias(c) for c in layouts])


@query("date_layouts")
def date_layouts(spark, sf_dir):
    rows, layouts = dated(spark, sf_dir)
    fit = [F.struct(F.lit(c).alias("field"), F.lit(x.name if x else None).cast("string").alias("layout"),
                    F.count(IN.parsed_date(rows, c, layouts)).alias("fitting")) for c, x in layouts.items()]
    return rows.agg(F.array(*fit).alias("fits")).select(F.inline("fits"))


@query("time_to_hire")
def time_to_hire(spark, sf_dir):
    rows, layouts = dated(spark, sf_dir)
    return rows.select("candidate_id", IN.time_to_hire(IN.parsed_date(rows, "application_date", layouts), IN.parsed_date(
        rows, "joining_date", layouts)).alias("time_to_hire_days"))


@query("clean_percent")
def clean_percent(spark, sf_dir):
    rows = FX.dated_upload(spark, sf_dir)
    return rows.select(F.col("`Candidate ID`").alias("candidate_id"), F.col("Match").alias("raw_value"),
                       IN.clean_percent(F.col("Match")).alias("value"))


@query("rejections")
def rejections(spark, sf_dir):
    rows = IN.drop_blank_rows(FX.dated_upload(spark, sf_dir))
    return FL.rejections(IN.rename_mapped(rows, IN.map_columns(list(rows.columns))[0]))


@query("drop_blank_lines")
def drop_blank_lines(spark, sf_dir):
    return IN.drop_blank_rows(FX.dated_upload(spark, sf_dir)).select(F.col("`Candidate ID`").alias("candidate_id"), "Match")


@query("header_normalize")
def header_normalize(spark, sf_dir):
    headers = FX.upload_catalogue(spark, sf_dir)
    return headers.select("upload_id", "position", "header", IN.header_normalize_col(F.col("header")).alias("normalized"))


@query("column_mapping")
def column_mapping(spark, sf_dir):
    return IN.map_catalogue(FX.upload_catalogue(spark, sf_dir))


@query("mapping_table")
def mapping_table(spark, sf_dir):
    return IN.catalogue_table(IN.map_catalogue(FX.upload_catalogue(spark, sf_dir)))


@query("data_profile")
def data_profile(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return _listed(QA.profile(n.with_raw, n.mapping, n.unmapped, n.low_confidence))


def _listed(profile):
    """A profile with its maps as sorted lists of ``field=count``."""
    def listed(c):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))).alias(c)

    maps = ("missing_by_field", "invalid_dates", "invalid_numeric")
    return profile.select(*[listed(c) if c in maps else F.col(c) for c in profile.columns])


# ---------------------------------------------------------------- statuses of every kind, questions of every rule

def mixed(spark, sf_dir):
    return FX.mixed_applications(spark, sf_dir)


@query("current_stage_mixed")
def current_stage_mixed(spark, sf_dir):
    a = mixed(spark, sf_dir)
    return a.select("candidate_id", ST.current_stage(a).alias("current_stage")) \
            .withColumn("stage_priority", ST.stage_priority(F.col("current_stage"))) \
            .withColumn("stage_tone", ST.stage_tone(F.col("current_stage")))


@query("next_action_mixed")
def next_action_mixed(spark, sf_dir):
    s = ST.with_stage(mixed(spark, sf_dir))
    return s.select("candidate_id", F.col("_current_stage").alias("current_stage"), F.col("_action").alias("next_action"))


@query("stage_counts_mixed")
def stage_counts_mixed(spark, sf_dir):
    return ST.stage_counts(mixed(spark, sf_dir))


@query("ops_counters_mixed")
def ops_counters_mixed(spark, sf_dir):
    return ST.ops_counters(mixed(spark, sf_dir))


@query("stage_filter_mixed")
def stage_filter_mixed(spark, sf_dir):
    out = FL.stage_filter(mixed(spark, sf_dir), P.STAGE_DIMS, P.STAGE_LIST)
    return out.withColumnRenamed("_current_stage", "current_stage").withColumnRenamed("_action", "next_action")


@query("candidate_queue_mixed")
def candidate_queue_mixed(spark, sf_dir):
    return FL.candidate_queue(mixed(spark, sf_dir))


@query("role_intelligence_mixed")
def role_intelligence_mixed(spark, sf_dir):
    return SC.role_intelligence(mixed(spark, sf_dir), None, "application_date", P.AS_OF)


@query("kpis_total_mixed")
def kpis_total_mixed(spark, sf_dir):
    return K.compute_kpis(mixed(spark, sf_dir))


@query("journey_mixed")
def journey_mixed(spark, sf_dir):
    return ST.journey(mixed(spark, sf_dir))


@query("intent_tags_formed")
def intent_tags_formed(spark, sf_dir):
    return QS.tag_intents(FX.formed_questions(spark, sf_dir))


@query("answers_formed")
def answers_formed(spark, sf_dir):
    return QS.answers(FX.formed_questions(spark, sf_dir), apps(spark, sf_dir), "application_date", P.AS_OF, P.THRESHOLDS)


def _full_answers(spark, sf_dir):
    return QS.full_answers(FX.formed_questions(spark, sf_dir), apps(spark, sf_dir), "application_date", P.AS_OF, P.THRESHOLDS)


@query("answer_evidence")
def answer_evidence(spark, sf_dir):
    return QS.evidence_rows(_full_answers(spark, sf_dir), ["conv_id", "turn"])


@query("answer_metrics")
def answer_metrics(spark, sf_dir):
    return QS.metric_rows(_full_answers(spark, sf_dir), ["conv_id", "turn"])


@query("executive_package")
def executive_package(spark, sf_dir):
    a = apps(spark, sf_dir)
    return INS.package_sections(INS.executive_package(a, "application_date", P.AS_OF, P.THRESHOLDS, QA.health_score(a)))


# ---------------------------------------------------------------- SQL over a view, bundles, source fallback

@query("view_filtered")
def view_filtered(spark, sf_dir):
    a = apps(spark, sf_dir)
    cm = K.resolve(a, None)
    return SV.TableView(a).filtered(FL.resolve_filters(a, P.FILTERS), P.QUERY_SEARCH, [cm[k] for k in FL.SEARCH_KEYS if cm.get(k)], P.QUERY_COLUMNS)


@query("view_count")
def view_count(spark, sf_dir):
    a = apps(spark, sf_dir)
    return SV.TableView(a).count({**FL.resolve_filters(a, P.FILTERS), "nope": ["x"]}, P.SEARCH_TEXT, ["candidate_name", "location", "source"])


@query("view_group_count")
def view_group_count(spark, sf_dir):
    return SV.TableView(apps(spark, sf_dir)).group_count("recruiter", {"client": ["BUILDING", "AUTOMOBILE"]})


@query("view_distinct")
def view_distinct(spark, sf_dir):
    return SV.TableView(apps(spark, sf_dir)).distinct_values("location")


def _bundles(spark, sf_dir):
    """The bundles of the upload catalogue, read back; those of every seventh upload are cut off in the middle."""
    made = BU.catalogue_bundles(IN.map_catalogue(FX.upload_catalogue(spark, sf_dir)))
    cut = F.expr("substr(bundle, 1, length(bundle) div 2)")
    return BU.read_bundles(made.withColumn("bundle", F.when(F.col("upload_id") % 7 == 0, cut).otherwise(F.col("bundle"))), ["upload_id"])


@query("bundle_mappings")
def bundle_mappings(spark, sf_dir):
    sound, _ = _bundles(spark, sf_dir)
    return sound.select("upload_id", "source_name", "unmapped", "low_confidence", F.explode_outer("mapping").alias("header", "field"))


@query("bundle_broken")
def bundle_broken(spark, sf_dir):
    _, broken = _bundles(spark, sf_dir)
    return broken.select("upload_id", F.col("bundle").isNotNull().alias("has_text"))


@query("bundle_profile")
def bundle_profile(spark, sf_dir):
    n = normalized(spark, sf_dir)
    found = QA.profile(n.with_raw, n.mapping, n.unmapped, n.low_confidence)
    text = found.select(F.lit(1).alias("no"), BU.to_bundle({"profile": F.struct(*found.columns)}).alias("bundle"))
    profile = BU.read_bundles(text, ["no"])[0].select("profile.*")
    return _listed(profile)


@query("source_fallback")
def source_fallback(spark, sf_dir):
    folder, empty = sf_dir.rstrip("/"), scratch_path(spark, "no-rows")
    read_table(spark, sf_dir, "orders").where("false").write.parquet(empty)
    orders, path = FS.first_readable(spark, [f"{folder}/cleaned_orders.parquet", empty, f"{folder}/orders.parquet"])
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders")) \
        .withColumn("source", F.lit(path.rsplit("/", 1)[-1]))


# ---------------------------------------------------------------- history over several snapshots

@query("change_history")
def change_history(spark, sf_dir):
    return AU.change_history(FX.snapshots(spark, sf_dir)).withColumn("changed_at", F.col("changed_at").cast("date"))


@query("audit_timeline")
def audit_timeline(spark, sf_dir):
    path = scratch_path(spark, "audit-log")
    found = scratch_path(spark, "audit-events")
    AU.change_history(FX.snapshots(spark, sf_dir)).write.parquet(found)  # the changes only, found once for both appends
    events = spark.read.parquet(found)
    AU.append_history(events, path)
    log = AU.append_history(events.where("snapshot_no = 3"), path)  # the last batch again
    return AU.newest_first(log, P.TIMELINE_IDS).withColumn("changed_at", F.col("changed_at").cast("date"))
