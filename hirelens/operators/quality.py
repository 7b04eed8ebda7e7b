"""Data quality: duplicates, missing values, invalid dates/numbers, health score, validation.

All column statistics come from ONE aggregate row (``count_if`` per column);
the duplicate-row count is the one full-row shuffle, and it is skew-safe:
identical rows are combined map-side by the partial aggregate before the
exchange, so a row repeated a billion times ships one partial count per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import parse_date_col
from ..functions.text import fmt_int, one_row, parse_number, pct, round_dec
from .ingest import RAW, without_raw


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def duplicate_rows(df: DataFrame, hashed: bool = False) -> DataFrame:
    """Q2: rows beyond the first of each identical row (NULLs compare equal).

    Exact by default: the grouping key is the whole row.  ``hashed=True`` groups on
    a 128-bit row fingerprint (xxhash64 plus two differently seeded 32-bit murmur3
    hashes) instead, so the shuffle carries 16 bytes per distinct row rather than
    every column — for very wide or very large tables where a tiny collision
    chance is acceptable.
    """
    if hashed:
        cols = [_q(c) for c in df.columns]
        keys = [F.xxhash64(*cols).alias("_h1"), F.hash(*cols).cast("long").alias("_h2a"),
                F.hash(F.lit("salt"), *cols).cast("long").alias("_h2b")]
        grouped = df.select(*keys).groupBy("_h1", "_h2a", "_h2b").agg(F.count(F.lit(1)).alias("_n"))
    else:
        grouped = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def id_quality(df: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Q3: missing ids and duplicate id values (non-null count minus distinct)."""
    c = _q(id_col).cast("string")
    return df.agg(F.count_if(_q(id_col).isNull()).alias("missing_ids"),
                  (F.count(c) - F.countDistinct(c)).alias("duplicate_ids"))


def _invalid_date(df: DataFrame, name: str) -> Column:
    return F.count(_q(name)) - F.count(parse_date_col(df, name))


def _invalid_number(df: DataFrame, name: str) -> Column:
    """Values that were there before the number was parsed and are not after; without them those that do not parse."""
    if RAW + name in df.columns:
        return F.count(_q(RAW + name)) - F.count(_q(name))
    return F.count(_q(name)) - F.count(parse_number(_q(name)))


def _own(df: DataFrame) -> list[str]:
    """The columns of the upload itself."""
    return [c for c in df.columns if not c.startswith(RAW)]


def invalid_dates(df: DataFrame) -> DataFrame:
    """Q4: per date field, non-null values that do not parse (fields with >0 only)."""
    fields = [c for c in S.DATE_FIELDS if c in df.columns]
    return _field_counts(df, {c: _invalid_date(df, c) for c in fields}, "invalid")


def invalid_numeric(df: DataFrame) -> DataFrame:
    """Q5: per numeric field, non-null values that do not become a number (fields with >0 only).

    Counted on ``Normalized.with_raw``, where a salary counts by its cleaned value; else on plain numbers.
    """
    fields = [c for c in S.NUMERIC_FIELDS if c in df.columns]
    return _field_counts(df, {c: _invalid_number(df, c) for c in fields}, "invalid")


def _field_counts(df: DataFrame, exprs: dict[str, Column], value_name: str) -> DataFrame:
    if not exprs:
        return df.sparkSession.createDataFrame([], f"field string, {value_name} long")
    row = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs.values())])
    arr = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"c{i}").cast("long").alias(value_name))
                    for i, n in enumerate(exprs)])
    # filter inside the array (higher-order function) rather than a Filter above the Generate
    return row.select(F.inline(F.filter(arr, lambda x: x[value_name] > 0)))


def missing_by_field(df: DataFrame) -> DataFrame:
    """Q6: NULL count per column (columns with >0 only)."""
    return _field_counts(df, {c: F.count_if(_q(c).isNull()) for c in df.columns}, "missing")


def missing_report(df: DataFrame, col: dict | None = None) -> DataFrame:
    """Q7: missing and missing % (2 dp) per recognised field, including zeros."""
    cm = S.build_col_map(df.columns) if col is None else col
    fields = []
    for _, c in cm.items():
        if c and c in df.columns and c not in fields:
            fields.append(c)
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(_q(c).isNull()).alias(f"m{i}") for i, c in enumerate(fields)])
    arr = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m{i}").cast("long").alias("missing"),
                             F.round(pct(F.col(f"m{i}"), F.col("_rows")), 2).alias("missing_pct"))
                    for i, c in enumerate(fields)])
    return row.select(F.inline(arr))


def _repeats(df: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Duplicate rows and duplicate ids as one row: identical rows are counted, then the ids over these counts.

    Both counts are plain sums over partial aggregates of one scan; no id has a row of counters.
    """
    names = df.columns
    rows = df.groupBy(*[_q(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    if id_col not in names:
        return rows.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    ids = rows.groupBy(_q(id_col).cast("string").alias("_id")).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") - 1).alias("_again"))
    return ids.agg(F.coalesce(F.sum("_again"), F.lit(0)).cast("long").alias("duplicate_rows"),
                   F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_all") - 1)), F.lit(0)).cast("long").alias("duplicate_ids"))


def profile_stats(df: DataFrame) -> DataFrame:
    """One-row statistics used by the health score, validation and profile: one scan, and one for the duplicates."""
    own = _own(df)
    dates = [c for c in S.DATE_FIELDS if c in own]
    nums = [c for c in S.NUMERIC_FIELDS if c in own]
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(_q(c).isNull()).alias(f"miss__{c}") for c in own],
        *[_invalid_date(df, c).alias(f"bad_date__{c}") for c in dates],
        *[_invalid_number(df, c).alias(f"bad_num__{c}") for c in nums],
        *([F.count_if(_q("candidate_id").isNull()).alias("missing_ids")] if "candidate_id" in own else []),
    )
    return one_row(stats, _repeats(without_raw(df)))


def profile(df: DataFrame, mapping: dict[str, str], unmapped: list[str] | None = None, low_confidence: list[str] | None = None) -> DataFrame:
    """Q8 in full: health score, counts, missing and invalid values by field (maps), unmapped columns, issues and notes."""
    st = profile_stats(df)
    score = _health(st, df, unmapped, low_confidence)
    report = _report(st, df, mapping, unmapped, low_confidence)

    def by_field(prefix: str, fields: list[str]) -> Column:
        counts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{prefix}__{c}").cast("long").alias("n")) for c in fields]) \
            .cast("array<struct<field:string,n:bigint>>")
        return F.map_from_entries(F.filter(counts, lambda x: x.n > 0))

    own = _own(df)
    return st.select(
        *[score[c].alias(c) for c in ("health_score", "row_count", "column_count", "duplicate_rows")],
        by_field("miss", own).alias("missing_by_field"),
        by_field("bad_date", [c for c in S.DATE_FIELDS if c in own]).alias("invalid_dates"),
        by_field("bad_num", [c for c in S.NUMERIC_FIELDS if c in own]).alias("invalid_numeric"),
        report["unmapped_columns"].alias("unmapped_columns"), score["issues"].alias("issues"),
        report["warnings"].alias("normalization_notes"))


def health_score(df: DataFrame, unmapped: list[str] | None = None,
                 low_confidence: list[str] | None = None) -> DataFrame:
    """Q8: 100 minus capped penalties for duplicates, missing key fields, invalid values,
    unmapped and fuzzy-mapped columns; floored at 0, 1 dp."""
    st = profile_stats(df)
    return st.select(*[c.alias(n) for n, c in _health(st, df, unmapped, low_confidence).items()])


def _health(st: DataFrame, df: DataFrame, unmapped: list[str] | None, low_confidence: list[str] | None) -> dict[str, Column]:
    """The columns of ``health_score`` over the one-row statistics ``st`` of ``df``."""
    unmapped, low_confidence = list(unmapped or []), list(low_confidence or [])
    rows = F.greatest(F.col("row_count"), F.lit(1))

    def share(c):
        return c / rows * 100

    penalty = F.least(F.lit(25.0), share(F.col("duplicate_rows")) * 0.5)
    for c in ("candidate_id", "interview_status", "offer_status"):
        if c in df.columns:
            penalty = penalty + F.least(F.lit(10.0), share(F.col(f"miss__{c}")) * 0.3)
    for c in [c for c in S.DATE_FIELDS if c in df.columns]:
        penalty = penalty + F.least(F.lit(8.0), share(F.col(f"bad_date__{c}")) * 0.4)
    for c in [c for c in S.NUMERIC_FIELDS if c in df.columns]:
        penalty = penalty + F.least(F.lit(5.0), share(F.col(f"bad_num__{c}")) * 0.3)
    fixed = min(10, 2 * len(unmapped)) + min(5, len(low_confidence))
    score = F.greatest(F.lit(0.0), round_dec(F.lit(100.0) - penalty - F.lit(float(fixed)), 1))
    issues = [F.when(F.col("duplicate_rows") > 0, F.concat(fmt_int(F.col("duplicate_rows")), F.lit(" duplicate rows")))]
    for c in [c for c in S.DATE_FIELDS if c in df.columns]:
        issues.append(F.when(F.col(f"bad_date__{c}") > 0,
                             F.concat(F.col(f"bad_date__{c}").cast("string"), F.lit(f" invalid {S.DISPLAY_NAMES[c]}"))))
    if unmapped:
        issues.append(F.lit(f"{len(unmapped)} unmapped columns"))
    return {
        "health_score": score,
        "row_count": F.col("row_count").cast("long"),
        "column_count": F.lit(len(_own(df))).cast("long"),
        "duplicate_rows": F.col("duplicate_rows"),
        "issues": F.filter(F.array(*issues).cast("array<string>"), lambda x: x.isNotNull()),
    }


def validation_report(df: DataFrame, mapping: dict[str, str], unmapped: list[str] | None = None,
                      low_confidence: list[str] | None = None) -> DataFrame:
    """Q1 (+Q9, Q10): errors, warnings and counts for a normalised upload, as one row."""
    st = profile_stats(df)
    return st.select(*[c.alias(n) for n, c in _report(st, df, mapping, unmapped, low_confidence).items()])


def _report(st: DataFrame, df: DataFrame, mapping: dict[str, str], unmapped: list[str] | None,
            low_confidence: list[str] | None) -> dict[str, Column]:
    """The columns of ``validation_report`` over the one-row statistics ``st`` of ``df``."""
    unmapped, low_confidence = list(unmapped or []), list(low_confidence or [])
    recognized = [c for c in S.CANONICAL_FIELDS if c in df.columns]
    status_fields = [c for c in S.STATUS_FIELDS if c in df.columns]
    errors = [F.when(F.col("row_count") < 1, F.lit("The dataset contains no candidate records."))]
    if not recognized:
        errors.append(F.lit("No recognizable recruitment columns were found. Use fields such as Candidate ID, "
                            "Interview Status, Offer Status, or Joining Status."))
    warns: list[Column] = []
    if "candidate_id" not in df.columns:
        warns.append(F.lit("Candidate ID was not detected. Candidate search and profile selection will be limited."))
    if not status_fields:
        warns.append(F.lit("No recruitment status field was detected. Funnel KPIs will be limited."))
    warns.append(F.when(F.col("duplicate_rows") > 0,
                        F.concat(fmt_int(F.col("duplicate_rows")), F.lit(" duplicate row(s) detected."))))
    if unmapped:
        warns.append(F.lit(f"{len(unmapped)} column(s) were not mapped automatically: "
                           + ", ".join(unmapped[:8]) + ("..." if len(unmapped) > 8 else "")))
    if low_confidence:
        warns.append(F.lit(f"{len(low_confidence)} column(s) mapped with fuzzy matching — review recommended: "
                           + ", ".join(low_confidence[:8])))
    if "candidate_id" in df.columns:
        warns.append(F.when(F.col("missing_ids") > 0, F.concat(fmt_int(F.col("missing_ids")),
                                                               F.lit(" record(s) have a missing Candidate ID."))))
        warns.append(F.when(F.col("duplicate_ids") > 0, F.concat(fmt_int(F.col("duplicate_ids")),
                                                                 F.lit(" duplicate Candidate ID value(s) detected."))))
    for c in [c for c in S.DATE_FIELDS if c in df.columns]:
        warns.append(F.when(F.col(f"bad_date__{c}") > 0, F.concat(
            fmt_int(F.col(f"bad_date__{c}")), F.lit(f" invalid {S.DISPLAY_NAMES[c].lower()} value(s) detected."))))
    if "salary_lpa" in df.columns:
        warns.append(F.when(F.col("bad_num__salary_lpa") > 0, F.concat(
            fmt_int(F.col("bad_num__salary_lpa")), F.lit(" salary value(s) could not be interpreted as numbers."))))
    err = F.filter(F.array(*errors), lambda x: x.isNotNull())
    return {
        "valid": (F.size(err) == 0),
        "errors": err,
        "warnings": F.filter(F.array(*warns), lambda x: x.isNotNull()),
        "rows": F.col("row_count").cast("long"),
        "columns": F.lit(len(_own(df))).cast("long"),
        "recognized_fields": F.array(*[F.lit(c) for c in recognized]).cast("array<string>"),
        "mapping": F.array(*[F.lit(f"{o} -> {c}") for o, c in mapping.items()]).cast("array<string>"),
        "unmapped_columns": F.array(*[F.lit(c) for c in unmapped]).cast("array<string>"),
        "low_confidence_columns": F.array(*[F.lit(c) for c in low_confidence]).cast("array<string>"),
        "duplicate_rows": F.col("duplicate_rows"),
        "mapped_count": F.lit(len(mapping)).cast("long"),
        "unmapped_count": F.lit(len(unmapped)).cast("long"),
    }
