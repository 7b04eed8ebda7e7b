"""Date parsing and period labels as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted text layouts, tried in order (ISO first).
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy/M/d",
    "M/d/yyyy",
    "d-M-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
)


def parse_date_col(df: DataFrame, name: str) -> Column:
    """The column as DATE: typed dates pass through, text is parsed with ``DATE_FORMATS``."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)).cast("date") for fmt in DATE_FORMATS])


@dataclass(frozen=True)
class Layout:
    """How a column writes its dates: the shape of the day (a regular expression) and its Spark pattern."""

    name: str
    shape: str
    pattern: str


_NAMED = r"[A-Za-z]{3,9}"
# Layouts a column is tried on; of layouts that fit as many values the earlier is taken.
LAYOUTS = (
    Layout("iso", r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    Layout("year_slash", r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    Layout("compact", r"\d{8}", "yyyyMMdd"),
    Layout("month_first", r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    Layout("day_first", r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    Layout("month_first_dash", r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    Layout("day_first_dash", r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    Layout("day_first_dot", r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    Layout("day_short_month", rf"\d{{1,2}} {_NAMED} \d{{4}}", "d MMM yyyy"),
    Layout("day_long_month", rf"\d{{1,2}} {_NAMED} \d{{4}}", "d MMMM yyyy"),
    Layout("day_dash_month", rf"\d{{1,2}}-{_NAMED}-\d{{4}}", "d-MMM-yyyy"),
    Layout("short_month_day", rf"{_NAMED} \d{{1,2}}, \d{{4}}", "MMM d, yyyy"),
    Layout("long_month_day", rf"{_NAMED} \d{{1,2}}, \d{{4}}", "MMMM d, yyyy"),
)
# a time of day may follow, with an offset; the day is the one that is written, whatever the offset
TIME_OF_DAY = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])? ?(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"


def layout_date(text: Column, layout: Layout) -> Column:
    """The day of a value written in ``layout``, else NULL; surrounding white space does not count."""
    day = F.regexp_extract(text.cast("string"), rf"^\s*({layout.shape}){TIME_OF_DAY}\s*$", 1)
    return F.try_to_timestamp(F.when(day != "", F.initcap(day)), F.lit(layout.pattern)).cast("date")


def infer_layouts(df: DataFrame, names: list[str]) -> dict[str, Layout | None]:
    """The layout that most values of each text column are written in; None where no value fits any.

    One aggregate over all rows counts the values of every column that fit each layout.
    """
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return {}
    counts = [[F.count(layout_date(F.col(f"`{c}`"), x)) for x in LAYOUTS] for c in text]
    row = df.agg(F.array(*[F.array(*c) for c in counts]).alias("votes")).first()["votes"]
    best = {c: max(range(len(LAYOUTS)), key=lambda k: (votes[k], -k)) for c, votes in zip(text, row)}
    return {c: LAYOUTS[best[c]] if votes[best[c]] else None for c, votes in zip(text, row)}


def period_label(d: Column, freq: str) -> Column:
    """D -> yyyy-MM-dd; W -> 'monday/sunday'; anything else -> yyyy-MM (monthly)."""
    if freq == "D":
        return F.date_format(d, "yyyy-MM-dd")
    if freq == "W":
        start = F.date_trunc("week", d).cast("date")
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    return F.date_format(d, "yyyy-MM")


def aging_days(d: Column, as_of: str) -> Column:
    """Whole days from the date to the as-of date (negative for future dates)."""
    return F.datediff(F.lit(as_of).cast("date"), d)
