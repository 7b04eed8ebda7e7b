"""Scalar Column helpers shared by every operator (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE_WS = r"^\s+|\s+$"
# a numeric literal: optional sign, digits with optional fraction, optional exponent
NUMERIC_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def col_or_blank(df_columns: list[str], name: str | None) -> Column:
    """The column as text, or an empty string when the column is absent."""
    if not name or name not in df_columns:
        return F.lit("")
    return F.col(f"`{name}`").cast("string")


# the characters of the regex class \s: space, tab, newline, vertical tab, form feed, carriage return
_WS_CHARS = " \t\n\x0b\f\r"


def strip_ws(c: Column) -> Column:
    """Strip surrounding whitespace (the \\s set, not only spaces) without a regex."""
    return F.btrim(c.cast("string"), F.lit(_WS_CHARS))


def norm(c: Column) -> Column:
    """null -> '' and strip surrounding whitespace (tabs/newlines too, unlike ``trim``)."""
    return F.coalesce(strip_ws(c), F.lit(""))


def norm_lower(c: Column) -> Column:
    return F.lower(norm(c))


def combined_status(status: Column, result: Column) -> Column:
    """Result wins when non-blank, else status; trimmed and lower-cased."""
    r = norm(result)
    return F.lower(F.when(r != "", r).otherwise(norm(status)))


def pct(num: Column, den: Column) -> Column:
    """num/den*100, 0.0 when the denominator is 0 (guarded for ANSI mode)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den * 100)


def pct2(num: Column, den: Column) -> Column:
    return F.round(pct(num, den), 2)


def round_dec(x: Column, digits: int) -> Column:
    """Round half-up on the decimal value (via DECIMAL(38,12)), identical in Spark and SQL engines.

    Plain double rounding differs between engines at ties of weighted sums
    (e.g. 77.475); going through a fixed-scale decimal makes the result exact.
    """
    return F.round(x.cast("decimal(38,12)"), digits).cast("double")


def fmt1(x: Column) -> Column:
    """One-decimal display text: the value rounded half-up to 1 dp, as text."""
    return round_dec(x, 1).cast("string")


def fmt0(x: Column) -> Column:
    """Whole-number display text (rounded half-up), no separators."""
    return round_dec(x, 0).cast("long").cast("string")


def fmt_int(x: Column) -> Column:
    """Integer with thousands separators (1,234)."""
    return F.format_number(x.cast("long"), 0)


def safe_pct_change(current: Column, previous: Column) -> Column:
    """NULL when previous < 1, else the change in percent rounded to 2 dp."""
    return F.when(previous < 1, F.lit(None).cast("double")).otherwise(
        F.round((current - previous) / previous * 100, 2))


def parse_number(c: Column) -> Column:
    """Strict numeric parse: NULL unless the text is a plain number (rejects '12d', 'nan')."""
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.regexp_replace(s, _EDGE_WS, "").try_cast("double"))


def blank_to_null(c: Column) -> Column:
    """Whitespace-only text becomes NULL."""
    return F.when(c.rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(c)


def strip_underscore_columns(df: DataFrame) -> DataFrame:
    """Drop helper columns whose names start with '_' (export views)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def display(c: Column) -> Column:
    """Display text: NULL -> em dash."""
    return F.coalesce(c.cast("string"), F.lit("—"))


def format_pct(x: Column) -> Column:
    """C17: percentage display with two decimals, 'N/A' for NULL."""
    # format_string renders NULL as text, so NULL is handled before formatting
    return F.when(x.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.format_string("%.2f", round_dec(x, 2)), F.lit("%")))


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row frames (disjoint columns) into one row without a join.

    Each input is one aggregate row; they are stacked with ``unionByName`` and
    collapsed by ``first(ignorenulls)`` per column — a two-row global aggregate
    instead of a cartesian product.
    """
    names: list[str] = []
    for f in frames:
        names += [c for c in f.columns if c not in names]
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in names])
