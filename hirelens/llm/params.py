"""Production parameters of the queries that have no contract of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# weights at each level of the mixing tree, by name; names not given weigh 1
MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {},
}


def domain(source: str) -> Column:
    """The domain of a source: its number modulo 4 (d0 for sources without a number)."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % 4).cast("string"))
