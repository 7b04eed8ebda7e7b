"""What is known of a prepared upload (mapping, leftovers, profile) as one JSON text per upload, and back.

Texts are written by ``to_json`` and read by ``from_json`` with a declared schema, as columns:
a table of very many uploads is one narrow pass.  A text that does not parse is kept apart
with its key instead of becoming a row of NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = ("struct<health_score:double,row_count:bigint,column_count:bigint,duplicate_rows:bigint,missing_by_field:map<string,bigint>,"
           "invalid_dates:map<string,bigint>,invalid_numeric:map<string,bigint>,unmapped_columns:array<string>,issues:array<string>,"
           "normalization_notes:array<string>>")
BUNDLE = ("fingerprint string, source_name string, mapping map<string,string>, unmapped array<string>, low_confidence array<string>, "
          f"profile {PROFILE}, ingest_timings_ms map<string,double>")
_BROKEN = "__broken"


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema).fields]


def to_bundle(columns: dict[str, Column]) -> Column:
    """The JSON text of a bundle; parts not given are NULL, and empty lists and maps stay empty."""
    parts = [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _fields(BUNDLE)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def read_bundles(df: DataFrame, keys: list[str], text: str = "bundle") -> tuple[DataFrame, DataFrame]:
    """(bundles, broken): rows with their parts as columns, and (keys, text) of those that are no bundle.

    A NULL text, JSON of another form and a cut-off text are all broken.
    """
    parsed = df.select(*keys, F.col(text).alias("__text"), F.from_json(text, f"{BUNDLE}, {_BROKEN} string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("__b"))
    sound = F.col("__b").isNotNull() & F.col(f"__b.{_BROKEN}").isNull()
    return (parsed.where(sound).select(*keys, *[F.col(f"__b.{name}").alias(name) for name, _ in _fields(BUNDLE)]),
            parsed.where(~sound).select(*keys, F.col("__text").alias(text)))


def catalogue_bundles(mapped: DataFrame) -> DataFrame:
    """(upload_id, bundle): one bundle per upload of a mapped catalogue (upload_id, position, header, field, how).

    The headers of one upload are few (its columns), so each is one small group.
    """
    entry = F.when(F.col("field").isNotNull(), F.struct(F.col("header").alias("key"), F.col("field").alias("value")))

    def headers(condition: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(condition, F.struct("position", "header"))))
        return F.transform(listed, lambda s: s["header"])

    whole = mapped.groupBy("upload_id").agg(F.map_from_entries(F.collect_list(entry)).alias("mapping"),
                                            headers(F.col("field").isNull()).alias("unmapped"), headers(F.col("how") == "fuzzy").alias("low"))
    return whole.select("upload_id", to_bundle({
        "source_name": F.concat(F.lit("upload-"), F.col("upload_id").cast("string")), "mapping": F.col("mapping"),
        "unmapped": F.col("unmapped"), "low_confidence": F.col("low")}).alias("bundle"))
