"""File sources and sinks: delimiter-sniffing CSV, parquet round trip, fingerprints, reports."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE_DELIMITERS = (",", ";", "\t", "|")

# error conditions of Spark for a dataset that is absent, empty or broken
UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE")

# Cells that count as missing, besides empty ones.
NA_WORDS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
            "NaN", "None", "n/a", "nan", "null")


def sniff_delimiter(lines: list[str]) -> str:
    """Pick the delimiter that splits the sample lines into the same (>1) number of fields.

    Delimiters inside quotes do not count.  Ties go to the delimiter with more fields,
    then to the list order; ',' by default.
    """
    best, best_n = ",", 0
    sample = [re.sub('"(?:[^"]|"")*"', "", ln) for ln in lines if ln.strip()]
    if not sample:
        return best
    for d in CANDIDATE_DELIMITERS:
        counts = {ln.count(d) for ln in sample}
        if len(counts) == 1:
            n = counts.pop()
            if n > best_n:
                best, best_n = d, n
    return best


def header_names(cells: list[str | None]) -> list[str]:
    """One name a column: a blank header is ``Unnamed: <place>``, the n-th repeat of one gets ``.n``."""
    names: list[str] = []
    for place, cell in enumerate(cells):
        plain = cell or f"Unnamed: {place}"
        name, n = plain, 0
        while name in names:
            n += 1
            name = f"{plain}.{n}"
        names.append(name)
    return names


def csv_options(sep: str, multi_line: bool) -> dict:
    """Options under which batch and stream read the cells of a file alike."""
    return {"sep": sep, "encoding": "UTF-8", "quote": '"', "escape": '"', "multiLine": multi_line,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE"}


def present(name: str) -> Column:
    """A cell, or NULL where it is empty or one of ``NA_WORDS``."""
    return F.when(~F.col(f"`{name}`").isin("", *NA_WORDS), F.col(f"`{name}`"))


def read_csv_flexible(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All-string CSV read with a sniffed delimiter (UTF-8; BOM stripped from the header).

    Quoted cells may hold delimiters, doubled quotes and line breaks; empty cells and
    ``NA_WORDS`` read as NULL.  Columns are taken by position, with ``header_names``.
    Only the first 5 lines travel to the driver to choose the delimiter, and the header
    row; the scan itself is a normal parallel CSV read without schema inference.  Line
    breaks in cells mean that a file is read by one task: set ``multi_line=False`` for
    very large files that hold none, and Spark splits them.
    """
    head = [r.value for r in spark.read.text(path).limit(5).collect()]
    if head:
        head[0] = head[0].lstrip("\ufeff")
    options = csv_options(sniff_delimiter(head), multi_line)
    header = spark.read.options(**options).csv(path).first()
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    names = header_names([(c or "").lstrip("\ufeff") for c in header])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = spark.read.options(**options, header=True).schema(schema).csv(path)
    return cells.select(*[present(f"c{i}").alias(name) for i, name in enumerate(names)])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Write with header, quotes doubled inside quoted cells, keeping surrounding whitespace in values."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def parquet_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Persist the normalised frame as parquet and continue from the written table.

    Reading back from the shared checkpoint folder also cuts the lineage, so a
    lost executor recomputes from the parquet files, not from the raw upload.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


WHOLE_BYTES = 64 << 20  # files up to this size are hashed as one value by built-in functions


def content_fingerprint(content: Column, name: Column, extra: Column | str = "") -> Column:
    """SHA-256 over the bytes of ``content`` followed by ``name|size|extra``; a NULL content counts as empty."""
    content = F.coalesce(content, F.lit(b""))
    extra = F.lit(extra) if isinstance(extra, str) else extra
    label = F.concat_ws("|", name, F.octet_length(content).cast("string"), extra)
    return F.sha2(F.concat(content, F.encode(label, "UTF-8")), 256)


def _store_uri(path: str) -> str:
    """The address of a file as pyarrow names its store."""
    return re.sub("^s3[an]:", "s3:", path)


def file_fingerprints(spark: SparkSession, pattern: str, extra: str = "", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 over each file's bytes followed by ``name|size|extra`` (one row per file).

    Files of at most ``whole_bytes`` come through the ``binaryFile`` source, on any store that
    Spark reads, and are hashed by built-in functions.  The length filter is pushed into the
    source, so larger files are only listed there; each of those is hashed inside a task in
    8 MB pieces, because a value of that size would not fit an executor.  Spark's file sources
    pass over files of no bytes: those give no row.
    """
    files = spark.read.format("binaryFile").load(pattern)
    name = F.element_at(F.split("path", "/"), -1)
    small = files.where(F.col("length") <= whole_bytes).select(
        name.alias("file_name"), F.col("length").alias("size_bytes"), content_fingerprint(F.col("content"), name, extra).alias("fingerprint"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    if large.isEmpty():
        return small

    def hash_files(batches):
        import hashlib

        import pandas as pd
        import pyarrow.fs as pafs

        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                fs, inner = pafs.FileSystem.from_uri(_store_uri(path))
                h = hashlib.sha256()
                with fs.open_input_stream(inner) as fh:
                    while chunk := fh.read(8 << 20):
                        h.update(chunk)
                name = path.rstrip("/").rsplit("/", 1)[-1]
                h.update(f"{name}|{int(length)}|{extra}".encode())
                rows.append((name, int(length), h.hexdigest()))
            yield pd.DataFrame(rows, columns=["file_name", "size_bytes", "fingerprint"])

    return small.unionByName(large.repartition(F.col("path")).mapInPandas(hash_files, "file_name string, size_bytes bigint, fingerprint string"))


def _conditions(error: Exception) -> list[str]:
    """The error conditions that Spark names for an error and its causes."""
    if isinstance(error, PySparkException):
        return [error.getCondition() or ""]
    found, cause = [], error.java_exception
    while cause is not None:
        try:
            found.append(cause.getCondition() or "")
        except Py4JError:  # not one of Spark's own errors
            pass
        cause = cause.getCause()
    return found


def first_readable(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, str]:
    """(table, path) of the first Parquet dataset of ``paths`` that is there, is readable and has rows.

    Spark's own listing and footer reading decide, so any store will do.  Absent paths, folders
    without data files, broken files and tables without rows are passed over; other errors are raised.
    """
    for path in paths:
        try:
            found = spark.read.parquet(path)
            if not found.isEmpty():
                return found, path
        except (PySparkException, Py4JJavaError) as e:
            if not any(c.split(".")[0] in UNREADABLE for c in _conditions(e)):
                raise
    raise FileNotFoundError(f"none of {paths} is a readable table with rows")


def row_fingerprint(df: DataFrame, sep: str = "|") -> Column:
    """SHA-256 of the row's values as text (NULL -> empty) joined by ``sep``."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """S8 for tables: row count, order-independent sums of the four 64-bit slices of all row hashes, and their SHA-256.

    Sums (not XOR) keep duplicate rows visible; they are decimals, so they cannot overflow, and
    partial sums combine on the map side.
    """
    h = df.select(row_fingerprint(df).alias("h"))
    slices = [F.sum(F.conv(F.substring("h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"sum_{k + 1}")
              for k in range(4)]
    sums = h.agg(F.count(F.lit(1)).alias("row_count"), *slices)
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[F.coalesce(F.col(f"sum_{k}"), F.lit(0)).cast("string") for k in range(1, 5)])
    return sums.withColumn("fingerprint", F.sha2(text, 256))


def save_reports(reports: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One header CSV per report (single file each: reports are small grouped frames)."""
    paths = []
    for name, frame in reports.items():
        p = os.path.join(out_dir, name)
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(p)
        paths.append(p)
    return paths


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A written report read back as all-string columns."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def kpi_lookup(report: DataFrame, default: float = 0.0) -> DataFrame:
    """S6 ``get_kpi`` for every metric of a (metric, value) report: the value as a number,
    or ``default`` when it is missing, NULL or not numeric."""
    from ..functions.text import parse_number

    return report.select(F.col("metric"), F.coalesce(parse_number(F.col("value")), F.lit(float(default)))
                         .alias("value"))
