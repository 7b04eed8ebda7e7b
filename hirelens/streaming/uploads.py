"""Structured Streaming ingest of application uploads.

Uploads arrive as CSV files in a landing folder.  The header layout is known
up front (the first upload, or a declared list of headers), so the column
mapping is planned once on the driver and every micro-batch runs the same
narrow normalisation as the batch path.  Two sinks:

* ``write_normalized`` appends the canonical rows to a parquet table
  (exactly-once through the checkpoint in the shared folder);
* ``kpis_by_stream`` keeps per-dimension funnel KPIs up to date: the KPI
  aggregate is only ``count``/``count_if``/``avg``, which Spark maintains
  incrementally in the state store, so each batch touches only its new rows.

No watermark is needed: the KPI state is one row per dimension value (bounded
by the number of recruiters/clients/...), not per event time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest as IN
from ..operators import kpis as K
from ..sources.files import csv_options, present


def upload_schema(headers: list[str]) -> T.StructType:
    """All-string schema for an upload layout (values are typed during normalisation)."""
    return T.StructType([T.StructField(h, T.StringType(), True) for h in headers])


def read_uploads(spark: SparkSession, landing_dir: str, headers: list[str], sep: str = ",",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming CSV source over the landing folder (no inference: every field is text).

    Cells are read as ``read_csv_flexible`` reads them: quotes, line breaks in cells, NA words.
    """
    reader = spark.readStream.schema(upload_schema(headers)).options(**csv_options(sep, True), header=True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(landing_dir).select(*[present(h).alias(h) for h in headers])


def normalized_stream(raw: DataFrame, overrides: dict[str, str] | None = None) -> IN.Normalized:
    """N13 on a stream: header mapping from the declared layout, value cleanup per row."""
    return IN.normalize_all(raw, overrides)


def write_normalized(stream: DataFrame, out_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Append the canonical rows to parquet; a restart with the same ``checkpoint`` folder appends none again."""
    w = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def kpis_by_stream(stream: DataFrame, key: str, out_path: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """A3 maintained incrementally per dimension value, published under ``out_path``.

    ``complete`` mode re-emits the (small) per-group result each batch; the state holds one
    aggregation buffer per group.  Each batch is a partition of its own (``kpi_batch``), written
    by the executors and visible once Spark commits it; a batch that is run again overwrites its own.
    """
    grouped = K.group_kpis_by_key(stream, key)

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/kpi_batch={number}")

    w = grouped.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("complete")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_kpis(spark: SparkSession, out_path: str) -> DataFrame:
    """The result of the last batch that ``kpis_by_stream`` committed."""
    batches = spark.read.parquet(out_path)
    last = batches.agg(F.max("kpi_batch")).first()[0]
    return batches.where(F.col("kpi_batch") == F.lit(last)).drop("kpi_batch")
