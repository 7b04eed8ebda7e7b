"""Streaming ingest equals the batch path on the same uploads."""

import os
import tempfile

from pyspark.sql import functions as F

from hirelens.operators import kpis as K
from hirelens.sources import files as FS
from hirelens.sources import fixtures as FX
from hirelens.streaming import uploads as UP
from tools.check_oracle import rows_key


def test_streaming_ingest_matches_batch(spark, small_dir):
    raw = FX.applications_raw(spark, small_dir)
    landing = tempfile.mkdtemp(prefix="hl-landing-")
    # two uploads arrive as separate files
    FS.write_csv(raw.filter(F.col("Notes").isin("0", "1")), os.path.join(landing, "u1"))
    FS.write_csv(raw.filter(~F.col("Notes").isin("0", "1")), os.path.join(landing, "u2"))

    batch = FS.read_csv_flexible(spark, f"{landing}/*")
    stream = UP.read_uploads(spark, f"{landing}/*", raw.columns)
    norm = UP.normalized_stream(stream)

    out = tempfile.mkdtemp(prefix="hl-out-")
    q1 = UP.write_normalized(norm.data, os.path.join(out, "normalized"),
                             os.path.join(out, "ckpt1"))
    q1.awaitTermination(120)
    q2 = UP.kpis_by_stream(norm.data, "recruiter", os.path.join(out, "kpis"), os.path.join(out, "ckpt2"))
    q2.awaitTermination(120)

    from hirelens.operators import ingest as IN
    expected_rows = IN.normalize_all(batch).data
    got_rows = spark.read.parquet(os.path.join(out, "normalized"))
    assert got_rows.count() == expected_rows.count() == raw.count()

    exp = K.group_kpis_by_key(expected_rows, "recruiter")
    got = UP.latest_kpis(spark, os.path.join(out, "kpis"))
    assert rows_key([tuple(r) for r in got.collect()], got.columns) == \
        rows_key([tuple(r) for r in exp.collect()], exp.columns)


def test_stream_reads_cells_as_the_batch_reader(spark):
    landing = tempfile.mkdtemp(prefix="hl-cells-")
    with open(os.path.join(landing, "u.csv"), "w", encoding="utf-8") as fh:
        fh.write('Candidate ID,Role,Notes\nC1,"Dev, ""Senior""","two\nlines"\nC2,N/A, padded \n')
    out = tempfile.mkdtemp(prefix="hl-cells-out-")
    stream = UP.read_uploads(spark, landing, ["Candidate ID", "Role", "Notes"])
    UP.write_normalized(stream.withColumnRenamed("Candidate ID", "id"), os.path.join(out, "rows"), os.path.join(out, "ckpt")).awaitTermination(120)
    want = [tuple(r) for r in FS.read_csv_flexible(spark, landing).collect()]
    got = [tuple(r) for r in spark.read.parquet(os.path.join(out, "rows")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) == [("C1", 'Dev, "Senior"', "two\nlines"), ("C2", None, " padded ")]
