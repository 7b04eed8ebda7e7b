"""WARC archives by a deterministic sharded writer, and their reader.

Records are sorted by page id within shards of consecutive ids.  Shard borders come from an
exact histogram of payload bytes over at most BINS equal id ranges, so they depend on the data
alone, not on partitions or samples.  A task writes its shards in order, rolls files at a
compressed size, regenerates WARC and HTTP headers, digests and record ids, and writes each
file under a temporary name that is moved to its final one when complete.  The manifest (one
row per file: name, records, bytes, SHA-256) is written last through Spark's own commit; only
files that it names count, so what a lost task leaves behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import shuffle_partitions, written

BINS = 16_384
SHARDS, LEAST_SHARD, MOST_SHARD = 1024, 500_000, 256_000_000  # about so many shards, of payloads within these bytes
ROLL_BYTES = 16_000_000  # compressed size at which a file is closed
REVISIT_BYTES = 1000  # smaller payloads are always written
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str):
    """(file system, path) for a folder that driver and executors share."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:/*(?=/)|file:)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One gzip member with a response record, or a revisit of the same payload under ``refers_to``."""
    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, sha.hexdigest(), copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{b32encode(sha.digest()).decode()}",
            f"WARC-Block-Digest: sha1:{b32encode(hashlib.sha1(block).digest()).decode()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest(), 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(content: bytes) -> Iterator[dict]:
    """The records of one file; digests and lengths are checked against the headers."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {version[:40]!r}")
        head = {}
        while (line := stream.readline().decode().rstrip("\r\n")):
            name, _, value = line.partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        stream.readline(), stream.readline()
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {head['warc-record-id']} does not fit")
        response = head["warc-type"] == "response"
        if response and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {head['warc-record-id']} does not fit")
        length = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
        yield {"page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "url": head["warc-target-uri"],
               "payload": payload if response else None, "payload_bytes": length, "payload_digest": digest,
               "record_type": head["warc-type"], "refers_to": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None}


def _sharded(pages: DataFrame, id_col: str, url: str, html: str, shard_bytes: int | None) -> DataFrame:
    """(shard, page_id, url, html, digest, response_id): shards of consecutive ids of about ``shard_bytes``."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest, size = F.sha1("html"), F.octet_length("html")
    light = own.select("page_id", digest.alias("digest"), size.alias("size"))
    again = written(light.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest")
                    .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-again")
    edge = own.agg(F.min("page_id"), F.max("page_id"), F.sum(F.when(F.col("page_id").isNull(), size))).first()
    low, width = edge[0] or 0, ((edge[1] or 0) - (edge[0] or 0)) // BINS + 1
    span = F.expr(f"cast((cast(page_id as decimal(20,0)) - cast({low} as decimal(20,0))) div cast({width} as decimal(20,0)) as int)")
    sizes = own.where("page_id is not null").groupBy(span.alias("bin")).agg(F.sum(size).alias("b")).collect()  # BINS rows at most
    total = sum(r["b"] for r in sizes) + (edge[2] or 0)
    shard_bytes = shard_bytes or min(MOST_SHARD, max(LEAST_SHARD, total // SHARDS))
    rows, filled, shard = [], 0, 0
    for r in sorted(sizes, key=lambda r: r["bin"]):
        if filled >= shard_bytes:
            filled, shard = 0, shard + 1
        rows.append((r["bin"], shard))
        filled += r["b"]
    bins = spark.createDataFrame(rows, "bin int, shard long")
    loose = shard + 1 + F.pmod(F.xxhash64("html"), F.lit(1 + (edge[2] or 0) // shard_bytes))  # records without an id
    return (own.withColumns({"digest": digest, "bin": span}).join(F.broadcast(bins), "bin", "left")
            .withColumn("shard", F.coalesce("shard", loose)).drop("bin").join(again, "digest", "left"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html",
               shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row into ``folder`` (shared) and return the manifest, written to ``folder``/_manifest.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, that with the largest id is the
    response and the others revisit it (of repeated rows with that id the first); rows without an
    id are always responses.  A null html is an empty payload, a null url becomes a urn; other
    columns are ignored; an empty table gives no file and an empty manifest.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        shard, number, done, seen = None, 0, [], {}
        sink = name = temporary = sha = None
        records = size = 0

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                fs.move(temporary, f"{path}/{name}")
                done.append((name, shard, records, size, sha.hexdigest()))
                sink = None

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.shard != shard:
                    close()
                    shard, number, seen = int(r.shard), 0, {}
                if sink is None:
                    name = f"shard-{shard:06d}-{number:05d}.warc.gz"
                    temporary = f"{path}/_{name}-{uuid.uuid4().hex}"
                    sink, sha, records, size, number = fs.open_output_stream(temporary, compression=None), hashlib.sha256(), 0, 0, number + 1
                page_id = None if r.page_id is None else int(r.page_id)
                winner = None if r.response_id is None or page_id is None else int(r.response_id)
                if seen.get("at") != (page_id, r.digest):
                    seen = {"at": (page_id, r.digest), "n": -1}
                seen["n"] += 1
                is_response = winner is None or (page_id == winner and seen["n"] == 0)
                data = record(page_id, r.url, r.html.encode(), None if is_response else winner, seen["n"])
                sink.write(data)
                sha.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    spark = pages.sparkSession
    rows = (_sharded(pages, id_col, url, html, shard_bytes).repartition(shuffle_partitions(spark), "shard")
            .sortWithinPartitions("shard", "page_id", "digest", "url"))
    # ids go as text: pandas would turn whole numbers beside nulls into floats
    files = rows.select("shard", F.col("page_id").cast("string"), "url", "html", "digest", F.col("response_id").cast("string"))
    files.mapInPandas(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """RECORD rows of the files that the manifest names, each file checked against its SHA-256.

    ``payload`` is null for revisits; payload_bytes and payload_digest are of the full payload.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "sha256"), "file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                if hashlib.sha256(f.content).hexdigest() != f.sha256:
                    raise ValueError(f"{f.file} is not the file of the manifest")
                held, size = [], 0
                for r in parse(f.content):
                    held.append(r)
                    size += len(r["payload"] or b"")
                    if size > 16_000_000:
                        yield _frame(held)
                        held, size = [], 0
                if held:
                    yield _frame(held)

    return files.mapInPandas(run, RECORD)


def _frame(records: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(records, columns=[c.split()[0] for c in RECORD.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
