"""The training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
and reads as the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import linededup, mixing, packing, quality_rules, simhash
from hirelens.llm.common import table, written
from hirelens.llm.params import MIX_WEIGHTS, domain


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines above the limit of their source."""
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; documents all of whose lines do are gone."""
    clean = linededup.dedup_lines(docs, counts="__lines", places="__removed")
    emptied = (F.size("__removed") > 0) & (F.size("__removed") == F.col("__lines"))
    clean = clean.where(~emptied)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one_per_group(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that domains, languages and sources have their target weights."""
    mixed = mixing.mix(docs, domain("source"), MIX_WEIGHTS).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.withColumn("mix_copy", copies).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality_rules", rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("source_mixing", mix), ("retrieval_packing", pack)]
ORACLE_SQL = None  # fuzzy lines, fingerprints and tokens are beyond SQL; tests/llm runs it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
