"""The registered queries of the operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fptree, langid, licenses, linededup, mixing, packing, prefix_trie, quality_rules, ranking, simhash, topk, toxicity, warc
from .common import table
from .params import MIX_WEIGHTS, domain
from .sql import ORACLE  # noqa: F401


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain("source"), MIX_WEIGHTS).select("doc_id", "lang", "source", "mix_tokens", "mix_copies")


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.dedup_lines(table(spark, sf_dir, "documents"), counts="__lines", places="__removed")
    return clean.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"),
                        F.array_join(F.transform("__removed", lambda i: i.cast("string")), ",").alias("removed"),
                        F.md5("text").alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("lines_removed", F.array_join(F.transform("lines_removed", lambda i: i.cast("string")), ","))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_retrieval_packing, op2_simhash_near_dedup, op3_source_mixing, op4_fuzzy_line_dedup, op5_toxicity, op6_license_scan,
    op7_warc, op8_quality_ranking, op9_quality_rules, op10_exact_top_k, op11_language_id, op12_prefix_trie, op13_ranked_search, pipeline)}
