"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, arc, line_dedup, near_dedup, packing, quality, sentencepiece_codec, sharding, topk, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_checked(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_dropped")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, written as ARC files of both versions, converted to WARC records."""
    out = arc.arc_to_warc(arc.pages_as_arc(table(spark, sf_dir, "pages")))
    return out.select("warc_type", "record_id", "target_uri", "warc_date", "ip", "content_type", "content_length", "block_digest", "payload_digest", "truncated", F.decode("block", "utf-8").alias("block"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality": op5_quality,
        "op6_url_filter": op6_url_filter,
        "op7_sharding": op7_sharding,
        "op8_ann": op8_ann,
        "op9_topk": op9_topk,
        "op10_warc": op10_warc,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE_SQL, "op9_topk": topk.ORACLE_SQL, "op10_warc": arc.ORACLE_SQL}
