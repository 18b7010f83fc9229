"""From documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and hands the reread table to the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import common, line_dedup, near_dedup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those that tie with its cut-off stay.

    Null, empty and blank texts are rejected; long texts are scored whole. Null ids and repeated rows are judged each for itself, by text.
    Without usable labels every text with words stays. Columns of any name pass unchanged; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; so does a document that had text and lost all of it.

    Of lines that tie, the one of the smallest document id, then line, stays. Null and empty texts and rows with a null id pass unchanged;
    rows that share an id are one document; long texts are compared whole. `n_chars`, where there is such a column, is counted anew
    for texts that lost lines. Other columns of any name pass unchanged; an empty table stays empty.
    """
    out, dropped = line_dedup.dedup_lines(docs), F.col(line_dedup.dropped_column(docs))
    out = out.where((dropped == 0) | (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        chars = F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        cols = [chars.alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, cols)]
    return out.select(*cols)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null, empty and wordless texts are like no other and stay, as do rows with a null id; rows that share an id are one document and stay
    or go together; long texts are compared whole. Columns of any name pass unchanged; an empty table stays empty.
    """
    name = "__gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_dedup.near_duplicates(docs).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens over whole texts: (window_id, position, doc_id, start, length).

    Null and empty texts hold no tokens and rows with a null id are left out; repeated rows are packed each for itself; a long text is cut into full
    windows and a rest; pieces that tie in length are placed by a hash of id and start. Other columns don't matter; an empty table gives no windows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: A trained classifier decides what the first stage keeps, so SQL can't give run()'s rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
