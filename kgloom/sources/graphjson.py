"""Graphs and extractions kept as JSON documents."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import build_graph
from ..schema import KG

NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string,source_url:string,captured_at:string,author:string,contributor:string,community:double>"
LINK = "struct<source:string,target:string,_src:string,_tgt:string,relation:string,confidence:string,confidence_score:double,weight:double,source_file:string,source_location:string>"
HYPER = "struct<id:string,label:string,nodes:array<string>,relation:string,confidence:string,confidence_score:double,source_file:string>"
DOCUMENT = f"nodes array<{NODE}>, links array<{LINK}>, edges array<{LINK}>, hyperedges array<{HYPER}>, input_tokens bigint, output_tokens bigint"


def guard(path: str, base: str) -> Path:
    """path, if it is an existing JSON file below base."""
    p, b = Path(path).resolve(), Path(base).resolve()
    if not b.is_dir() or b not in p.parents:
        raise ValueError(f"{path} is not below {base}")
    if p.suffix != ".json" or not p.is_file():
        raise FileNotFoundError(path)
    return p


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hyperedges, tokens) of JSON documents: stored graphs (links) or extractions (edges), places as `ord`."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("f", F.input_file_name())
    n = doc.select("f", F.posexplode("nodes").alias("k", "n")).select("n.*", F.struct("f", "k").alias("ord")).withColumn("community", F.col("community").cast("int"))
    e = doc.select("f", F.posexplode(F.coalesce("links", "edges")).alias("k", "e"))
    e = e.select(F.coalesce("e._src", "e.source").alias("source"), F.coalesce("e._tgt", "e.target").alias("target"), "e.relation", "e.confidence", "e.confidence_score", "e.weight", "e.source_file", "e.source_location", F.struct("f", "k").alias("ord"))
    h = doc.select("f", F.posexplode("hyperedges").alias("k", "h")).select("h.*", F.struct("f", "k").alias("ord"))
    return n, e, h, doc.select("input_tokens", "output_tokens", F.col("nodes").isNotNull().alias("readable"))


def load(spark: SparkSession, path: str) -> KG:
    """Graph of a stored file; ValueError where it is no JSON document."""
    n, e, h, about = read(spark, path)
    if not about.where("not readable").isEmpty():
        raise ValueError(f"{path} is not a graph file")
    return build_graph(n, e, h)


def communities(kg: KG) -> DataFrame:
    """(community, members) from the nodes' attribute."""
    return kg.nodes.where("community is not null").groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))
