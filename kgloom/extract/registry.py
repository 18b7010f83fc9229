"""Extraction as a table operation: one parse a file, in Arrow batches, with a look-aside cache and joins across files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.build import resolve_imports
from ..runtime import remove
from .python_ast import extract_python, imported_names
from .scanners import SCANNERS

Extractor = Callable[..., dict]
#: By file type; add a language by adding its function (path, text, by_path) -> {"nodes", "edges"[, "error"]}.
EXTRACTORS: dict[str, Extractor] = {"py": extract_python, **SCANNERS}
NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string>"
EDGE = "struct<source:string,target:string,relation:string,confidence:string,source_file:string,source_location:string,weight:double>"
IMPORT = "struct<file:string,target_stem:string,name:string>"
SCHEMA = f"path string, sha256 string, nodes array<{NODE}>, edges array<{EDGE}>, imports array<{IMPORT}>, error string"


def extract_one(path: str, text: str, by_path: bool = False) -> dict:
    """Rows of one file; a file of another type has none, a file that can't be parsed has an error."""
    f = EXTRACTORS.get(path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else "")
    if f is None:
        return dict(nodes=[], edges=[], imports=[], error=None)
    out = f(path, text, by_path)
    return {"nodes": out["nodes"], "edges": out["edges"], "imports": imported_names(path, text) if path.endswith(".py") else [], "error": out.get("error")}


def _work(by_path: bool):
    def run(batches):
        for pdf in batches:
            rows = [{"path": p, "sha256": h, **extract_one(p, t or "", by_path)} for p, h, t in zip(pdf["path"], pdf["sha256"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["path", "sha256", "nodes", "edges", "imports", "error"])

    return run


def parse(files: DataFrame, by_path: bool = False) -> DataFrame:
    """One row a code file (path, text) with its nodes, edges and imports."""
    src = files.where(T.suffix(F.col("path")).isin(*EXTRACTORS)).select("path", F.sha2("text", 256).alias("sha256"), "text")
    return src.mapInPandas(_work(by_path), SCHEMA)


def with_cache(files: DataFrame, cache: DataFrame, by_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of all files, rows that were not in the cache). Cached rows count for the same path and content."""
    f = files.withColumn("sha256", F.sha2("text", 256))
    old = cache.join(f.select("path", "sha256"), ["path", "sha256"], "left_semi")
    new = parse(f.join(cache.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path", "text"), by_path)
    return old.unionByName(new), new


def cached_files(cache: DataFrame) -> DataFrame:
    """(sha256) of the contents that the cache holds rows of."""
    return cache.select("sha256").distinct()


def clear_cache(spark: SparkSession, path: str) -> None:
    """Drops the cache table at `path`, if there is one."""
    remove(spark, path)


def nodes_of(parsed: DataFrame) -> DataFrame:
    n = parsed.select("path", F.posexplode("nodes").alias("k", "n"))
    return n.select("n.*", F.struct("path", F.col("k").cast("long").alias("k")).alias("ord"))


def edges_of(parsed: DataFrame) -> DataFrame:
    e = parsed.select("path", F.posexplode("edges").alias("k", "e"))
    return e.select("e.*", F.struct("path", F.col("k").cast("long").alias("k")).alias("ord"))


def cross_file_uses(parsed: DataFrame) -> DataFrame:
    """`uses` edges from the classes of a Python file to the classes that it imports."""
    py = parsed.where(F.col("path").endswith(".py"))
    n = nodes_of(py)
    entities = n.where("source_file <> ''").select("id", F.col("source_file").alias("file"), T.stem(F.col("source_file")).alias("stem"), "label", "ord")
    used = resolve_imports(py.select(F.explode("imports").alias("i")).select("i.*"), entities)
    at = entities.select(F.col("id").alias("source"), F.col("file").alias("source_file")).dropDuplicates(["source"])
    return used.join(at, "source").select(*["source", "target", "relation"], "confidence", F.col("source_file"), F.lit("").alias("source_location"), "weight", F.struct(F.lit("~").alias("path"), F.xxhash64("source", "target").alias("k")).alias("ord"))


def extract(files: DataFrame, cache: DataFrame | None = None, by_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of code files (path, text), uses across files included."""
    parsed = parse(files, by_path) if cache is None else with_cache(files, cache, by_path)[0]
    return nodes_of(parsed), edges_of(parsed).unionByName(cross_file_uses(parsed))
