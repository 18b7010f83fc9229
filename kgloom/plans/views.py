"""The knowledge graph that the test tables hold: customers and suppliers, joined by who bought from whom.

Every view comes twice: as DataFrames, and as DuckDB CTEs of the same rows for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import build_edges, build_graph, build_nodes
from ..runtime import cut
from ..schema import KG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LABEL = "CASE {k} % 10 WHEN 0 THEN concat('mod', {k}, '.py') WHEN 1 THEN concat('.m', {k}, '()') WHEN 2 THEN concat('f', {k}, '()') ELSE {name} END"
_FILE = "CASE {k} % 7 WHEN 0 THEN '' WHEN 1 THEN 'notes' ELSE concat(r_name, '/', n_name, '/', {kind}, {k} % 40, CASE {k} % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.png' END) END"
_KIND = "CASE {k} % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'document' WHEN 2 THEN 'paper' ELSE 'image' END"


def _node_sql(kind: str, tab: str, key: str, nation: str, name: str, ord_: str) -> str:
    f = {"k": key, "name": name, "kind": f"'{kind}'"}
    return (
        f"SELECT concat('{kind}', {key}) AS id, {_LABEL.format(**f)} AS label, {_KIND.format(**f)} AS file_type, {_FILE.format(**f)} AS source_file, "
        f"CAST({nation} AS INT) AS community, {ord_} AS ord FROM {tab} JOIN nation ON {nation} = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    )


NODES_SQL = _node_sql("c", "customer", "c_custkey", "c_nationkey", "c_name", "CAST(c_custkey AS BIGINT)") + " UNION ALL " + _node_sql("s", "supplier", "s_suppkey", "s_nationkey", "s_name", "CAST(1000000000000 + s_suppkey AS BIGINT)")
_EDGE_COLS = """CASE WHEN l_linenumber = 2 THEN concat('s', l_suppkey) ELSE concat('c', o_custkey) END AS source, CASE WHEN l_linenumber = 2 THEN concat('c', o_custkey) ELSE concat('s', l_suppkey) END AS target,
  CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'references' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'contains' ELSE 'semantically_similar_to' END END AS relation,
  CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(round(l_tax * 10, 2) AS DOUBLE) END AS confidence_score,
  CAST(round(1 - l_discount, 2) AS DOUBLE) AS weight, concat('f', l_partkey % 50, '.py') AS source_file, CAST(NULL AS {string}) AS source_location, {ord} AS ord"""
_FROM = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_SPARK_ORD = "struct(l_orderkey AS a, l_linenumber * 4503599627370496 + l_partkey * 16777216 + l_suppkey AS b)"  # two longs: they are carried with every attribute
_DUCK_ORD = "((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 65536 + l_suppkey"

FULL, OLD, NEW = "true", "o_orderdate < DATE '1996-06-01'", "o_orderdate >= DATE '1993-06-01'"


def _register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "customer", "supplier", "nation", "region")
    return spark.sql(NODES_SQL)


def raw_edges(spark: SparkSession, sf_dir: str, where: str = FULL) -> DataFrame:
    _register(spark, sf_dir, "lineitem", "orders")
    return spark.sql(f"SELECT {_EDGE_COLS.format(string='STRING', ord=_SPARK_ORD)} {_FROM} WHERE {where}")


def graph(spark: SparkSession, sf_dir: str, where: str = FULL) -> KG:
    return build_graph(raw_nodes(spark, sf_dir), raw_edges(spark, sf_dir, where))


ENDS = ("u", "v")
SHOWN = ("src", "relation", "confidence", "u_ord", "ord")  # what ranked and written edges are made of


def built(spark: SparkSession, sf_dir: str, *more: str) -> KG:
    """graph(), built once, for queries that read it several times; its edges have their ends and the columns `more`."""
    nodes = cut(build_nodes(raw_nodes(spark, sf_dir)))
    return KG(nodes, cut(build_edges(nodes, raw_edges(spark, sf_dir)).select(*ENDS, *more)))


_LAST = "arg_max({c}, ord) FILTER ({c} IS NOT NULL) AS {c}"


def duck_raw(where: str = FULL, prefix: str = "") -> str:
    return f"{prefix}re AS (SELECT {_EDGE_COLS.format(string='VARCHAR', ord=_DUCK_ORD)} {_FROM} WHERE {where})"


def duck_built(where: str = FULL, prefix: str = "") -> str:
    """CTEs kn (nodes) and <prefix>ke (built edges)."""
    attrs = ", ".join(_LAST.format(c=c) for c in ("relation", "confidence", "confidence_score", "weight", "source_file"))
    return f"""{duck_raw(where, prefix)}, {prefix}ke AS (SELECT CASE WHEN source LIKE 'c%' THEN source ELSE target END AS u, CASE WHEN source LIKE 'c%' THEN target ELSE source END AS v, arg_max(source, ord) AS src, arg_max(target, ord) AS tgt, {attrs}, min(ord) AS ord FROM {prefix}re GROUP BY ALL)"""


KN = f"kn AS ({NODES_SQL})"
FACTS = """kd AS (SELECT kn.id, count(e.id) AS degree FROM kn LEFT JOIN (SELECT u AS id FROM ke UNION ALL SELECT v FROM ke) e ON kn.id = e.id GROUP BY kn.id),
nf AS (SELECT kn.*, degree,
  label <> '' AND (list_extract(string_split(label, '.'), -1) IN ('c','cpp','go','h','java','js','py','rb','rs','ts') OR (label LIKE '.%' AND label LIKE '%()') OR (label LIKE '%()' AND degree <= 1)) AS is_file,
  source_file = '' OR list_extract(string_split(source_file, '/'), -1) NOT LIKE '%.%' AS is_concept FROM kn JOIN kd USING (id)),
ef AS (SELECT ke.*, a.label AS u_label, a.source_file AS u_source_file, a.community AS u_community, a.degree AS u_degree, a.is_file AS u_is_file, a.is_concept AS u_is_concept, a.ord AS u_ord,
  b.label AS v_label, b.source_file AS v_source_file, b.community AS v_community, b.degree AS v_degree, b.is_file AS v_is_file, b.is_concept AS v_is_concept
  FROM ke JOIN nf a ON u = a.id JOIN nf b ON v = b.id)"""


def duck(body: str, where: str = FULL, facts: bool = True, more: str = "") -> str:
    """A whole query: the graph's CTEs, with facts of nodes and edges, and the body."""
    return f"WITH RECURSIVE {KN}, {duck_built(where)}{', ' + FACTS if facts else ''}{', ' + more if more else ''} {body}"


KADJ = "adj AS (SELECT u AS src, v AS dst, relation, confidence, ord FROM ke UNION ALL SELECT v, u, relation, confidence, ord FROM ke)"
