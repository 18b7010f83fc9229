"""Validation and assembly of graphs from extracted rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, EDGE_KEYS, FILE_TYPES, KG, NODE_KEYS, score_default

NODE_ATTRS = ("label", "file_type", "source_file", "source_location", "source_url", "captured_at", "author", "contributor", "community")
_TYPES = {"community": "int", "confidence_score": "double", "weight": "double"}
EDGE_ATTRS = ("relation", "confidence", "confidence_score", "weight", "source_file", "source_location")


# --- validation
def _errors(df: DataFrame, kind: str, key: Column, checks: list[tuple[Column, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(bad, msg) for bad, msg in checks]), lambda x: x.isNotNull())
    return df.select(F.lit(kind).alias("kind"), key.alias("item"), F.explode(found).alias("error"))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """(kind, item, error) for each missing field and unknown file type of a node."""
    checks = [(F.col(k).isNull(), F.lit(f"missing {k}")) for k in NODE_KEYS]
    checks.append((F.col("file_type").isNotNull() & ~F.col("file_type").isin(*FILE_TYPES), F.concat(F.lit("unknown file_type "), F.col("file_type"))))
    return _errors(nodes, "node", F.coalesce("id", F.lit("?")), checks)


def validate_edges(edges: DataFrame) -> DataFrame:
    checks = [(F.col(k).isNull(), F.lit(f"missing {k}")) for k in EDGE_KEYS]
    checks.append((F.col("confidence").isNotNull() & ~F.col("confidence").isin(*CONFIDENCES), F.concat(F.lit("unknown confidence "), F.col("confidence"))))
    return _errors(edges, "edge", F.concat_ws("->", F.coalesce("source", F.lit("?")), F.coalesce("target", F.lit("?"))), checks)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, missing): edge ends that are no node; nothing is dangling where there are no nodes."""
    ids = nodes.where("id is not null").select("id").distinct()
    ends = edges.select("source", "target", F.explode(F.array(F.struct(F.lit("source").alias("missing"), F.col("source").alias("id")), F.struct(F.lit("target").alias("missing"), F.col("target").alias("id")))).alias("e"))
    ends = ends.select("source", "target", "e.missing", "e.id").where("id is not null")
    return ends.join(ids, "id", "left_anti").join(ids.limit(1).select(F.lit(1).alias("any")), how="cross").select("source", "target", "missing").distinct()


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    lost = dangling_edges(nodes, edges).select(F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("item"), F.concat(F.col("missing"), F.lit(" is no node")).alias("error"))
    return reduce(DataFrame.unionByName, [validate_nodes(nodes), validate_edges(edges), lost])


def assert_valid(nodes: DataFrame, edges: DataFrame) -> None:
    bad = validate(nodes, edges).limit(20).collect()
    if bad:
        raise ValueError("\n".join(f"{r['kind']} {r['item']}: {r['error']}" for r in bad))


# --- assembly
def _last(attr: str) -> Column:
    """Value of the last row that has one: a missing value never overwrites."""
    return F.expr(f"max_by({attr}, ord) FILTER (WHERE {attr} IS NOT NULL)").alias(attr)


def _whole(df: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """df with the attributes that it lacks, as nulls."""
    return df.withColumns({a: F.lit(None).cast(_TYPES.get(a, "string")) for a in attrs if a not in df.columns})


def build_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: each attribute from the last row that has it, the place (ord) from the first.

    Rows are brought together as they are, before they are collapsed: a partial result carries `ord` once more with every attribute.
    """
    n = _whole(nodes.where("id is not null"), NODE_ATTRS).repartition("id")
    return n.groupBy("id").agg(*[_last(a) for a in NODE_ATTRS], F.min("ord").alias("ord"))


def build_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row an unordered pair of known nodes, u the earlier node; attributes and direction from the last row.

    Pairs are collapsed by their larger id first, so that edges move twice in all: once by either end.
    """
    at = nodes.select("id", F.col("ord").alias("o"))
    e = _pairs(edges.where("source is not null and target is not null"))
    e = e.join(at.withColumnsRenamed({"id": "hi", "o": "ho"}), "hi").join(at.withColumnsRenamed({"id": "lo", "o": "lo_"}), "lo")
    return _ends(e.withColumn("earlier", F.col("lo_") <= F.col("ho")), F.col("earlier"), F.least("lo_", "ho").alias("u_ord"))


def _pairs(edges: DataFrame) -> DataFrame:
    """(hi, lo, f, attributes, ord): one row a pair of ids; f says whether the last row leads from lo to hi. Rows of a pair meet as they are."""
    e = _whole(edges, EDGE_ATTRS).withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}).repartition("hi")
    return e.groupBy("hi", "lo").agg(F.max_by(F.col("source") == F.col("lo"), F.col("ord")).alias("f"), *[_last(a) for a in EDGE_ATTRS], F.min("ord").alias("ord"))


def _ends(pairs: DataFrame, earlier: Column, *more: Column) -> DataFrame:
    """Rows of _pairs with named ends: u is lo where `earlier` holds."""
    pick = lambda c, a, b: F.when(c, F.col(a)).otherwise(F.col(b))
    return pairs.select(pick(earlier, "lo", "hi").alias("u"), pick(earlier, "hi", "lo").alias("v"), pick(F.col("f"), "lo", "hi").alias("src"), pick(F.col("f"), "hi", "lo").alias("tgt"), *EDGE_ATTRS, "ord", *more)


def build_graph(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> KG:
    """Graph of extracted rows; edges with an unknown end are dropped, rows without id or ends as well."""
    n = build_nodes(nodes)
    return KG(n, build_edges(n, edges), hyperedges)


def build_edges_lenient(edges: DataFrame) -> DataFrame:
    """As build_edges, but ends need not be nodes; u is the smaller id."""
    return _ends(_pairs(edges.where("source is not null and target is not null")), F.lit(True))


def lenient_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and a bare row for each edge end that is none, after them."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "ord").where("id is not null").groupBy("id").agg(F.min("ord").alias("first"))
    return build_nodes(nodes).withColumn("known", F.lit(True)).unionByName(ends.join(nodes, "id", "left_anti").select("id", F.lit(False).alias("known")), allowMissingColumns=True)


def attach_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows with an id, the first of each id; rows need (id, ord)."""
    both = old.withColumn("_r", F.lit(0)).unionByName(new.withColumn("_r", F.lit(1)), allowMissingColumns=True).where("id is not null and id <> ''")
    w = Window.partitionBy("id").orderBy("_r", "ord")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_r")


def with_scores(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence_score", score_default(F.col("confidence"), F.col("confidence_score")))


def adjacency(edges: DataFrame, *keep: str) -> DataFrame:
    """(src, dst, ...) both ways; a loop once."""
    a = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *keep)
    return a.union(edges.where("u <> v").select(F.col("v").alias("src"), F.col("u").alias("dst"), *keep))


def degrees(kg: KG) -> DataFrame:
    """(id, degree) of all nodes; a loop counts twice."""
    d = kg.edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return kg.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


# --- merging and incremental work
def merge(*extractions: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All extractions' rows in turn: the first row of each node id, and all edges. Each is (nodes, edges) with an `ord`."""
    tag = lambda df, r: df.withColumn("ord", F.struct(F.lit(r).alias("r"), F.col("ord").alias("o")))
    n = reduce(DataFrame.unionByName, [tag(x, r) for r, (x, _) in enumerate(extractions)])
    e = reduce(DataFrame.unionByName, [tag(x, r) for r, (_, x) in enumerate(extractions)])
    w = Window.partitionBy("id").orderBy("ord")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), e


def upsert(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> KG:
    """The old rows overlaid with the new ones: attributes of the later row, places of the first."""
    tag = lambda df, r: df.withColumn("ord", F.struct(F.lit(r).alias("r"), F.col("ord").alias("o")))
    return build_graph(tag(old[0], 0).unionByName(tag(new[0], 1)), tag(old[1], 0).unionByName(tag(new[1], 1)))


def replace_files(rows: DataFrame, new_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows without those of changed or deleted files, plus the new ones; changed: (source_file)."""
    return rows.join(changed.select("source_file").distinct(), "source_file", "left_anti").unionByName(new_rows)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files by content hash; both tables have `sha256`."""
    return files.join(cache, "sha256"), files.join(cache, "sha256", "left_anti")


def by_source_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, n_nodes, n_edges, nodes, edges) of files that have any; '' and null are no file."""
    n = nodes.where("source_file <> ''").groupBy("source_file").agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list("id")).alias("nodes"))
    e = edges.where("source_file <> ''").groupBy("source_file").agg(F.count("*").alias("n_edges"), F.sort_array(F.collect_list(F.concat_ws("->", "source", "target"))).alias("edges"))
    none = F.array().cast("array<string>")
    both = n.join(e, "source_file", "full")
    return both.select("source_file", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("nodes", none).alias("nodes"), F.coalesce("edges", none).alias("edges"))


def running_cost(runs: DataFrame) -> DataFrame:
    """runs (date, ord, input_tokens, output_tokens) with running totals. One partition: it is a log of runs."""
    w = Window.orderBy("date", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select("date", "ord", "input_tokens", "output_tokens", F.sum("input_tokens").over(w).alias("total_input"), F.sum("output_tokens").over(w).alias("total_output"))


def resolve_imports(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """`uses` edges: each class of an importing file uses each imported class.

    imports: (file, target_stem, name); entities: (id, file, stem, label, ord). Entities are classes: labels that are no call, file or
    private name; of several with a stem and label the last counts.
    """
    real = entities.where(~F.col("label").endswith(")") & ~F.col("label").endswith(".py") & ~F.col("label").startswith("_"))
    w = Window.partitionBy("stem", "label").orderBy(F.desc("ord"))
    named = real.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("stem").alias("target_stem"), F.col("label").alias("name"), F.col("id").alias("target"))
    hit = imports.join(named, ["target_stem", "name"]).select("file", "target")
    out = hit.join(real.select("file", F.col("id").alias("source")), "file").where("source <> target")
    return out.select("source", "target", F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight")).distinct()


def resolve_calls(sites: DataFrame, labels: DataFrame) -> DataFrame:
    """`calls` edges: call sites (caller, callee, ord) joined to functions (id, label, ord) by name without regard to case.

    A label loses its brackets and leading dot; of several functions with a name the last counts; one edge a pair, no self-calls.
    """
    norm = F.lower(F.regexp_replace(F.regexp_replace("label", r"[()]+$", ""), r"^\.", ""))
    w = Window.partitionBy("name").orderBy(F.desc("ord"))
    named = labels.select("id", norm.alias("name"), "ord").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("name", F.col("id").alias("target"))
    hit = sites.select(F.col("caller").alias("source"), F.lower("callee").alias("name"), "ord").join(named, "name").where("source <> target")
    return hit.groupBy("source", "target").agg(F.min("ord").alias("ord")).select("source", "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"), "ord")
