"""Point queries: keyword search, bounded traversal, paths, betweenness, token budgets.

A traversal lays the adjacency out by node once; each round joins only its frontier with it and writes what it met anew, so that
plans stay small whatever the depth, and ends with the first round that meets nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, number
from ..schema import KG
from .analyze import god_nodes, top
from .build import adjacency, degrees

MAX_DEPTH = 6
SHORTEST_LINE = 20  # characters that every line has at least
MOST_EDGES = 2_000_000  # a graph that is broadcast for exact betweenness has no more; larger ones go by joins


# --- search
def terms_of(question: str, longer_than: int = 2) -> list[str]:
    return [t for t in question.lower().split() if len(t) > longer_than]


def score_nodes(nodes: DataFrame, terms: list[str], label_only: bool = False) -> DataFrame:
    """(id, score) of nodes that hold a term: 1 for each in the label, 0.5 for each in the source file; repeated terms count again."""
    score: Column = F.lit(0.0)
    for t in terms:
        score = score + F.when(F.lower(F.coalesce("label", F.lit(""))).contains(t), 1.0).otherwise(0.0)
        if not label_only:
            score = score + F.when(F.lower(F.coalesce("source_file", F.lit(""))).contains(t), 0.5).otherwise(0.0)
    return nodes.select("id", score.alias("score")).where("score > 0")


def best_nodes(nodes: DataFrame, terms: list[str], n: int, label_only: bool = False) -> DataFrame:
    return top(score_nodes(nodes, terms, label_only), [F.desc("score"), F.desc("id")], n).select("rank", "id", "score")


def find_node(nodes: DataFrame, term: str) -> DataFrame:
    """The first node whose label holds the term or whose id is it."""
    t = term.lower()
    return nodes.where(F.lower(F.coalesce("label", F.lit(""))).contains(t) | (F.lower("id") == t)).orderBy("ord").limit(1)


def get_node(kg: KG, term: str) -> DataFrame:
    n = find_node(kg.nodes, term)
    deg = kg.edges.select(F.explode(F.array("u", "v")).alias("id")).join(F.broadcast(n.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("d"))
    return n.join(deg, "id", "left").select("id", "label", "source_file", "file_type", "community", F.coalesce("d", F.lit(0)).alias("degree"))


def get_neighbors(kg: KG, term: str, relation: str = "") -> DataFrame:
    """(id, neighbour, label, relation, confidence) of the found node's edges whose relation holds `relation`."""
    n = find_node(kg.nodes, term).select(F.col("id").alias("src"))
    a = adjacency(kg.edges, "relation", "confidence").join(F.broadcast(n), "src")
    a = a.where(F.lower(F.coalesce("relation", F.lit(""))).contains(relation.lower()))
    return a.join(kg.nodes.select(F.col("id").alias("dst"), "label", "source_file"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "label", "relation", "confidence")


def get_community(kg: KG, cid: int) -> DataFrame:
    return kg.nodes.where(F.col("community") == cid).select("id", "label", "source_file")


def explain_node(kg: KG, term: str) -> DataFrame:
    """Connections of the node that matches the term's words best."""
    n = best_nodes(kg.nodes, term.lower().split(), 1).select(F.col("id").alias("src"))
    a = adjacency(kg.edges, "relation", "confidence").join(F.broadcast(n), "src")
    return a.join(kg.nodes.select(F.col("id").alias("dst"), "label", "source_file"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "label", "source_file", "relation", "confidence")


# --- traversal
def by_node(kg: KG) -> DataFrame:
    """(src, dst) both ways without loops, partitioned by src and held on the executors' disks; unpersist() it after use."""
    return adjacency(kg.edges.where("u <> v")).repartition("src").persist(StorageLevel.DISK_ONLY)


def _rounds(near: DataFrame, first: DataFrame, depth: int, step, merge: list[Column]) -> DataFrame:
    """`first` and the rows met in `depth` rounds. step: columns of a met row, besides its id; merge: how rows that meet at a node become one."""
    met = frontier = cut(first)
    for _ in range(depth):
        found = frontier.join(near, frontier["id"] == near["src"]).select(F.col("dst").alias("id"), *step)
        found = found.groupBy("id").agg(*merge)  # before the anti-join: a hub is met many times
        frontier = cut(found.join(met.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        met = met.union(frontier)
    return met


def bfs(kg: KG, starts: DataFrame, depth: int = 3, near: DataFrame | None = None) -> DataFrame:
    """(id, dist) of nodes within `depth` steps of the starts (id). near: by_node(kg), where it is there already."""
    first = starts.select("id").distinct().join(kg.nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("dist"))
    a = by_node(kg) if near is None else near
    out = _rounds(a, first, depth, [(F.col("dist") + 1).alias("dist")], [F.min("dist").alias("dist")])
    if near is None:
        a.unpersist()
    return out


def bfs_edges(kg: KG, dist: DataFrame, depth: int) -> DataFrame:
    """(src, dst, dist) of all edges from one level to the next within `depth`."""
    d = dist.select(F.col("id").alias("src"), F.col("dist").alias("ds")).where(F.col("dist") < depth)
    e = adjacency(kg.edges.where("u <> v")).join(d, "src").join(dist.select(F.col("id").alias("dst"), "dist"), "dst")
    return e.where(F.col("dist") == F.col("ds") + 1).select("src", "dst", "dist")


CHUNK = 1_000_000  # neighbours that are packed into one row


def _packed(batches):
    """Rows (node, dst) in order, as (nodes, how many neighbours each has, neighbours) of 4 bytes each, about CHUNK to a row."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        at = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        parts = src[at], np.diff(np.append(at, len(src))), dst
        return pa.record_batch([pa.array([len(dst)], pa.int64()), *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in parts]], names=["n", "node", "count", "dst"])

    held, n = [], 0
    for batch in batches:
        if len(batch):
            held, n = [*held, batch], n + len(batch)
        if n >= CHUNK:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def _walk(batches, offsets: dict[int, int], nodes: int, total: int, starts: list[int], depth: int):
    """(n, step) of nodes by a depth-first walk over the neighbours that _packed() holds; chunks may come in any order."""
    dst, count = np.empty(total, np.int32), np.zeros(nodes, np.int64)
    for batch in batches:
        for at, _, node, many, near in zip(*(c.to_pylist() for c in batch.columns)):
            dst[offsets[at] : offsets[at] + len(near) // 4] = np.frombuffer(near, np.int32)
            count[np.frombuffer(node, np.int32)] += np.frombuffer(many, np.int32)
    upto = np.concatenate(([0], np.cumsum(count)))
    met, order = np.zeros(nodes, bool), []

    def new(x: int) -> np.ndarray:
        near = dst[upto[x] : upto[x + 1]]
        return near[~met[near]]

    for s in starts:
        if met[s]:
            continue
        met[s] = True
        order.append(np.array([s]))
        stack = [[new(s), 0]] if depth else []
        while stack:
            near, i = stack[-1]
            if len(stack) == depth:  # these go no further, so all are met at once
                met[near] = True
                order.append(near)
                i = len(near)
            while i < len(near) and met[near[i]]:
                i += 1
            if i == len(near):
                stack.pop()
                continue
            x, stack[-1][1] = int(near[i]), i + 1
            met[x] = True
            order.append(np.array([x]))
            stack.append([new(x), 0])
    met = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
    for lo in range(0, len(met), CHUNK):
        yield pa.record_batch([pa.array(met[lo : lo + CHUNK]), pa.array(np.arange(lo, min(lo + CHUNK, len(met))))], names=["n", "step"])


def dfs(kg: KG, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(id, step) as a depth-first stack walk meets nodes: marked when popped, neighbours in edge order.

    The nodes within `depth` steps hold every node the walk can meet. Their edges, sorted by all tasks, go to one task, which
    walks: 4 bytes for either end of an edge, and some 20 a node.
    """
    ball = bfs(kg, starts, depth)
    place = cut(number(kg.nodes.select("id", "ord").join(ball.select("id"), "id", "left_semi"), [F.col("ord"), F.col("id")], "n").select("id", "n"))
    at = lambda c, n: place.select(F.col("id").alias(c), F.col("n").alias(n))
    a = adjacency(kg.edges.where("u <> v"), "ord").join(at("src", "s"), "src").join(at("dst", "d"), "dst")
    chunks = cut(a.orderBy("s", "ord").select("s", "d").mapInArrow(_packed, "n long, node binary, count binary, dst binary").withColumn("at", F.monotonically_increasing_id()))
    offsets, total = {}, 0
    for i, n in sorted((r["at"], r["n"]) for r in chunks.select("at", "n").collect()):  # one row a chunk
        offsets[i], total = total, total + n
    first = sorted(r["n"] for r in place.join(starts.select("id").distinct(), "id", "left_semi").collect())
    nodes = place.count()
    steps = chunks.select("at", "n", "node", "count", "dst").repartition(1).mapInArrow(lambda it: _walk(it, offsets, nodes, total, first, depth), "n long, step long")
    return steps.join(place, "n").select("id", "step")


def shortest_paths(kg: KG, source: str, max_hops: int = 8) -> DataFrame:
    """(id, hops, path) of nodes within max_hops of source; of equal paths the smallest array of ids."""
    first = kg.nodes.where(F.col("id") == source).select("id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    a = by_node(kg)
    out = _rounds(a, first, max_hops, [(F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("dst")).alias("path")], [F.min("hops").alias("hops"), F.min("path").alias("path")])
    a.unpersist()
    return out


def shortest_path(kg: KG, source: str, target: str, max_hops: int = 8) -> str:
    """The path between the best matches of two descriptions, as text."""
    ends = [best_nodes(kg.nodes, x.lower().split(), 1).select("id").first() for x in (source, target)]
    for x, end in zip((source, target), ends):
        if end is None:
            return f"No node matches '{x}'."
    found = shortest_paths(kg, ends[0][0], max_hops).where(F.col("id") == ends[1][0]).first()
    if found is None:
        return f"No path of {max_hops} hops or less between '{ends[0][0]}' and '{ends[1][0]}'."
    names = {r["id"]: r["label"] or r["id"] for r in kg.nodes.where(F.col("id").isin(found["path"])).select("id", T.sanitize_label(F.col("label")).alias("label")).collect()}
    return f"Shortest path ({found['hops']} hops):\n  " + " --> ".join(names[i] for i in found["path"])


# --- text of a subgraph
def _lines(kg: KG, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of nodes (place, line) and of the edges between them (u_ord, ord, line)."""
    n = kg.nodes.join(ids.select("id"), "id", "left_semi").join(degrees(kg), "id")
    clean = lambda c: T.sanitize_label(F.coalesce(c, F.lit("")))
    nodes = n.select(F.struct((-F.col("degree")).alias("d"), F.struct("ord").alias("o")).alias("place"), F.concat(F.lit("NODE "), clean(F.coalesce("label", "id")), F.lit(" [src="), F.coalesce("source_file", F.lit("")), F.lit(" community="), F.coalesce(F.col("community").cast("string"), F.lit("")), F.lit("]")).alias("line"))
    lab = n.select("id", clean(F.coalesce("label", "id")).alias("l"))
    e = kg.edges.join(lab.withColumnsRenamed({"id": "src", "l": "ls"}), "src").join(lab.withColumnsRenamed({"id": "tgt", "l": "lt"}), "tgt")
    text = F.concat(F.lit("EDGE "), F.col("ls"), F.lit(" --"), F.coalesce("relation", F.lit("")), F.lit(" ["), F.coalesce("confidence", F.lit("")), F.lit("]--> "), F.col("lt"))
    return nodes, e.select("u_ord", "ord", text.alias("line"))


def subgraph_lines(kg: KG, ids: DataFrame, most: int | None = None) -> DataFrame:
    """(part, place, line): a line for each node, best connected first, then one for each edge between them; at most `most` of either.

    Without `most` rows are numbered by ranges, never in one task.
    """
    nodes, edges = _lines(kg, ids)
    if most is None:
        n, e = number(nodes, [F.col("place")], "k"), number(edges, [F.col("u_ord"), F.col("ord")], "k")
        return n.select(F.lit(0).alias("part"), (F.col("k") + 1).alias("place"), "line").union(e.select(F.lit(1).alias("part"), (F.col("k") + 1).alias("place"), "line"))
    nodes, edges = nodes.orderBy("place").limit(most), edges.orderBy("u_ord", "ord").limit(most)
    nodes = nodes.select(F.lit(0).alias("part"), F.row_number().over(Window.orderBy("place")).cast("long").alias("place"), "line")
    return nodes.union(edges.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("u_ord", "ord")).cast("long").alias("place"), "line"))


def within_budget(lines: DataFrame, tokens: int) -> DataFrame:
    """The first lines whose text, with line breaks, fits into tokens x 4 characters."""
    used = F.sum(F.length("line") + 1).over(Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where(F.col("used") - 1 <= tokens * 4).drop("used")


def query_graph(kg: KG, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000) -> str:
    """Text of the graph around the nodes that match the question best."""
    starts = best_nodes(kg.nodes, terms_of(question), 3)
    seeds = starts.collect()
    if not seeds:
        return "No matching nodes found."
    depth = min(depth, MAX_DEPTH)
    ids = starts.sparkSession.createDataFrame([(r["id"],) for r in seeds], "id string")
    met = (dfs if mode == "dfs" else bfs)(kg, ids, depth)
    lines = subgraph_lines(kg, met, token_budget * 4 // SHORTEST_LINE + 2)  # no more lines fit
    kept = within_budget(lines, token_budget).orderBy("part", "place").collect()
    cut = len(kept) < lines.count()
    head = f"Traversal: {mode.upper()}, depth {depth}, from {', '.join(r['id'] for r in seeds)}"
    return "\n".join([head, "", *[r["line"] for r in kept], *(["... (cut at the token budget)"] if cut else [])])


def query_tokens(kg: KG, question: str, depth: int = 3, near: DataFrame | None = None) -> DataFrame:
    """One row: lines and estimated tokens of the subgraph for a question; 0 where nothing matches."""
    starts = best_nodes(kg.nodes, terms_of(question), 3, label_only=True).select("id")
    nodes, edges = _lines(kg, bfs(kg, starts, depth, near))
    chars = F.coalesce(F.sum(F.length("line")) + F.count("*") - 1, F.lit(0))
    lines = nodes.select("line").union(edges.select("line")).agg(F.count("*").alias("n_lines"), chars.cast("long").alias("chars"))
    return lines.select("n_lines", F.when(F.col("n_lines") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("chars") / 4))).cast("long").alias("tokens"))


def token_reduction(kg: KG, questions: list[str], words: int | None = None, depth: int = 3) -> DataFrame:
    """One row: corpus tokens, mean tokens of the questions that match anything, and their ratio to 1 digit."""
    near = by_node(kg)
    per = reduce(DataFrame.union, [query_tokens(kg, q, depth, near) for q in questions])
    some = cut(per.where("tokens > 0").agg(F.count("*").alias("questions"), F.floor(F.avg("tokens")).cast("long").alias("avg_query_tokens")))
    near.unpersist()
    corpus = kg.nodes.agg((F.lit(words) if words is not None else F.count("*") * 50).cast("long").alias("words")).select(F.floor(F.col("words") * 100 / 75).cast("long").alias("corpus_tokens"))
    return corpus.join(some, how="cross").select("questions", "corpus_tokens", "avg_query_tokens", F.bround(F.col("corpus_tokens") / F.col("avg_query_tokens"), 1).alias("reduction"))


# --- betweenness
def _brandes(n: int, at: np.ndarray, to: np.ndarray, edge: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Dependencies of all nodes and edges on source s, level by level."""
    dist, paths, levels = np.full(n, -1), np.zeros(n), [np.array([s])]
    dist[s], paths[s] = 0, 1
    steps = []
    while len(levels[-1]):
        f = levels[-1]
        count = at[f + 1] - at[f]
        pos = np.repeat(at[f] - np.cumsum(count) + count, count) + np.arange(count.sum())
        a, b = np.repeat(f, count), to[pos]
        new = np.unique(b[dist[b] < 0])
        dist[new] = len(levels)
        ok = dist[b] == len(levels)
        a, b, pos = a[ok], b[ok], pos[ok]
        np.add.at(paths, b, paths[a])
        steps.append((a, b, edge[pos]))
        levels.append(new)
    dep, on_edge = np.zeros(n), np.zeros(edge.max() + 1 if len(edge) else 0)
    for a, b, e in reversed(steps):
        c = paths[a] / paths[b] * (1 + dep[b])
        np.add.at(dep, a, c)
        np.add.at(on_edge, e, c)
    dep[s] = 0
    return dep, on_edge


PAIRS_AT_ONCE = 50_000_000  # rows, about, that a block of sources meets: as many sources, but one at least


def _betweenness_by_joins(kg: KG, sources: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """As betweenness(), of a graph of any size: blocks of sources go through the graph level by level as tables; no task holds a graph.

    The work is that of all sources times all edges.
    """
    place = cut(number(kg.nodes.select("id", "ord"), [F.col("ord"), F.col("id")], "n").select("id", "n"))
    at = lambda c, n: place.select(F.col("id").alias(c), F.col("n").alias(n))
    pairs = cut(kg.edges.where("u <> v").select("u", "v").join(at("u", "x"), "u").join(at("v", "y"), "v"))
    near = pairs.select(F.col("x").alias("src"), F.col("y").alias("dst")).union(pairs.select("y", "x")).repartition("src").persist(StorageLevel.DISK_ONLY)
    n, m = place.count(), pairs.count()
    picked = None if sources is None or sources >= n else np.sort(np.random.default_rng(seed).choice(n, sources, replace=False))
    many, size = n if picked is None else len(picked), max(1, PAIRS_AT_ONCE // max(1, n + 2 * m))
    node = edge = None
    for lo in range(0, many, size):
        if picked is None:
            s = place.sparkSession.range(lo, min(many, lo + size)).select(F.col("id").alias("s"))
        else:
            s = place.sparkSession.createDataFrame([(int(x),) for x in picked[lo : lo + size]], "s long")
        levels = [cut(s.select("s", F.col("s").alias("id"), F.lit(1.0).alias("paths")))]
        met = levels[0].select("s", "id")
        while True:
            found = levels[-1].join(near, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            new = cut(found.join(met, ["s", "id"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
            met = met.union(new.select("s", "id"))
        below, on_node, on_edge = levels[-1].withColumn("dep", F.lit(0.0)), [], []
        for level in reversed(levels[:-1]):
            on_node.append(below.select("id", "dep"))
            up = below.join(near, F.col("id") == F.col("src")).select("s", F.col("id").alias("lower"), F.col("dst").alias("id"), F.col("paths").alias("p"), "dep")
            share = cut(up.join(level, ["s", "id"]).select("s", "id", "lower", "paths", (F.col("paths") / F.col("p") * (1 + F.col("dep"))).alias("c")))
            on_edge.append(share.select(F.least("id", "lower").alias("x"), F.greatest("id", "lower").alias("y"), "c"))
            below = level.join(share.groupBy("s", "id").agg(F.sum("c").alias("dep")), ["s", "id"], "left").select("s", "id", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        if on_edge:  # what the sources themselves pass on doesn't count
            node = cut(reduce(DataFrame.union, on_node if node is None else [node, *on_node]).groupBy("id").agg(F.sum("dep").alias("dep")))
            edge = cut(reduce(DataFrame.union, on_edge if edge is None else [edge, *on_edge]).groupBy("x", "y").agg(F.sum("c").alias("c")))
    near.unpersist()
    if node is None:
        return place.select("id", F.lit(0.0).alias("betweenness")), pairs.select("u", "v", F.lit(0.0).alias("betweenness"))
    scale = n / max(1, many)
    node_scale, edge_scale = scale / ((n - 1) * (n - 2)) if n > 2 else 0.0, scale / (n * (n - 1))
    by_node = place.join(node.withColumnRenamed("id", "n"), "n", "left").select("id", (F.coalesce("dep", F.lit(0.0)) * node_scale).alias("betweenness"))
    ends = pairs.select("u", "v", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return by_node, ends.join(edge, ["x", "y"], "left").select("u", "v", (F.coalesce("c", F.lit(0.0)) * edge_scale).alias("betweenness"))


def betweenness(kg: KG, sources: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((id, betweenness), (u, v, betweenness)), normalised, unweighted; from all sources, or a sample scaled up.

    The adjacency is broadcast as arrays where it has at most MOST_EDGES edges, and the sources are spread over the tasks;
    larger graphs are gone through by joins.
    """
    spark = kg.nodes.sparkSession
    if kg.edges.count() > MOST_EDGES:
        return _betweenness_by_joins(kg, sources, seed)
    ids = kg.nodes.select("id").orderBy("ord").toPandas()["id"].to_numpy(object)
    e = kg.edges.where("u <> v").select("u", "v").toPandas()
    place = {x: i for i, x in enumerate(ids)}
    u, v = e["u"].map(place).to_numpy(np.int64), e["v"].map(place).to_numpy(np.int64)
    src, dst, num = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(np.arange(len(u)), 2)
    order = np.argsort(src, kind="stable")
    at = np.searchsorted(src[order], np.arange(len(ids) + 1))
    shipped = spark.sparkContext.broadcast((len(ids), at, dst[order], num[order]))
    n = len(ids)
    pick = np.arange(n) if sources is None or sources >= n else np.sort(np.random.default_rng(seed).choice(n, sources, replace=False))
    scale = n / max(1, len(pick))

    def work(batches):
        size, a, t, x = shipped.value
        nodes, edges = np.zeros(size), np.zeros(len(t) // 2)
        for pdf in batches:
            for s in pdf["s"]:
                d, on = _brandes(size, a, t, x, s)
                nodes += d
                edges[: len(on)] += on
        yield pd.DataFrame({"kind": np.repeat([0, 1], [len(nodes), len(edges)]), "i": np.concatenate([np.arange(len(nodes)), np.arange(len(edges))]), "x": np.concatenate([nodes, edges])})

    tasks = max(1, min(len(pick), spark.sparkContext.defaultParallelism * 2))
    part = spark.createDataFrame(pd.DataFrame({"s": pick.astype(np.int64)}), "s long").repartition(tasks)
    total = part.mapInPandas(work, "kind int, i long, x double").groupBy("kind", "i").agg(F.sum("x").alias("x"))
    names = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "id": ids}), "i long, id string")
    pairs = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(e)), "u": e["u"].to_numpy(object), "v": e["v"].to_numpy(object)}), "i long, u string, v string")
    node_scale, edge_scale = scale / ((n - 1) * (n - 2)) if n > 2 else 0.0, scale / (n * (n - 1)) if n > 1 else 0.0
    by_node = names.join(total.where("kind = 0"), "i").select("id", (F.col("x") * node_scale).alias("betweenness"))
    by_edge = pairs.join(total.where("kind = 1"), "i").select("u", "v", (F.col("x") * edge_scale).alias("betweenness"))
    return by_node, by_edge


__all__ = ["bfs", "bfs_edges", "betweenness", "best_nodes", "dfs", "explain_node", "find_node", "get_community", "get_neighbors", "get_node", "god_nodes", "query_graph", "query_tokens", "score_nodes", "shortest_path", "shortest_paths", "subgraph_lines", "terms_of", "token_reduction", "within_budget"]
