"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts by recursive bisection; a small network learns
each vector's part (with a share of its neighbours' parts). It files every vector under its most probable part,
and routes each query to its most probable parts, where all vectors are reranked exactly. How many parts a query
visits is set on CALIBRATION queries, whose true neighbours are found by one pass over all vectors, so that their
recall reaches TARGET.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K = 10
EVERY = 50  # the rows whose id is divisible by it are the queries
MAX_PARTS = 1024
SAMPLE = 32 * MAX_PARTS  # vectors that the graph and the network are fitted on, at most
PER_PART = 128  # and for each part; in the largest tables less, where SAMPLE is reached
CALIBRATION = 256  # queries whose true neighbours are known
TARGET = 0.95  # recall aimed at on them
CHUNK = 65_536  # points, and queries, that meet in one group at most, about
HIDDEN = 128
EPOCHS = 20
DIGITS = 6  # similarities are rounded for ranks, ties go to smaller ids


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; rows without length stay 0."""
    x = np.nan_to_num(np.asarray(x, np.float32))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k most similar others, for each row (or each in `of`), by brute force in blocks."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.zeros((len(of), max(k, 0)), np.int64)
    for lo in range(0, len(of), 512):
        rows = of[lo : lo + 512]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        if k > 0:
            out[lo : lo + len(rows)] = np.argpartition(-s, k - 1, 1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, graph: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Halves of equal size (by one) with few edges between: smoothing over the graph, median split, gainful swaps."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(len(nodes))
    near = place[graph[nodes]]
    src, dst = np.repeat(np.arange(len(nodes)), near.shape[1])[near.ravel() >= 0], near.ravel()[near.ravel() >= 0]
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    degree = np.maximum(1, np.bincount(src, minlength=len(nodes)))
    x = rng.standard_normal(len(nodes))
    for _ in range(60):
        x -= np.average(x, weights=degree)
        x = 0.5 * x + 0.5 * np.bincount(src, x[dst], len(nodes)) / degree
        x /= np.abs(x).max() + 1e-12
    side = np.zeros(len(nodes), np.int8)
    side[np.argsort(x, kind="stable")[len(nodes) // 2 :]] = 1
    for _ in range(20):
        across = np.bincount(src, side[src] != side[dst], len(nodes))
        gain = 2 * across - np.bincount(src, minlength=len(nodes))
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = np.flatnonzero(gain[a[:n]] + gain[b[:n]] > 0)[: max(1, n // 20)]
        if not len(swap):
            break
        before = across.sum()
        side[a[swap]], side[b[swap]] = 1, 0
        if (side[src] != side[dst]).sum() >= before:
            side[a[swap]], side[b[swap]] = 0, 1
            break
    return nodes[side == 0], nodes[side == 1]


def partition(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each node; `parts` is a power of two; sizes differ by little."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [h for g in groups for h in _bisect(g, graph, rng)]
    out = np.zeros(len(graph), np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


@dataclass
class Router:
    """A network of one hidden layer from vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each row, best first."""
        z = self.logits(unit(x))
        return np.argsort(-z, axis=1, kind="stable")[:, :m]


def parts_of(n: int) -> int:
    """How many parts n vectors get: a power of two near an eighth of the root, so that parts grow as their number does."""
    return 2 ** int(np.clip(np.round(np.log2(max(1.0, np.sqrt(n) / 8))), 1, np.log2(MAX_PARTS)))


def fit(x: np.ndarray, parts: int, k: int = K, seed: int = 3) -> Router:
    """Cuts the neighbour graph of the rows of x and trains the router."""
    x, rng = unit(x), np.random.default_rng(seed)
    d, scale = x.shape[1], np.float32(1 / np.sqrt(max(1, x.shape[1])))
    graph = neighbours(x, k)
    part = partition(graph, parts)
    soft = np.zeros((len(x), parts), np.float32)
    soft[np.arange(len(x)), part] = 0.5
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), np.float32(0.5 / max(1, graph.shape[1])))
    p = [rng.standard_normal((d, HIDDEN)).astype(np.float32) * scale, np.zeros(HIDDEN, np.float32), rng.standard_normal((HIDDEN, parts)).astype(np.float32) * np.float32(0.09), np.zeros(parts, np.float32)]
    mean, var, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            i = order[lo : lo + 128]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            q = (q / q.sum(1, keepdims=True) - soft[i]) / len(i)
            back = (q @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ back, back.sum(0), h.T @ q, q.sum(0))):
                mean[j] = 0.9 * mean[j] + 0.1 * g
                var[j] = 0.999 * var[j] + 0.001 * g * g
                p[j] -= np.float32(0.003) * (mean[j] / (1 - 0.9**step)) / (np.sqrt(var[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*(a.astype(np.float32) for a in p))


def probes_for(route: np.ndarray, query: np.ndarray, part: np.ndarray, target: float) -> int:
    """The least number of parts to visit for a recall of `target`; true neighbours lie in `part` of rows `query` of route."""
    parts = route.shape[1]
    when = np.argsort(route, axis=1)[query, part]  # the turn in which the query visits the neighbour's part
    recall = np.cumsum(np.bincount(when, minlength=parts)) / max(1, len(when))
    return int(np.argmax(recall >= target)) + 1 if len(when) else parts


# --- vectors as bytes: 4 a number, unit length
def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of vectors."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [np.frombuffer(c.buffers()[2], np.uint8)[(o := np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1])[0] : o[-1]] for c in chunks if len(c)]
    return np.concatenate(rows or [np.zeros(0, np.uint8)]).view(np.float32).reshape(-1, dim)


def _packed(x: np.ndarray) -> pa.Array:
    n, w = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(w)), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _pack(batches, dim: int):
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([batch.column(0), _packed(unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))], names=["id", "v"])


def _file(batches, router: Router, dim: int):
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([*batch.columns, pa.array(router.top(_matrix(batch.column(1), dim), 1)[:, 0].astype(np.int32))], names=["id", "v", "part"])


def _route(batches, router: Router, dim: int, m: int):
    for batch in batches:
        if batch.num_rows:
            top = router.top(_matrix(batch.column(1), dim), m).astype(np.int32)
            yield pa.record_batch([*batch.columns, C.list_array(np.arange(len(top) + 1) * top.shape[1], pa.array(top.ravel()))], names=["id", "v", "parts"])


def _best(qid: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, rounded similarity) of the k best others of each query, by similarity, then id; ids ascend."""
    n, out = min(k + 1, len(ids)), []
    for lo in range(0, len(qid), 256):
        part = qid[lo : lo + 256]
        s = y[lo : lo + 256] @ x.T
        own = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
        here = np.flatnonzero(ids[own] == part)
        s[here, own[here]] = -9
        least = np.partition(s, len(ids) - n, 1)[:, len(ids) - n]
        row, col = np.nonzero(s >= (least - 2 * 10.0**-DIGITS)[:, None])  # with all that may tie once rounded
        val = np.where(s[row, col] < -2, -9, np.round(np.einsum("ij,ij->i", y[lo + row].astype(np.float64), x[col].astype(np.float64)), DIGITS))
        order = np.lexsort((ids[col], -val, row))
        row, col, val = row[order], col[order], val[order]
        ok = (np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < k) & (val > -2)
        out.append((row[ok] + lo, col[ok], val[ok]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_FOUND = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("s", pa.float64())])


def _true(batches, qid: np.ndarray, y: np.ndarray, dim: int, k: int):
    """Of one task's rows the k best for each query: one row each."""
    q, i, p, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, part = ids[order], _matrix(batch.column(1), dim)[order], batch.column(2).to_numpy()[order]
        if not len(ids):
            continue
        row, col, val = _best(qid, y, ids, x, k)
        q, i, p, s = np.concatenate([q, row]), np.concatenate([i, ids[col]]), np.concatenate([p, part[col]]), np.concatenate([s, val])
        order = np.lexsort((i, -s, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        q, i, p, s = q[order], i[order], p[order], s[order]
    yield pa.record_batch([pa.array(q), pa.array(i), pa.array(p), pa.array(s)], schema=_FOUND)


def _rerank(dim: int, k: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        """The k best points of one group for each of its queries, exactly."""
        if not len(points) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        ids, x = points.column("id").to_numpy(), _matrix(points.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        qid = queries.column("id").to_numpy()
        row, col, val = _best(qid, _matrix(queries.column("v"), dim), ids[order], x[order], k)
        return pa.table({"q": qid[row], "id": ids[order][col], "s": val})

    return search


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): for every row whose id is divisible by `every` its about k most similar other rows, of all rows.

    Similarity is the cosine, rounded to 6 digits; ranks go by it, then by id. Rows with a null id, a null or empty vector, or one
    that holds a null or is not of the commonest length (the larger of equally common ones) take no part. A vector of zeros has
    similarity 0 to all. Rows that share an id, repeated rows included, are one vector (the smallest). Equal vectors are each other's neighbours. Other columns,
    whatever their names, don't matter; an empty table or a single row gives none.
    """
    found = search(vectors, k, every, id_col, vec_col, target)[0]
    return found.select(F.col("q").alias(id_col), "rank", F.col("id").alias("neighbour_id"), F.col("s").alias("similarity"))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> tuple[DataFrame, dict]:
    """nearest() as (q, rank, id, s), and about it: parts, probes, sample, recall on the calibration queries' neighbours."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "q long, rank int, id long, s double")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    src = C.cut(src.groupBy("id").agg(F.min("v").alias("v")))
    lengths = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return none, {}
    dim, n = lengths[0]
    parts = parts_of(n)
    packed = src.where(F.size("v") == dim).mapInArrow(lambda it: _pack(it, dim), "id long, v binary")
    is_query = F.col("id") % every == 0
    known = packed.where(is_query).orderBy(F.xxhash64("id")).limit(CALIBRATION).toArrow()
    size = min(SAMPLE, PER_PART * parts, n)
    x = _matrix(packed.where(F.col("id") % every != 0 if every > 1 else F.lit(True)).orderBy(F.xxhash64("id", F.lit(1))).limit(size).toArrow().column("v"), dim)  # SAMPLE rows at most
    if not len(known):
        return none, {}
    router = fit(x if len(x) else _matrix(known.column("v"), dim), parts, k)
    points = C.cut(packed.mapInArrow(lambda it: _file(it, router, dim), "id long, v binary, part int"))
    qid, y = known.column("id").to_numpy(), _matrix(known.column("v"), dim)
    true = points.mapInArrow(lambda it: _true(it, qid, y, dim, k), "q long, id long, part int, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    true = true.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "part").toPandas()  # k x CALIBRATION rows at most
    route = router.top(y, parts)
    m = probes_for(route, true["q"].to_numpy(np.int64), true["part"].to_numpy(np.int64), target)
    queries = points.where(is_query).select("id", "v").mapInArrow(lambda it: _route(it, router, dim, m), "id long, v binary, parts array<int>").select("id", "v", F.explode("parts").alias("part"))
    # A part's points, and the queries that visit it, are spread over groups of about CHUNK of either.
    held, asked = (F.broadcast(df.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))) for df, name in ((points, "kp"), (queries, "kq")))  # a row a part
    at = lambda c: F.pmod(F.xxhash64("id", F.lit(2)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    points = points.join(held, "part").join(asked, "part").select("part", at("kp").alias("i"), each("kq").alias("j"), "id", "v")
    queries = queries.join(held, "part").join(asked, "part").select("part", each("kp").alias("i"), at("kq").alias("j"), "id", "v")
    found = points.groupBy("part", "i", "j").cogroup(queries.groupBy("part", "i", "j")).applyInArrow(_rerank(dim, k), "q long, id long, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "rank", "id", "s")
    hit = (route[true["q"].to_numpy(np.int64), :m] == true["part"].to_numpy(np.int64)[:, None]).any(1)
    return out, {"parts": parts, "probes": m, "sample": len(x), "recall": float(hit.mean()) if len(hit) else 1.0}
