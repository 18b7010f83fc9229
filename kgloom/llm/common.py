"""Helpers shared by the training-data operators: shared storage, vectorised text, components."""

from __future__ import annotations

import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_POLY = 0x9E3779B97F4A7C15 | 1
_POLY_INV = pow(_POLY, -1, 1 << 64)
_TABLE = 0x20000


# --- shared storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir of the session.

    Only where the session names none and runs on one machine (unit tests) a temporary folder is set; on a cluster that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if jsc.getCheckpointDir().isEmpty():
        if not named and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="kgloom-ckpt-"))
    return named or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# --- text as code points
@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is word char, is white space, lower case) by code point below 0x20000."""
    chars = [chr(i) for i in range(_TABLE)]
    word = np.fromiter((c.isalnum() or c == "_" for c in chars), bool, _TABLE)
    space = np.fromiter((c.isspace() for c in chars), bool, _TABLE)
    low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, _TABLE)
    return word, space, low


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a line break, as one uint32 array; where each starts."""
    texts = [t or "" for t in texts]
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return cp, starts


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _POLY, U64), np.full(size, _POLY_INV, U64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points, in time linear in the array."""
    up, down = powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * up[: len(cp)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


def slices(texts: list[str | None], most: int = 1_000_000):
    """(from, to) row ranges of about `most` characters; a longer text stands alone, whole."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def byte_ranges(texts: pa.Array, most: int = 4_000_000):
    """(from, to) row ranges of about `most` bytes of an Arrow array; a longer text stands alone, whole."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def parts(texts: pa.Array, most: int = 1_000_000):
    """(from, to, texts) of successive ranges, so that a batch is never held twice."""
    for lo, hi in byte_ranges(texts, most):
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


# --- connected components
def components(edges: DataFrame) -> DataFrame:
    """Smallest member of each node's component, by alternating large-star and small-star rounds.

    edges: (u, v) of any orderable type. Result: (node, root), one row a node, root itself included.
    Every round ends in a reliable checkpoint; there is no limit on rounds or component size.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both if large else both.where("v <= u")
        low = both.groupBy("u").agg(F.min("v").alias("m"))  # a hub's rows are met by a join, which can be split
        m = both.join(low, "u").withColumn("m", F.least("m", "u"))
        out = m.where("v > u") if large else m
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(m.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    while seen[0]:
        now = cut(star(star(now, True), False))
        if (fresh := state(now)) == seen:
            break
        seen = fresh
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
