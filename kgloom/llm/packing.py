"""Packing token sequences into fixed windows by minimum bin slack.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus) reaches the driver. There
the longest remaining length opens a window and a bitset subset-sum program finds the multiset of remaining
lengths that fills it closest to capacity; the backtracked multiset is used as often as the counts allow.
Executors then map (length, rank within the length) to a window, without moving a text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .sentencepiece_codec import MODEL, with_token_counts

CAPACITY = 2048
PER_BUCKET = 100_000  # pieces that are ranked in one place, about: each length is ranked in as many parts as that takes


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum not above room, found on a bitset, read back from its stages."""
    reach, full, stages = 1, (1 << (room + 1)) - 1, []
    for size in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, step = min(counts[size], room // size), 1
        while left:
            times = min(step, left)
            stages.append((size, times, reach))
            reach |= (reach << (size * times)) & full
            left, step = left - times, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for size, times, before in reversed(stages):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + times
            total -= size * times
    return used


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Segments (length, rank, each, window, place): from `rank` on, `each` pieces of a length go to each window from `window` on."""
    left, window, taken, rows = dict(counts), 0, dict.fromkeys(counts, 0), []
    for size in sorted(counts, reverse=True):
        while left[size]:
            left[size] -= 1
            use = best_fill(left, capacity - size)
            left[size] += 1
            use[size] = use.get(size, 0) + 1
            times = min(left[x] // n for x, n in use.items())
            place = 0
            for x in sorted(use, reverse=True):
                rows.append((x, taken[x], use[x], window, place))
                taken[x] += use[x] * times
                left[x] -= use[x] * times
                place += use[x]
            window += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "window", "place"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def _assign(batches, segments: pd.DataFrame, stride: int):
    key = segments["length"].to_numpy() * stride + segments["rank"].to_numpy()
    rank, each, window, place = (segments[c].to_numpy() for c in ("rank", "each", "window", "place"))
    for pdf in batches:
        at = np.searchsorted(key, pdf["length"].to_numpy() * stride + pdf["rank"].to_numpy(), side="right") - 1
        local = pdf["rank"].to_numpy() - rank[at]
        yield pd.DataFrame({"window_id": window[at] + local // each[at], "position": (place[at] + local % each[at]).astype("int32"), "doc_id": pdf["doc"], "start": pdf["start"], "length": pdf["length"]})


def pack(lengths: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(window_id, position, doc_id, start, length): every token of every document in exactly one window.

    A sequence longer than `capacity` is cut into full windows and a rest; no window holds more than
    `capacity`. Null, zero and negative lengths hold nothing and give no row; null ids are ignored; rows that share an id are
    packed each for itself, and ties are placed by a hash of (id, start), then by id and start. Other columns, whatever their names, don't matter.
    An empty table gives no rows. The assignment does not depend on how the input is partitioned.
    """
    src = lengths.select(F.col(id_col).cast("long").alias("doc"), F.col(length_col).cast("long").alias("n")).where("doc is not null and n > 0")
    cap = F.lit(capacity)
    pieces = src.select("doc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("k"))
    pieces = pieces.select("doc", (F.col("k") * cap).alias("start"), F.least(F.col("n") - F.col("k") * cap, cap).cast("long").alias("length"))
    pieces = C.cut(pieces)
    buckets = max(1, -(-pieces.count() // PER_BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "start"), F.lit(buckets)).cast("int"))  # the pieces of one document spread, too
    parts = C.cut(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    offset = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments = plan(histogram, capacity)
    stride = max([1, *histogram.values()]) + 1
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "start")) - 1
    ranked = pieces.withColumn("inner", inner).join(offset.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc", "start", "length", (F.coalesce("before", F.lit(0)) + F.col("inner")).cast("long").alias("rank"))
    out = ranked.mapInPandas(lambda it: _assign(it, segments, stride), "window_id long, position int, doc_id long, start long, length long")
    return out.withColumnRenamed("doc_id", id_col)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """pack() over the token counts of whole texts."""
    return pack(with_token_counts(docs, model).select("doc_id", "n_tokens"), capacity)
