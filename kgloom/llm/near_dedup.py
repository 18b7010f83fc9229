"""Near-duplicate groups by min-max hashing.

Each of `PERMUTATIONS` hash permutations of a document's word shingles yields its minimum *and* its
maximum, so 2 x PERMUTATIONS signature values cost half the hash evaluations; both are unbiased
estimators of the Jaccard similarity. Bands of ROWS values make candidates; inside a bucket the exact
connected components of "estimated similarity >= THRESHOLD" are found, and components of all buckets
are joined. No bucket is capped: one of more than MOST documents is split into blocks, whose components are joined
through representatives, block of representatives by block; only what then remains unlinked in it is compared block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 3  # words
PERMUTATIONS = 96
ROWS = 4  # signature values in a band
THRESHOLD = 0.45
MOST = 4096  # documents of a bucket that are compared in one place, about
ROWS_PER_TASK = 40_000  # members of buckets that a task compares: its work is Python's, which the size of its rows doesn't show


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * C.U64(2) + C.U64(1), rng.integers(0, 1 << 63, n, np.uint64)


def shingle_hashes(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of all texts, and how many each text has.

    A text of fewer than `width` words has one shingle of all its words; one without words has none.
    """
    word, _, low = C.char_tables()
    cp, starts = C.codepoints(texts)
    small = np.minimum(cp, C._TABLE - 1)
    begin, end = C.runs(word[small] | (cp >= C._TABLE))
    h = C.span_hashes(np.where(cp < C._TABLE, low[small], cp), begin, end)
    first = np.searchsorted(begin, starts)  # word index at which each text starts
    n_words = np.diff(first)
    n_sh = np.where(n_words == 0, 0, np.maximum(1, n_words - width + 1))
    if not n_sh.sum():
        return np.zeros(0, np.uint64), n_sh
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n_sh)[:-1])), n_sh) + np.arange(n_sh.sum())
    left = np.repeat(np.minimum(n_words, width), n_sh)
    x = np.zeros(len(at), np.uint64)
    for j in range(width):
        w = h[np.minimum(at + j, len(h) - 1)]
        x = np.where(j < left, x * C.U64(0xD6E8FEB86659FD93) + w, x)
    return C.mix(x), n_sh


def signatures(texts: list[str | None], permutations: int = PERMUTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2 * permutations) uint32 values, minimum and maximum of each permutation in turn; rows with words."""
    a, b = _constants(permutations, seed)
    out, has = np.zeros((len(texts), 2 * permutations), np.uint32), np.zeros(len(texts), bool)
    for lo, hi in C.slices(texts):
        x, n = shingle_hashes(texts[lo:hi])
        has[lo:hi] = n > 0
        if not len(x):
            continue
        rows = np.flatnonzero(n) + lo
        at = np.cumsum(n[n > 0]) - n[n > 0]
        for k in range(permutations):
            v = ((x * a[k] + b[k]) >> C.U64(32)).astype(np.uint32)
            out[rows, 2 * k] = np.minimum.reduceat(v, at)
            out[rows, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out, has


def _row_hash(v: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(v), salt, np.uint64)
    for j in range(v.shape[1]):
        h = C.mix(h * C.U64(0x9E3779B97F4A7C15) + v[:, j].astype(np.uint64))
    return h.view(np.int64)


def _sign(batches, permutations: int, rows: int, seed: int):
    for batch in batches:
        made = [signatures(texts, permutations, seed) for _, _, texts in C.parts(batch.column(1))] or [signatures([], permutations, seed)]
        sig, has = (np.concatenate(x) for x in zip(*made))
        sig, ids = sig[has], batch.column(0).filter(pa.array(has))
        bands = np.stack([_row_hash(sig[:, i : i + rows], i + 1) for i in range(0, sig.shape[1] - rows + 1, rows)], 1)
        low = np.ascontiguousarray(sig.astype(np.uint8))
        n, w = low.shape
        yield pa.record_batch(
            [
                ids,
                pa.array(_row_hash(sig, 0)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)[: n + 1]), pa.py_buffer(low)]),
                C.list_array(np.arange(n + 1) * bands.shape[1], pa.array(bands.reshape(-1))),
            ],
            names=["doc", "same", "sig", "bands"],
        )


def _needed(threshold: float, width: int) -> int:
    """Equal bytes of two signatures at an estimated similarity of `threshold`: 1 of 256 agrees by chance."""
    return int(np.ceil((threshold * 255 + 1) / 256 * width))


def _reach(sig: np.ndarray, need: int) -> np.ndarray:
    """The first row of each row's component of the similarity graph: each vertex is compared with all not yet reached."""
    root, left = np.arange(len(sig)), np.arange(len(sig))
    while len(left) > 1:
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = (sig[left] == sig[queue.pop()]).sum(1) >= need
            root[left[near]] = first
            queue.extend(left[near])
            left = left[~near]
    return root


def _roots(group: np.ndarray, sig: np.ndarray, need: int) -> np.ndarray:
    """_reach() of each run of equal groups, as rows of the whole; most groups are done by comparing all rows with their first."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    first = np.repeat(start, size)
    near = (sig == sig[first]).sum(1) >= need
    root = np.where(near, first, np.arange(len(group)))
    for g in np.flatnonzero(np.add.reduceat((~near).astype(np.int64), start) > 0):
        lo, hi = start[g], start[g] + size[g]
        root[lo:hi] = lo + _reach(sig[lo:hi], need)
    return root


def _bytes(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column of equal widths, a row each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _links(batches, threshold: float, leaders: bool):
    """(set, u, v): of rows (set, block, doc, sig), sorted, each document with its component's first one in the block; `leaders` gives (v, v) as well."""
    rest = None
    names = ["set", "u", "v"]

    def links(b: pa.RecordBatch) -> pa.RecordBatch:
        group = C.mix(b.column(0).to_numpy().view(np.uint64)) + b.column(1).to_numpy().astype(np.uint64)
        sig, doc = _bytes(b.column(3)), b.column(2).to_numpy()
        root = _roots(group, sig, _needed(threshold, sig.shape[1]))
        keep = np.arange(len(doc)) != root if not leaders else np.ones(len(doc), bool)
        return pa.record_batch([b.column(0).filter(pa.array(keep)), pa.array(doc[keep]), pa.array(doc[root][keep])], names=names)

    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        s, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = np.flatnonzero((s != s[-1]) | (k != k[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        if cut:
            yield links(batch.slice(0, cut))
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield links(rest)


def _across(threshold: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """(u, v) that join components of rows (doc, sig, root, home): within one block, or from one block to another."""
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        doc, root, home = pdf["doc"].to_numpy(), pdf["root"].to_numpy().copy(), pdf["home"].to_numpy()
        need, one = _needed(threshold, sig.shape[1]), home.min() == home.max()
        us, vs = [], []
        for i in np.flatnonzero(home == home.min()):
            other = np.flatnonzero((root != root[i]) & (one | (home != home[i])))
            hit = other[(sig[other] == sig[i]).sum(1) >= need]
            for r in np.unique(root[hit]):  # one link joins two components
                us.append(doc[hit[root[hit] == r][0]])
                vs.append(doc[i])
                root[root == r] = root[i]
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return links


def bucket_links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) that join what is alike in any bucket of reps (doc, sig, bands). A bucket is known by count and digests of its members, never by a list."""
    each = reps.select("doc", F.explode("bands").alias("bucket"))
    digest = [F.bit_xor(F.xxhash64("doc", F.lit(k))) for k in (1, 2)]
    buckets = each.groupBy("bucket").agg(F.count("*").alias("n"), digest[0].alias("a"), digest[1].alias("b")).where("n > 1")
    # Buckets with the same members are opened once.
    chosen = C.cut(buckets.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    total, most = chosen.agg(F.sum("n"), F.max("n")).first()
    members = each.join(chosen, "bucket").select(F.col("bucket").alias("set"), "n", "doc")

    def compare(rows: DataFrame, blocks: F.Column, count: int, leaders: bool, salt: int) -> DataFrame:
        src = rows.select("set", F.pmod(F.xxhash64("doc", F.lit(salt)), blocks).cast("int").alias("block"), "doc").join(reps.select("doc", "sig"), "doc").select("set", "block", "doc", "sig")
        src = src.repartition(max(1, -(-count // ROWS_PER_TASK)), "set", "block").sortWithinPartitions("set", "block", "doc")
        return src.mapInArrow(lambda it: _links(it, threshold, leaders), "set long, u long, v long")

    blocks = F.ceil(F.col("n") / MOST)
    if (most or 0) <= MOST:
        return compare(members, F.lit(1), total or 0, False, 3).select("u", "v")
    found = C.cut(compare(members, blocks, total, True, 3).join(chosen.select(F.col("bucket").alias("set"), "n"), "set"))
    links = found.where("u <> v").select("u", "v")
    leaders, turn = C.cut(found.where("u = v").where(F.col("n") > MOST).select("set", F.col("u").alias("doc"))), 4
    while True:
        size = leaders.groupBy("set").agg(F.count("*").alias("n"))
        count, most, before = size.agg(F.sum("n"), F.max("n"), F.count("*")).first()
        if not count:
            break
        found = C.cut(compare(leaders.join(size, "set"), F.ceil(F.col("n") / MOST), count, True, turn))
        links = links.union(found.where("u <> v").select("u", "v"))
        left = C.cut(found.where("u = v").select("set", F.col("u").alias("doc")))
        if most <= MOST or left.count() > 0.9 * count:
            break  # every set's representatives have met, or they are unlike
        leaders, turn = left, turn + 1
    return links.union(_unlinked(members.where(F.col("n") > MOST), reps, C.cut(links), threshold))


def _unlinked(members: DataFrame, reps: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(u, v) between what the links leave apart in sets of more than MOST members: two blocks at a time, so that no pair of components is missed."""
    roots = C.components(links)
    m = members.join(roots, members["doc"] == roots["node"], "left").select("set", "doc", F.coalesce("root", "doc").alias("root"))
    apart = m.groupBy("set").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    m = C.cut(m.join(apart.select("set", "n"), "set").join(reps.select("doc", "sig"), "doc").withColumn("blocks", F.ceil(2 * F.col("n") / MOST).cast("int")).withColumn("home", F.pmod(F.xxhash64("doc", F.lit(99)), F.col("blocks")).cast("int")))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    m = m.select("set", "doc", "sig", "root", "home", F.explode(other).alias("o")).select("set", F.least("home", "o").alias("i"), F.greatest("home", "o").alias("j"), "doc", "sig", "root", "home")

    return m.groupBy("set", "i", "j").applyInPandas(_across(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, kept_doc_id, group_size), one row for each document to remove.

    kept_doc_id is the smallest id of the group. Null ids are ignored; null, empty and wordless texts are
    like no other and never returned; rows that share an id are one document; texts of any length are read
    whole; other columns of docs, whatever their names, are not looked at. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    signed = C.cut(src.mapInArrow(lambda it: _sign(it, permutations, rows, seed), "doc long, same long, sig binary, bands array<long>"))
    reps = C.cut(signed.groupBy("same").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    links = bucket_links(reps, threshold)
    copies = signed.join(reps.select("same", F.col("doc").alias("rep")), "same").where("doc <> rep").select("doc", "rep")
    roots = C.components(links.union(copies))
    size = roots.groupBy("root").agg(F.count("*").alias("group_size"))
    return roots.join(size, "root").where("node <> root").select(F.col("node").alias(id_col), F.col("root").alias(f"kept_{id_col}"), "group_size")
