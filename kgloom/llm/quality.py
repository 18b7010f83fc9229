"""Document quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed words, word pairs and character n-grams; a softmax layer
on that average gives the class. Both are trained together by stochastic gradient descent in numpy, on at
most MAX_TRAIN labelled documents (those with the smallest hash of their id). Since the output layer is
linear, executors score whole texts with one table lookup a feature: vector times output weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 17
NGRAMS = (3, 4)
DIM = 12
STEPS = 1200  # updates, however many labelled documents there are
RATE = 4.0
BATCH = 16
MAX_TRAIN = 3000
HELD_OUT = 5  # every fifth training document sets the cut-off instead of weights
REJECT_GOOD = 0.002  # share of held-out good documents that the cut-off may reject


def _features(texts: list[str | None], buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS):
    """Yields (feature of each position, 0 where there is none; document starts), words, word pairs, then each n.

    Words are runs of other than white space, case kept; n-grams lie within a word and its two boundaries.
    """
    _, space, _ = C.char_tables()
    cp, starts = C.codepoints(["\n" + (t or "") for t in texts])  # a gap on both sides: no n-gram reaches into the next text
    gap = space[np.minimum(cp, C._TABLE - 1)] & (cp < C._TABLE)
    begin, end = C.runs(~gap)
    words, at = C.span_hashes(cp, begin, end), np.searchsorted(begin, starts)
    yield (words % C.U64(buckets - 1)).astype(np.int32) + 1, at
    # A word pair is hashed by what differs between its words, so that immediate repetition, of whatever word, is one feature.
    pair = (C.mix(words[1:] ^ words[:-1]) % C.U64(buckets - 1)).astype(np.int32) + 1
    pair = np.append(pair, 0)
    pair[at[1:][at[1:] > 0] - 1] = 0  # a text's last word has no successor
    yield pair[: len(words)], at
    c = np.where(gap, np.uint32(32), cp).astype(np.uint64)
    inner = np.concatenate(([0], np.cumsum(gap)))
    for n in ngrams:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * C.U64(0x9E3779B97F4A7C15) + c[j : j + m]
        ids = ((h ^ (h >> C.U64(29))) * C.U64(0xBF58476D1CE4E5B9) >> C.U64(33)) % C.U64(buckets - 1)
        ok = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]  # no gap but at the first or last place
        yield np.where(ok, ids.astype(np.int32) + 1, 0), np.minimum(starts, m)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the ranges between successive entries of at; empty ranges give 0."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Model:
    weights: np.ndarray  # (buckets, 2): a feature's logits
    bias: np.ndarray
    cut: float  # documents whose probability of being good is lower are rejected
    held_out: dict

    def good(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the good class; NaN for a text without features."""
        margin = (self.weights[:, 1] - self.weights[:, 0]).astype(np.float32)
        out = np.full(len(texts), np.nan)
        for lo, hi in C.slices(texts):
            s, n = np.zeros(hi - lo), np.zeros(hi - lo)
            for ids, at in _features(texts[lo:hi], len(margin)):
                s += _sums(margin[ids], at)
                n += _sums(ids > 0, at)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[lo:hi] = 1 / (1 + np.exp(-(s / n + self.bias[1] - self.bias[0])))
        return out


def bags(texts: list[str], buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their shares."""
    out = []
    for t in texts:
        ids = np.concatenate([x for x, _ in _features([t], buckets)])
        u, n = np.unique(ids[ids > 0], return_counts=True)
        out.append((u, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _batches(train: np.ndarray, steps: int, rng):
    """`steps` batches, from one shuffled pass over the rows after the other."""
    left = np.zeros(0, np.int64)
    for _ in range(steps if len(train) else 0):
        while len(left) < min(BATCH, len(train)):
            left = np.concatenate([left, rng.permutation(train)])
        yield left[:BATCH]
        left = left[BATCH:]


def fit(texts: list[str], good: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS, seed: int = 5) -> Model:
    """Trains on all but every HELD_OUT-th text; those set the cut-off and give `held_out` figures."""
    rng = np.random.default_rng(seed)
    sets, y = bags(texts, buckets), np.asarray(good, np.int64)
    held = np.arange(len(sets)) % HELD_OUT == HELD_OUT - 1
    train = np.flatnonzero(~held & np.fromiter((len(s[0]) > 0 for s in sets), bool, len(sets)))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(y[train], minlength=2) / max(1, len(train))
    balance = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0).astype(np.float32)  # both classes weigh the same
    for step, pick in enumerate(_batches(train, steps, rng)):
        x = np.stack([w @ emb[ids] for ids, w in (sets[i] for i in pick)])
        z = x @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        p *= (balance[y[pick]] / len(pick))[:, None]
        rate = np.float32(RATE * (1 - step / steps))
        grad = (rate * len(pick)) * (p @ out.T)
        out -= rate * (x.T @ p)
        bias -= rate * p.sum(0)
        for i, g in zip(pick, grad):
            ids, w = sets[i]  # distinct ids, so plain subtraction will do
            emb[ids] -= w[:, None] * g
    weights = emb @ out
    weights[0] = 0
    model = Model(weights.astype(np.float32), bias, 0.5, {})
    if held.any():
        p, yy = model.good([texts[i] for i in np.flatnonzero(held)]), y[held]
        yy, p = yy[~np.isnan(p)], p[~np.isnan(p)]
        if (yy == 1).any():
            model.cut = float(min(0.5, np.quantile(p[yy == 1], REJECT_GOOD)))
        keep = p >= model.cut
        model.held_out = {"n": len(yy), "good_kept": float(keep[yy == 1].mean()) if (yy == 1).any() else 1.0, "bad_rejected": float((~keep[yy == 0]).mean()) if (yy == 0).any() else 1.0, "accuracy": float((keep == yy).mean()) if len(yy) else 1.0}
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on labelled documents with text: of more than `max_train`, those with the smallest hash of the id."""
    y = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("good")).where("i is not null and good in (0, 1)").groupBy("i").agg(F.max("good").alias("good"))
    x = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("trim(t) <> ''")
    y = y.join(x.select("i"), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(max_train)  # ids alone are moved
    rows = x.join(F.broadcast(y), "i").groupBy("i", "good").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i").toPandas()  # at most max_train
    return fit(rows["t"].tolist(), rows["good"].to_numpy())


def _good(model: Model, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[model.good(part) for _, _, part in C.parts(texts)]])


def _score(batches, model: Model):
    for batch in batches:
        p = _good(model, batch.column(1))
        yield pa.record_batch([batch.column(0), pa.array(p, mask=np.isnan(p))], names=["i", "p"])


def _keep(batches, model: Model, at: int):
    for batch in batches:
        yield batch.filter(pa.array(_good(model, batch.column(at)) >= model.cut))


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, p_good, keep) of every row of docs, whole texts.

    keep: p_good is not below the cut-off, which rejects REJECT_GOOD of the held-out good documents at most
    and is 0.5 at most; a document that ties with it is kept. A text that is null or blank has p_good null and is not kept. Ids, null or repeated,
    are passed through. Labels that are null, other than 0 or 1, or of unknown documents are ignored; of two labels for a
    document the better counts. Without labels nothing is learned: p_good is 0.5 and every text with words is kept. Other columns don't matter; an empty
    table gives no rows.
    """
    model = train(docs, labels, max_train)
    src = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    out = src.mapInArrow(lambda it: _score(it, model), "i long, p double")
    return out.select(F.col("i").alias("doc_id"), F.col("p").alias("p_good"), F.coalesce(F.col("p") >= model.cut, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that score() keeps, all columns as they are; one pass, no shuffle of texts."""
    model, at = train(docs, labels, max_train), docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may come in
    return plain.mapInArrow(lambda it: _keep(it, model, at), plain.schema).toDF(*docs.columns)
