"""Incremental, reversible line dedup: sharded cuckoo filters before exact reference-count tables.

State, as a log of immutable folders in the shared folder (the last that names a row holds):
  places   h1, h2, doc, line          every line that an insertion brought
  refs     h1, h2, refs, doc, line    one row a distinct line that changed: its exact count and its first place
  filters  shard, slots               one cuckoo filter a changed shard, over the shard's distinct lines
  gone     doc                        documents that a deletion took out

An insertion takes each shard's lines in order of place, block by block. A line that the filters deny is new for certain, and
no table is asked; only those that a filter knows are looked up, first among the lines of this insertion, then in `refs`. What is
a repeat is read from `refs`. A deletion lowers the counts, and removes from table and filter what falls to zero.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SLOTS = 4  # fingerprints in a bucket
LOAD = 0.8  # filters are sized for at most this share of used slots
MIN_WORDS, MIN_CHARS = 3, 20  # lines shorter in both ("Of.") are no evidence of copying and stay
LINES_PER_SHARD = 1_000_000
MIN_SHARDS = 16
BLOCK = 32_768  # lines that are held against the filters at once
COMPACT = 8  # folders in a log before it is written anew as one


# --- cuckoo filter
class Cuckoo:
    """Cuckoo filter on 64-bit keys with 16-bit fingerprints; inserts, probes and deletes arrays of keys."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        if slots is None:
            size = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
            slots = np.zeros((size, SLOTS), np.uint16)
        self.slots, self.mask = slots, np.uint64(len(slots) - 1)

    @classmethod
    def load(cls, data: bytes) -> "Cuckoo":
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.slots))

    def room(self) -> int:
        return int(self.slots.size * LOAD) - self.held

    def _split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = C.mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A))
        return np.maximum((h >> np.uint64(48)).astype(np.uint16), 1), h & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ C.mix(prints.astype(np.uint64))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, b = self._split(keys)
        o = self._other(b, p)
        return ((self.slots[b] == p[:, None]) | (self.slots[o] == p[:, None])).any(1)

    def _place(self, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Puts fingerprints in free slots of their buckets; which of them found one."""
        order = np.argsort(b, kind="stable")
        bs = b[order]
        new = np.concatenate(([True], bs[1:] != bs[:-1])) if len(bs) else np.zeros(0, bool)
        rank = np.arange(len(bs)) - np.maximum.accumulate(np.where(new, np.arange(len(bs)), 0)) if len(bs) else bs
        free = self.slots[bs] == 0
        ok = rank < free.sum(1)
        slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
        self.slots[bs[ok], slot[ok]] = p[order][ok]
        done = np.zeros(len(b), bool)
        done[order[ok]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """False where the filter is too full; it must then be rebuilt larger."""
        p, b = self._split(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(500):
            left = ~self._place(p, b)
            p, b = p[left], b[left]
            if not len(p):
                return True
            b = self._other(b, p)
            if turn % 2:  # both buckets are full: each bucket gives up one fingerprint at a time
                _, one = np.unique(b, return_index=True)
                at = rng.integers(0, SLOTS, len(one))
                out = self.slots[b[one], at].copy()
                self.slots[b[one], at] = p[one]
                was = b[one]
                p[one] = out
                empty = out == 0
                b[one] = self._other(was, out)
                keep = np.ones(len(p), bool)
                keep[one[empty]] = False
                p, b = p[keep], b[keep]
                if not len(p):
                    return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes one copy of each key's fingerprint; every key must have been inserted."""
        p, b = self._split(keys)
        pending = np.arange(len(p))
        where = b.copy()
        for turn in range(2 * SLOTS + 2):
            if not len(pending):
                return
            bs, ps = where[pending], p[pending]
            # Equal (bucket, fingerprint) pairs take one slot each, in turn.
            _, one = np.unique(bs * np.uint64(65536) + ps, return_index=True)
            match = self.slots[bs[one]] == ps[one][:, None]
            hit = match.any(1)
            self.slots[bs[one][hit], match.argmax(1)[hit]] = 0
            gone = one[hit]
            miss = one[~hit]
            where[pending[miss]] = self._other(bs[miss], ps[miss])
            pending = np.delete(pending, gone)


def build(keys: np.ndarray) -> Cuckoo:
    size = max(1, len(keys))
    while True:
        f = Cuckoo(size)
        if f.insert(keys):
            return f
        size *= 2


# --- lines of documents
def split_lines(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


_BLANKS = r"[\t\x0B\f\r\p{Z}]+"


def _key(line: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(line, _BLANKS, " "))


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, line, h1, h2) of every line long enough to count; 128 bits of hash name a line."""
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    each = src.select("doc", F.posexplode(split_lines(F.col("text"))).alias("line", "raw")).select("doc", "line", _key(F.col("raw")).alias("k"))
    each = each.where((F.length("k") >= min_chars) | (F.length("k") - F.length(F.replace("k", F.lit(" "), F.lit(""))) >= min_words - 1)).where("k <> ''")
    return each.select("doc", "line", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2")).distinct()


# --- lines of one shard
_LINE = ("h1", "h2", "refs", "doc", "line")
_ARROW = {"shard": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "refs": pa.int64(), "doc": pa.int64(), "line": pa.int32(), "maybe": pa.bool_(), "lines": pa.int64(), "asked": pa.int64(), "slots": pa.binary()}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}


def _schema(*names: str) -> str:
    return ", ".join(f"{n} {_SQL[_ARROW[n]]}" for n in names)


def _columns(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() if isinstance(table, pa.Table) else table.column(n).to_numpy(zero_copy_only=False) for n in names]


def _merged(h1, h2, refs, doc, line):
    """One row a line: counts added up, the first place."""
    order = np.lexsort((line, doc, h2, h1))
    h1, h2, refs, doc, line = (c[order] for c in (h1, h2, refs, doc, line))
    new = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))) if len(h1) else np.zeros(0, np.int64)
    return h1[new], h2[new], np.add.reduceat(refs, new) if len(new) else refs, doc[new], line[new]


def _combine(batches, shards: int):
    """Lines by shard, each once a batch: a line that fills the corpus comes to its shard as a row a batch."""
    for batch in batches:
        h1, h2, doc, line = _columns(batch, "h1", "h2", "doc", "line")
        cols = _merged(h1, h2, np.ones(len(h1), np.int64), doc, line)
        yield pa.record_batch([pa.array(np.mod(cols[0], shards).astype(np.int32)), *map(pa.array, cols)], names=["shard", *_LINE])


class Seen:
    """Exact table of lines, as sorted runs of doubling length."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, h1: np.ndarray, h2: np.ndarray, rows: np.ndarray) -> None:
        self.runs.append((h1, h2, rows))
        while len(self.runs) > 1 and len(self.runs[-1][0]) * 2 > len(self.runs[-2][0]):
            a, b = self.runs.pop(), self.runs.pop()
            self.runs.append(tuple(map(np.concatenate, zip(b, a))))
        a = self.runs[-1]
        order = np.argsort(a[0], kind="stable")
        self.runs[-1] = tuple(c[order] for c in a)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Row of each line, -1 where it isn't there."""
        out = np.full(len(h1), -1, np.int64)
        for a, b, rows in self.runs:
            at = np.searchsorted(a, h1)
            left = np.arange(len(h1))
            while len(left):  # lines with the same first half stand side by side
                left = left[(at[left] < len(a)) & (out[left] < 0)]
                left = left[a[at[left]] == h1[left]]
                same = b[at[left]] == h2[left]
                out[left[same]] = rows[at[left[same]]]
                at[left] += 1
        return out


def _stored(filters: pa.Table) -> Cuckoo | None:
    return Cuckoo.load(filters.column("slots")[0].as_py()) if len(filters) and filters.column("slots")[0].is_valid else None


def _table(names: list[str], **cols) -> pa.Table:
    n = max(len(c) for c in cols.values())
    return pa.table({k: pa.array(cols[k], _ARROW[k]) if k in cols else pa.nulls(n, _ARROW[k]) for k in names})


_ADMITTED = ["shard", *_LINE, "maybe", "lines", "asked", "slots"]


def _admit(lines: pa.Table, filters: pa.Table) -> pa.Table:
    """Lines of one insertion and shard, each once; `maybe` those that the stored filter knows and that must be looked up in `refs`.

    And a row with the filter over all lines so far but those, how many lines came, and how many of them were looked up here.
    """
    if not len(lines):
        return _table(_ADMITTED, shard=[])
    shard = lines.column("shard")[0].as_py()
    h1, h2, refs, doc, line = _columns(lines, *_LINE)
    order = np.lexsort((line, doc))
    old, now, seen = _stored(filters), Cuckoo(len(h1)), Seen()
    held, maybe, asked = [np.zeros(0, c.dtype) for c in (h1, h2, refs, doc, line)], np.zeros(0, bool), 0
    for lo in range(0, len(order), BLOCK):
        at = order[lo : lo + BLOCK]
        b = _merged(h1[at], h2[at], refs[at], doc[at], line[at])
        known = now.contains(b[0])
        row = np.full(len(b[0]), -1, np.int64)
        row[known] = seen.find(b[0][known], b[1][known])
        asked += int(known.sum())
        hit, new = row >= 0, row < 0
        held[2][row[hit]] += b[2][hit]  # places come in order, so the first one stands
        rows = len(held[0]) + np.arange(new.sum())
        held = [np.concatenate([x, y[new]]) for x, y in zip(held, b)]
        maybe = np.concatenate([maybe, old.contains(b[0][new]) if old else np.zeros(new.sum(), bool)])
        seen.add(b[0][new], b[1][new], rows)
        if not now.insert(b[0][new]):
            now = build(held[0])
    if old is None:
        slots = now.dump()
    else:
        fresh = held[0][~maybe]
        slots = old.dump() if old.room() >= len(fresh) and old.insert(fresh) else None
    out = _table(_ADMITTED, shard=np.full(len(maybe), shard, np.int32), **dict(zip(_LINE, held)), maybe=maybe)
    return pa.concat_tables([out, _table(_ADMITTED, shard=[shard], lines=[len(h1)], asked=[asked], slots=[slots])])


_FILTER = ["shard", "slots"]


def _add(keys: pa.Table, filters: pa.Table) -> pa.Table:
    f = _stored(filters)
    full = f is None or f.room() < len(keys) or not f.insert(keys.column("h1").to_numpy())
    return _table(_FILTER, shard=[keys.column("shard")[0].as_py()], slots=[None if full else f.dump()])


def _remove(keys: pa.Table, filters: pa.Table) -> pa.Table:
    if (f := _stored(filters)) is not None:
        f.delete(keys.column("h1").to_numpy())
    return _table(_FILTER, shard=[keys.column("shard")[0].as_py()], slots=[f.dump() if f else None])


def _rebuild(lines: pa.Table) -> pa.Table:
    return _table(_FILTER, shard=[lines.column("shard")[0].as_py()], slots=[build(lines.column("h1").to_numpy()).dump()])


# --- the index
@dataclass(frozen=True)
class LineIndex:
    """An immutable version of the index; insert and delete return the next version.

    Only rows that change are written. A document that is indexed already is left as it is by a second insertion (delete it first to
    replace it), so repeated batches change nothing. Null ids and null texts are not indexed; rows that share an id
    are one document; a deletion of unknown or null ids changes nothing; empty tables are allowed; other columns don't matter.
    """

    spark: SparkSession
    log: tuple[str, ...] = ()
    shards: int = 0
    min_words: int = MIN_WORDS
    id_col: str = "doc_id"
    text_col: str = "text"

    def _read(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def _has(self, folder: str, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _latest(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        """Rows of the log's last word on each key."""
        found = [(v, f) for v, f in enumerate(self.log) if self._has(f, name)]
        if not found:
            return self.spark.createDataFrame([], schema)
        if len(found) == 1:
            return self._read(found[0][1], name, schema)
        rows = None
        for v, f in found:
            df = self._read(f, name, schema).withColumn("v", F.lit(v))
            rows = df if rows is None else rows.union(df)
        if name == "filters":  # large rows, few of them: the last version of each shard is found first
            return rows.join(F.broadcast(rows.groupBy("shard").agg(F.max("v").alias("v"))), ["shard", "v"], "left_semi").drop("v")
        rest = [c for c in rows.columns if c not in (*keys, "v")]
        return rows.groupBy(*keys).agg(F.max(F.struct("v", *rest)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])

    def refs(self) -> DataFrame:
        """(h1, h2, refs, doc, line): the exact count and first place of every line."""
        return self._latest("refs", _schema(*_LINE), ["h1", "h2"]).where("refs > 0")

    def filters(self) -> DataFrame:
        return self._latest("filters", _schema(*_FILTER), ["shard"])

    def places(self) -> DataFrame:
        """(h1, h2, doc, line) of every indexed line."""
        out, gone = self.spark.createDataFrame([], _schema("h1", "h2", "doc", "line")), None
        for f in reversed(self.log):
            if self._has(f, "gone"):
                here = self._read(f, "gone", _schema("doc"))
                gone = here if gone is None else gone.union(here)
            if self._has(f, "places"):
                here = self._read(f, "places", _schema("h1", "h2", "doc", "line"))
                out = out.union(here if gone is None else here.join(gone.distinct(), "doc", "left_anti").select("h1", "h2", "doc", "line"))
        return out

    def lookups(self) -> tuple[int, int]:
        """(lines that came to a shard in the last insertion, those of them that a filter knew, so that a table was asked)."""
        r = self._read(self.log[-1], "admitted", _schema("lines", "asked", "maybe")).agg(F.coalesce(F.sum("lines"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0)) + F.count_if("maybe")).first()
        return r[0], r[1]

    def _next(self, **changes) -> "tuple[LineIndex, str]":
        folder = f"{C.shared_dir(self.spark)}/lines-{uuid.uuid4().hex}"
        return replace(self, log=(*self.log, folder), **changes), folder

    def _shard(self, df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Index every line of docs that are not indexed. Shards double as lines come in, at LINES_PER_SHARD each at most, about."""
        fresh = lines_of(docs, self.id_col, self.text_col, self.min_words).select("h1", "h2", "doc", "line")
        if self.log:
            fresh = fresh.join(self.places().select("doc").distinct(), "doc", "left_anti").select("h1", "h2", "doc", "line")
        nxt, folder = self._next()
        fresh.write.parquet(f"{folder}/places")
        fresh = self._read(folder, "places", _schema("h1", "h2", "doc", "line"))
        lines = fresh.count() + (self.refs().count() if self.log else 0)
        shards = max(self.shards, MIN_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1, lines) / LINES_PER_SHARD)))))
        nxt = replace(nxt, shards=shards)
        filters = self._sharded_filters(shards)
        combined = fresh.mapInArrow(lambda it: _combine(it, shards), _schema("shard", *_LINE))
        # A task a shard: its work is Python's, which the size of its rows doesn't show.
        admitted = combined.repartition(shards, "shard").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_admit, _schema(*_ADMITTED))
        admitted.write.parquet(f"{folder}/admitted")
        admitted = self._read(folder, "admitted", _schema(*_ADMITTED))
        rows, made = admitted.where("h1 is not null"), admitted.where("lines is not null").select(*_FILTER)
        if not self.log:
            rows.select(*_LINE).write.parquet(f"{folder}/refs")
            made.write.parquet(f"{folder}/filters")
            return nxt
        asked, known = rows.where("maybe"), self.refs().select("h1", "h2", *[F.col(c).alias(f"old_{c}") for c in ("refs", "doc", "line")])
        found = C.cut(asked.join(known, ["h1", "h2"], "left"))
        first = F.least(F.struct("doc", "line"), F.when(F.col("old_doc").isNotNull(), F.struct(F.col("old_doc").alias("doc"), F.col("old_line").alias("line"))))
        merged = found.select("h1", "h2", (F.col("refs") + F.coalesce("old_refs", F.lit(0))).alias("refs"), first.alias("at")).select("h1", "h2", "refs", "at.doc", "at.line")
        rows.where("not maybe").select(*_LINE).union(merged).write.parquet(f"{folder}/refs")
        # Lines that the filter only seemed to know get their own fingerprint.
        false = found.where("old_refs is null").select("shard", "h1")
        held = made if shards == self.shards else filters.join(made.select("shard"), "shard", "left_anti").union(made)
        nxt._write_filters(folder, held, false, _add)
        return nxt._compacted()

    def _sharded_filters(self, shards: int) -> DataFrame:
        """The filters; built anew from `refs` where the number of shards has changed."""
        if not self.log or shards == self.shards:
            return self.filters()
        return C.cut(self._shard(self.refs().select("h1"), shards).groupBy("shard").applyInArrow(_rebuild, _schema(*_FILTER)))

    def _write_filters(self, folder: str, held: DataFrame, keys: DataFrame, change) -> None:
        """`held`, changed by the keys of each shard; a filter that is too full (null) is built anew from `refs`."""
        touched = C.cut(keys.groupBy("shard").cogroup(held.join(F.broadcast(keys.select("shard").distinct()), "shard", "left_semi").groupBy("shard")).applyInArrow(change, _schema(*_FILTER)))
        now = C.cut(held.join(F.broadcast(touched.select("shard")), "shard", "left_anti").union(touched))
        full = now.where("slots is null").select("shard")
        again = self._shard(self.refs().select("h1"), self.shards).join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInArrow(_rebuild, _schema(*_FILTER))
        now.where("slots is not null").union(again).write.parquet(f"{folder}/filters")

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Forget every line of these documents (a DataFrame with the id column)."""
        nxt, folder = self._next()
        doc_ids.select(F.col(self.id_col).cast("long").alias("doc")).where("doc is not null").distinct().write.parquet(f"{folder}/gone")
        gone = self._read(folder, "gone", _schema("doc"))
        lost = C.cut(self.places().join(gone, "doc", "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("lost")))
        touched = self.refs().join(lost, ["h1", "h2"])
        first = nxt.places().join(lost.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("at"))
        left = C.cut(touched.join(first, ["h1", "h2"], "left").select("h1", "h2", (F.col("refs") - F.col("lost")).alias("refs"), "at.doc", "at.line"))
        left.write.parquet(f"{folder}/refs")
        zero = self._shard(left.where("refs = 0").select("h1"), self.shards).select("shard", "h1")
        nxt._write_filters(folder, self.filters(), zero, _remove)
        return nxt._compacted()

    def _compacted(self) -> "LineIndex":
        """This version, written anew in one folder where its log has grown to COMPACT folders; older versions keep theirs."""
        if len(self.log) < COMPACT:
            return self
        folder = f"{C.shared_dir(self.spark)}/lines-{uuid.uuid4().hex}"
        for name in ("places", "refs", "filters"):
            getattr(self, name)().write.parquet(f"{folder}/{name}")
        self._read(self.log[-1], "admitted", _schema(*_ADMITTED)).write.parquet(f"{folder}/admitted") if self._has(self.log[-1], "admitted") else None
        return replace(self, log=(folder,))

    def repeats(self) -> DataFrame:
        """(doc, line) of all indexed lines that are not the first of their kind, which `refs` names."""
        many = self.refs().where("refs > 1").select("h1", "h2", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
        return self.places().join(many, ["h1", "h2"]).where("doc <> first_doc or line <> first_line").select("doc", "line")

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with repeated lines taken out of the text, and how many went (column dropped_column(docs))."""
        gone = self.repeats().groupBy("doc").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("doc", "__doc")
        kept = F.filter(split_lines(F.col("__text")), lambda x, i: ~F.array_contains("__gone", i))
        text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
        out = docs.select(F.struct("*").alias("row"), F.col(self.id_col).cast("long").alias("__id"), F.col(self.text_col).cast("string").alias("__text"))
        out = out.join(gone, F.col("__id") == F.col("__doc"), "left")
        cols = [text.alias(c) if c == self.text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
        return out.select(*cols, F.coalesce(F.size("__gone"), F.lit(0)).alias(dropped_column(docs)))


def dropped_column(docs: DataFrame) -> str:
    """`lines_dropped`, with underscores added while docs has a column of that name."""
    name, taken = "lines_dropped", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that occur earlier (by document id, then line number), plus `lines_dropped`.

    Lines are compared with outer blanks trimmed and inner blanks (of any script) collapsed; those of fewer than
    `min_words` words and of fewer than MIN_CHARS characters, blank ones included, stay. Null and empty texts, and rows with a null id, pass
    unchanged. Rows that share an id are one document: where all copies hold a line at the same place, it is
    one line, kept or dropped in each. A document whose lines are all repeats keeps its row, with what blank
    or short lines it has. Texts of any length are read whole. Other columns pass unchanged, whatever their
    names; where one is called `lines_dropped`, the new column has an underscore more. An empty table gives an empty table.
    """
    index = LineIndex(docs.sparkSession, min_words=min_words, id_col=id_col, text_col=text_col).insert(docs)
    return index.clean(docs)


ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM raw),
keyed AS (SELECT doc_id, line, i, trim(regexp_replace(line, '[\t\x0B\f\r\pZ]+', ' ', 'g')) AS k FROM each),
ranked AS (SELECT *, k <> '' AND (length(k) >= 20 OR length(k) - length(replace(k, ' ', '')) >= 2)
  AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS gone FROM keyed)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_dropped
FROM ranked GROUP BY doc_id
"""
