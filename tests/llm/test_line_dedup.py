import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import clashing

from kgloom.llm import line_dedup as L


def brute(rows, dropped=None):
    """{doc: text}, and into `dropped` the number of lines that went, for rows in order of (doc, line); rows have distinct ids."""
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            k = regex.sub(r"[\t\x0b\f\r\p{Z}]+", " ", line).strip(" ")
            if k and (len(k.split(" ")) >= L.MIN_WORDS or len(k) >= L.MIN_CHARS):
                if k in seen:
                    if dropped is not None:
                        dropped[i] = dropped.get(i, 0) + 1
                    continue
                seen.add(k)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=400), st.integers(0, 2**31))
def test_filter_holds_what_was_inserted_and_not_deleted(keys, seed):
    keys = np.unique(np.array(keys, np.int64) * 7919 + seed)
    f = L.build(keys)
    assert f.contains(keys).all() and f.held == len(keys)
    gone = keys[::2]
    f.delete(gone)
    assert f.held == len(keys) - len(gone) and f.contains(keys[1::2]).all()
    f2 = L.Cuckoo.load(f.dump())
    assert f2.contains(keys[1::2]).all()


def test_filter_false_alarms_are_rare():
    r = np.random.default_rng(0)
    keys = r.integers(-(2**63), 2**63 - 1, 200_000)
    f = L.build(keys)
    assert f.contains(keys).all() and f.contains(r.integers(-(2**63), 2**63 - 1, 200_000)).mean() < 0.001
    f.delete(keys[:100_000])
    assert f.contains(keys[100_000:]).all() and f.held == 100_000 and f.contains(keys[:100_000]).mean() < 0.001


def test_full_filter_says_so():
    f = L.Cuckoo(8)
    assert not f.insert(np.arange(1000, dtype=np.int64))


def make(r, n, start=0):
    pool = [f"shared line number {k} of all" for k in range(30)] + ["Of.", "", "x y", "  spaced   out line  ", "\u3000全角の空白で始まる長い行は一語でも数えられる。", "two\u00a0long\u2003words", "two long words"]
    return [(start + i, "\n".join(r.choice(pool) if r.random() < 0.5 else f"own line {start + i} {j}" for j in range(r.randrange(6)))) for i in range(n)]


def test_equals_brute_force(docs):
    rows = make(random.Random(1), 60)
    got = L.dedup_lines(docs(rows))
    dropped = {}
    assert texts(got) == brute(rows, dropped)
    assert {r["doc_id"]: r["lines_dropped"] for r in got.collect() if r["lines_dropped"]} == dropped


def test_insertions_and_deletions_are_reversible(docs, spark):
    r = random.Random(2)
    a, b, c = make(r, 30), make(r, 30, 100), make(r, 20, 200)
    index = L.LineIndex(spark).insert(docs(a))
    one = sorted(map(tuple, index.refs().collect()))
    index = index.insert(docs(b))
    assert texts(index.clean(docs(a + b))) == brute(a + b)
    index = index.insert(docs(c))
    assert texts(index.clean(docs(a + b + c))) == brute(a + b + c)
    gone = {i for i, _ in a[::2]}
    some = index.delete(docs([(i, None) for i in gone]))
    left = [x for x in a + b + c if x[0] not in gone]
    assert texts(some.clean(docs(left))) == brute(left)  # lines whose first place went come back elsewhere
    back = index.delete(docs(b + c))
    assert sorted(map(tuple, back.refs().collect())) == one
    held = {r["shard"]: L.Cuckoo.load(r["slots"]).held for r in back.filters().collect()}
    count = {r["shard"]: r["count"] for r in back._shard(back.refs(), back.shards).groupBy("shard").count().collect()}
    assert {s: h for s, h in held.items() if h} == count


def test_counts_are_exact(docs, spark):
    rows = [(1, "a b c\na b c\nd e f"), (2, "a b c"), (3, "d e f")]
    index = L.LineIndex(spark).insert(docs(rows[:2])).insert(docs(rows[2:]))
    assert sorted(r["refs"] for r in index.refs().collect()) == [2, 3]


def test_filters_save_lookups(docs, spark):
    distinct = [(i, "\n".join(f"own line {i} {j} of its own" for j in range(50))) for i in range(100)]
    first = L.LineIndex(spark).insert(docs(distinct))
    lines, asked = first.lookups()
    assert lines == 5000 and asked < 20
    again = first.insert(docs([(1000 + i, t) for i, t in distinct[:10]] + [(2000 + i, t.replace("own", "new")) for i, t in distinct[:30]]))
    lines, asked = again.lookups()
    assert lines == 2000 and 500 <= asked < 520  # the 500 known ones, and hardly any other


def test_hot_line_comes_to_its_shard_once_a_batch(spark):
    import pyarrow as pa

    hot = pa.record_batch({"h1": np.full(10_000, 7), "h2": np.full(10_000, 8), "doc": np.arange(10_000), "line": np.zeros(10_000, np.int32)})
    out = list(L._combine([hot, hot], 16))
    assert [b.num_rows for b in out] == [1, 1] and out[0].column("refs")[0].as_py() == 10_000 and out[0].column("doc")[0].as_py() == 0


def test_repeated_batches_change_nothing(docs, spark):
    rows = make(random.Random(3), 30)
    one = L.LineIndex(spark).insert(docs(rows))
    two = one.insert(docs(rows)).insert(docs(rows[:5]))
    state = lambda x: (sorted(map(tuple, x.refs().collect())), sorted(map(tuple, x.places().collect())))
    assert state(one) == state(two)


def test_shards_grow_and_logs_are_compacted(docs, spark, monkeypatch):
    monkeypatch.setattr(L, "LINES_PER_SHARD", 8)
    monkeypatch.setattr(L, "MIN_SHARDS", 2)
    monkeypatch.setattr(L, "COMPACT", 3)
    r, rows = random.Random(4), []
    index, shards = L.LineIndex(spark), []
    for k in range(3):
        more = make(r, 6 * 4**k, 1000 * k)
        rows += more
        index = index.insert(docs(more))
        shards.append(index.shards)
        if k == 1:
            index, rows = index.delete(docs([(rows[3][0], None), (None, None), (77_777, None)])), rows[:3] + rows[4:]
    assert shards == sorted(shards) and shards[-1] > shards[0] and len(index.log) < 3
    assert texts(index.clean(docs(rows))) == brute(rows)
    keys = {i: np.array([r["h1"] for r in rs]) for i in range(index.shards) if (rs := index._shard(index.refs(), index.shards).where(f"shard = {i}").collect())}
    held = {r["shard"]: L.Cuckoo.load(r["slots"]) for r in index.filters().collect()}
    assert all(held[i].contains(k).all() and held[i].held == len(k) for i, k in keys.items())


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_don_t_matter(docs, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = make(random.Random(5), 12)
    assert texts(L.dedup_lines(docs(rows))) == brute(rows)


def test_edge_cases(docs):
    long = "\n".join(f"line of text {i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (None, "one two three"), (4, "one two three"), (5, long), (6, long), (7, "a\n\nb")]
    got = L.dedup_lines(clashing(docs(rows)))
    assert "lines_dropped_" in got.columns and "a.b" in got.columns
    by = {r["doc_id"]: (r["text"], r["lines_dropped_"]) for r in got.collect()}
    assert by[1] == (None, 0) and by[2] == ("", 0) and by[3] == ("one two three", 0) and by[None] == ("one two three", 0)
    assert by[4] == ("", 1) and by[5] == (long, 0) and by[6] == ("", 50_000) and by[7] == ("a\n\nb", 0)
    assert L.dedup_lines(docs([])).collect() == []


def test_repeated_rows_are_one_document(docs):
    got = [r["text"] for r in L.dedup_lines(docs([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "a b c")])).orderBy("doc_id").collect()]
    assert got == ["a b c\nd e f", "a b c\nd e f", ""]
