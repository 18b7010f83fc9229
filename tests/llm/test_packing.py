import itertools
import random
from collections import Counter, defaultdict

import pytest
from llm_tables import clashing
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_best_fill_equals_brute_force(counts, room):
    used = P.best_fill(counts, room)
    assert all(0 < n <= counts[x] for x, n in used.items())
    best = max(t for t in (sum(x * n for x, n in zip(counts, c)) for c in itertools.product(*(range(n + 1) for n in counts.values()))) if t <= room)
    assert sum(x * n for x, n in used.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_places_every_piece_once_and_each_window_is_the_best_left(counts):
    seg = P.plan(counts, 50)
    windows, left = defaultdict(Counter), Counter(counts)
    for length in counts:
        own = seg[seg["length"] == length].sort_values("rank").to_dict("records")
        for s, nxt in zip(own, [*own[1:], {"rank": counts[length]}]):
            assert (nxt["rank"] - s["rank"]) % s["each"] == 0
            for w in range((nxt["rank"] - s["rank"]) // s["each"]):
                windows[s["window"] + w][length] += s["each"]
    assert sorted(windows) == list(range(len(windows)))
    for w in sorted(windows):
        big = max(windows[w])
        assert big == max(x for x in left if left[x])
        rest = dict(left)
        rest[big] -= 1
        assert sum((windows[w]).elements()) == big + sum(x * n for x, n in P.best_fill(rest, 50 - big).items())
        left -= windows[w]
    assert not +left


def test_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    n = {r["doc_id"]: r["n_tokens"] for r in P.with_token_counts(d).collect()}
    rows = P.pack_documents(d, 512).collect()
    seen, fill, places = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        seen[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["window_id"]] += r["length"]
        assert r["position"] not in places[r["window_id"]]
        places[r["window_id"]].add(r["position"])
    for i, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n[i]
    assert set(seen) == {i for i in n if n[i]} and max(fill.values()) <= 512
    assert len(fill) <= 1.02 * sum(n.values()) / 512 + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, 0), (3, -5), (None, 7), (4, 10), (4, 10), (5, 10), (6, 1_000_003), (7, 3)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumnRenamed("n_tokens", "n_tokens"))
    got = P.pack(df, 100).collect()
    assert Counter(r["doc_id"] for r in got) == {4: 2, 5: 1, 6: 10_001, 7: 1}
    assert max(Counter({w: 0 for w in ()} | {}).values(), default=0) == 0
    fill = Counter()
    for r in got:
        fill[r["window_id"]] += r["length"]
    assert max(fill.values()) == 100 and len(fill) == 10_001
    assert P.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_partitioning_does_not_matter(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.randrange(1, 90)) for i in range(500)], "doc_id long, n_tokens long")
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(P.pack(df, 64)) == key(P.pack(df.repartition(7), 64))


def test_null_text_is_not_packed(docs):
    assert {r["doc_id"] for r in P.pack_documents(docs([(1, None), (2, ""), (3, "x y")])).collect()} == {3}


@pytest.mark.parametrize("copies", [1, 1000])
def test_equal_lengths(spark, copies):
    got = P.pack(spark.range(copies).selectExpr("id AS doc_id", "30 AS n_tokens"), 100).groupBy("window_id").count().collect()
    assert sorted(r["count"] for r in got) == sorted([3] * (copies // 3) + ([copies % 3] if copies % 3 else []))
