import random

import numpy as np
from llm_tables import clashing

from kgloom.llm import near_dedup as nd
from kgloom.llm.common import components


def shingles(text):
    import re

    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + nd.SHINGLE]) for i in range(max(1, len(w) - nd.SHINGLE + 1))} if w else set()


def brute(rows, threshold):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [(i, shingles(t or "")) for i, t in rows]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and len(a & b) / len(a | b) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root if find(i) != i}


def result(df):
    return {r["doc_id"]: r["kept_doc_id"] for r in df.collect()}


def test_minimum_and_maximum_estimate_similarity(words):
    a, b = words(1, 300), words(1, 300).split()
    for k in range(0, 300, 15):
        b[k] = f"new{k}"
    b = " ".join(b)
    sig, has = nd.signatures([a, b, ""])
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert list(has) == [True, True, False]
    for part in (sig[:2, 0::2], sig[:2, 1::2]):  # minima and maxima each estimate it
        assert abs((part[0] == part[1]).mean() - true) < 0.17
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12


def test_equals_brute_force(docs, words, spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert result(nd.near_duplicates(docs(rows))) == brute(rows, nd.THRESHOLD)


def test_large_group_of_edited_copies(docs, words):
    base, r = words(9, 120).split(), random.Random(1)
    rows = [(i, words(100 + i, 80)) for i in range(50)]
    for i in range(300):
        w = list(base)
        w[r.randrange(120)] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    got = result(nd.near_duplicates(docs(rows)))
    assert got == {1000 + i: 1000 for i in range(1, 300)}


def alike(rows, need):
    """Components of rows of bytes by brute force: the smallest row of each."""
    root = np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i] == rows[j]).sum() >= need and root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root


def drifting(r, n, width=192):
    """Signatures of which each differs in some bytes from an earlier one: chains, whose ends are unlike, and strangers."""
    rows = [r.integers(0, 256, width, np.uint8)]
    for _ in range(n - 1):
        x = rows[r.integers(max(0, len(rows) - 4), len(rows))].copy()
        change = r.choice(width, r.integers(20, 120), replace=False)
        x[change] = r.integers(0, 256, len(change))
        rows.append(x)
    return np.array(rows)


def test_components_within_a_block():
    r = np.random.default_rng(0)
    sig, group = drifting(r, 90), np.repeat(np.arange(9), 10)
    need = nd._needed(nd.THRESHOLD, 192)
    expect = np.concatenate([alike(sig[i : i + 10], need) + i for i in range(0, 90, 10)])
    assert (nd._roots(group.astype(np.uint64), sig, need) == expect).all() and len(set(expect)) > 9


def test_buckets_beyond_one_place_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "MOST", 12)
    r = np.random.default_rng(1)
    a, b = drifting(r, 150), drifting(r, 40)
    sig = np.concatenate([a, b, r.integers(0, 256, (30, 192), np.uint8)])
    rows = [(i, bytes(x), [1, 2] if i < 150 else [3]) for i, x in enumerate(sig)]
    reps = spark.createDataFrame(rows, "doc long, sig binary, bands array<long>")
    got = {x["node"]: x["root"] for x in components(nd.bucket_links(reps)).collect()}
    need = nd._needed(nd.THRESHOLD, 192)
    expect = np.concatenate([alike(sig[:150], need), alike(sig[150:], need) + 150])
    assert [got.get(i, i) for i in range(len(sig))] == expect.tolist() and 2 < len(set(expect[:150].tolist())) < 100


def test_hot_bucket_of_copies_needs_no_comparison_of_all_blocks(docs, words, monkeypatch):
    monkeypatch.setattr(nd, "MOST", 30)
    base, rows = words(9, 120).split(), []
    for i in range(200):
        w = list(base)
        w[i % 120] = f"edit{i}"
        rows.append((i, " ".join(w)))
    assert result(nd.near_duplicates(docs(rows))) == {i: 0 for i in range(1, 200)}


def test_edge_cases(docs, words):
    long = words(3, 60_000)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, None), (5, ""), (6, "one"), (7, "one"), (None, words(4, 50)), (8, words(4, 50)), (8, words(4, 50)), (9, long), (10, long + " end"), (11, "!!! ???"), (12, "!!! ???")]
    got = result(nd.near_duplicates(clashing(docs(rows))))
    assert got == {7: 6, 10: 9}  # ids that are null take no part, a repeated row is one document
    assert nd.near_duplicates(docs([])).collect() == []


def test_order_of_rows_and_partitions_does_not_matter(docs, words):
    rows = [(i, words(i % 7, 40) + f" tail{i}") for i in range(40)]
    a = result(nd.near_duplicates(docs(rows)))
    b = result(nd.near_duplicates(docs(rows[::-1]).repartition(3)))
    assert a == b and len(a) == 33


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, r.randrange(101, 200)) for _ in range(80)] + [(300, 300)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[j] for _, j in edges if 100 < j < 200} == {100} and 300 not in got
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shingle_counts():
    h, n = nd.shingle_hashes(["a b c d", "a", "", None, "B c D", "b C d"])
    assert list(n) == [2, 1, 0, 0, 1, 1] and h[1] == h[3] == h[4] and len(np.unique(h)) == 3
