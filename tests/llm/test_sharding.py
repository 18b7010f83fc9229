import hashlib
from collections import Counter

import pytest
from llm_tables import clashing

from kgloom.llm import sharding as S


def brute(names, slots):
    order = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append([(start + j * skip) % slots for j in range(slots)])
    table, at = {}, [0] * len(names)
    while len(table) < slots:
        for i in range(len(names)):
            while order[i][at[i]] in table:
                at[i] += 1
            table[order[i][at[i]]] = i
            if len(table) == slots:
                break
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("names, slots", [(["a"], 7), (["a", "b", "c"], 13), ([f"s{i}" for i in range(10)], 101)])
def test_table_equals_brute_force(names, slots):
    assert S.fill(names, slots).tolist() == brute(names, slots)


def test_slots_are_shared_evenly_and_little_moves():
    names = [f"s{i}" for i in range(50)]
    a, b = S.fill(names, 10007), S.fill(names[:-1], 10007)
    n = Counter(a.tolist())
    assert max(n.values()) - min(n.values()) <= 1
    moved = sum(x != y for x, y in zip(a, b) if x != 49)
    assert moved / 10007 < 0.05


@pytest.mark.parametrize("names, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 9, 7)])
def test_bad_arguments(names, slots):
    with pytest.raises(ValueError):
        S.fill(names, slots)


def test_rows(spark, docs):
    rows = [(i, "x") for i in range(3000)] + [(None, None), (5, "other"), (5, "x")]
    got = S.shard(clashing(docs(rows))).collect()
    assert len(got) == len(rows)
    table = S.fill([f"shard-{i:04d}" for i in range(S.SHARDS)])
    assert all(table[r["slot"]] == r["shard"] for r in got)
    assert len({(r["slot"], r["shard"]) for r in got if r["doc_id"] == 5}) == 1 and len({r["shard"] for r in got}) == 256
    again = {(r["doc_id"], r["shard"]) for r in S.shard(docs(rows).repartition(3)).collect()}
    assert again == {(r["doc_id"], r["shard"]) for r in got}
    assert S.shard(docs([])).collect() == []


def test_ids_named_as_the_new_columns(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "slot long, shard long")
    a, b = S.shard(df, "slot"), S.shard(df, "shard")
    assert a.columns == ["slot", "slot_", "shard"] and b.columns == ["shard", "slot", "shard_"]
    want = {r["doc_id"]: (r["slot"], r["shard"]) for r in S.shard(df.toDF("doc_id", "other")).collect()}
    assert {r["slot"]: (r["slot_"], r["shard"]) for r in a.collect()} == want
