import numpy as np
from llm_tables import clashing

from kgloom.llm import ann


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_partition_is_balanced_and_cuts_little():
    r = np.random.default_rng(0)
    x = ann.unit(np.concatenate([r.standard_normal((200, 16)) * 0.3 + c for c in r.standard_normal((4, 16)) * 3]))
    g = ann.neighbours(x, 8)
    p = ann.partition(g, 4)
    assert np.bincount(p).max() - np.bincount(p).min() <= 2
    assert (p[g] != p[:, None]).mean() < 0.05


def recall(rows, x, asked):
    got, true = {}, ann.neighbours(ann.unit(x), 10, asked)
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert set(got) == set(asked.tolist()) and all(len(v) == 10 for v in got.values())
    return np.mean([len(got[i] & set(t.tolist())) / 10 for i, t in zip(asked, true)])


def test_recall_on_vectors_without_structure(spark):
    x = np.random.default_rng(1).standard_normal((3000, 24))
    asked = np.arange(0, 3000, 50)
    assert recall(ann.nearest(frame(spark, x)).collect(), x, asked) >= 0.9


def test_clustered_vectors_beyond_the_sample_visit_few_parts(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.standard_normal((500, 16)) * 0.2 + c for c in r.standard_normal((40, 16)) * 2])[r.permutation(20_000)]
    found, about = ann.search(frame(spark, x))
    assert about["parts"] == 16 and about["sample"] == 16 * ann.PER_PART < len(x) and about["probes"] <= 6
    assert recall(found.selectExpr("q as vec_id", "id as neighbour_id").collect(), x, np.arange(0, 20_000, 50)) >= 0.9


def test_groups_are_split_without_loss(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((600, 8))
    whole = sorted(map(tuple, ann.nearest(frame(spark, x), every=3, target=1.0).collect()))
    monkeypatch.setattr(ann, "CHUNK", 40)
    assert sorted(map(tuple, ann.nearest(frame(spark, x), every=3, target=1.0).collect())) == whole and len(whole) == 2000


def test_parts_grow_with_the_table():
    sizes = [ann.parts_of(n) for n in (0, 1, 500, 2000, 50_000, 10**6, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 2 and sizes[-1] == ann.MAX_PARTS <= ann.SAMPLE // 32 and len(set(sizes)) > 4


def test_number_of_probes_is_the_least_that_reaches_the_target():
    route = np.array([[0, 1, 2, 3], [3, 2, 1, 0]])
    assert ann.probes_for(route, np.array([0, 0, 1, 1]), np.array([0, 1, 3, 0]), 0.75) == 2
    assert ann.probes_for(route, np.array([0, 0, 1, 1]), np.array([0, 1, 3, 0]), 0.95) == 4
    assert ann.probes_for(route, np.array([], int), np.array([], int), 0.9) == 4


def test_all_parts_are_exact_with_ties_by_id(spark):
    x = np.array([[1, 0], [1, 0], [0, 1], [1, 1], [-1, 0], [0, 0]])
    got = {}
    for r in ann.nearest(frame(spark, x), k=3, every=1, target=1.0).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_id"], round(r["similarity"], 4))
    assert got[0] == {1: (1, 1.0), 2: (3, 0.7071), 3: (2, 0.0)}
    assert got[5] == {1: (0, 0.0), 2: (1, 0.0), 3: (2, 0.0)}


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, None]), (6, [1.0]), (7, [0.5, 0.5])]
    got = ann.nearest(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), every=1, target=1.0).collect()
    assert {(r["vec_id"], r["neighbour_id"]) for r in got} == {(a, b) for a in (1, 2, 7) for b in (1, 2, 7) if a != b}
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).collect() == [] and ann.nearest(spark.createDataFrame([(1, [1.0])], schema), every=1).collect() == []
    assert ann.nearest(spark.createDataFrame([(50, [1.0]), (7, [2.0])], schema)).collect()[0]["neighbour_id"] == 7
    many = ann.nearest(frame(spark, np.ones((40, 3))), every=1, target=1.0).collect()
    assert len(many) == 400 and {r["neighbour_id"] for r in many if r["vec_id"] == 39} == set(range(10))
