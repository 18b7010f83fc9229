"""Work that has to grow no faster than the input: what is moved, kept and held at once."""

import random

import pytest
from pyspark.sql import functions as F
from test_core import got, make, start

from kgloom.operators import community, traverse
from kgloom.plans import views as V
from kgloom.plans import workload


@pytest.fixture
def plain(spark):
    """Plans of large tables: no broadcast, nothing adapted."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in old.items():
        spark.conf.set(k, v)


def some_graph(spark, n=60, m=240, seed=1):
    r = random.Random(seed)
    nodes = [(f"n{i:03d}", f"l{i}", f"d{i % 3}/f{i % 7}.py", i % 4) for i in range(n)]
    return make(spark, nodes, [(f"n{r.randrange(n):03d}", f"n{r.randrange(n):03d}", r.choice(("calls", "uses")), r.choice(("EXTRACTED", "INFERRED", "AMBIGUOUS"))) for _ in range(m)])


def test_edges_are_moved_as_rows_and_once_by_either_end(spark, data, plain):
    moved = [x for x in plain(V.graph(spark, data).edges).split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert sum("(hi#" in x for x in moved) == sum("(lo#" in x for x in moved) == 1 and not any("(u#" in x or "(source#" in x for x in moved)


def test_queries_keep_the_edge_columns_that_they_read(spark, data):
    assert V.built(spark, data).edges.columns == ["u", "v"]
    some = V.built(spark, data, "relation", "ord")
    assert some.edges.columns == ["u", "v", "relation", "ord"]
    cols = ("u", "v", "relation")
    assert got(some.edges, *cols) == got(V.graph(spark, data).edges, *cols)


def test_diffs_read_either_graph_once(spark, data, plain):
    edges, nodes = (plain(workload.QUERIES[q](spark, data)) for q in ("graph_diff_edges", "graph_diff_nodes"))
    assert edges.count("Exchange hashpartitioning(a#") == 1 and 1 <= edges.count("FileScan parquet [l_orderkey") <= 2
    assert 1 <= nodes.count("FileScan parquet [l_orderkey") <= 2 and "max_by" not in nodes


def test_components_of_any_shape(spark, monkeypatch):
    r = random.Random(5)
    pairs = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)] + [("hub", f"leaf{i}") for i in range(50)] + [(f"r{r.randrange(90)}", f"r{r.randrange(90)}") for _ in range(70)] + [("loop", "loop")]
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    least = {x: x for x in ids}
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    e = spark.createDataFrame(pairs, "u string, v string")
    assert dict(got(community.connected_components(spark.createDataFrame([(i,) for i in ids], "id string"), e), "id", "component")) == least
    # Ids that are ordered by side, as those of customers and suppliers: hardly an edge is left after a round.
    kept = []
    monkeypatch.setattr(community, "cut", lambda df: kept.append(df.count() if "u" in df.columns else 0) or df.localCheckpoint())
    two = spark.createDataFrame(sorted({(f"c{r.randrange(800):04d}", f"s{r.randrange(60):04d}") for _ in range(9000)}), "u string, v string")
    nodes = two.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    assert community.connected_components(nodes, two).select("component").distinct().count() == 1
    assert max(kept) < two.count() / 4


@pytest.mark.parametrize("sources", [None, 7])
def test_betweenness_of_graphs_that_are_not_broadcast(spark, monkeypatch, sources):
    kg = some_graph(spark, 24, 50)
    want = traverse.betweenness(kg, sources)
    monkeypatch.setattr(traverse, "MOST_EDGES", 10)
    monkeypatch.setattr(traverse, "PAIRS_AT_ONCE", 1500)
    for cols, a, b in zip((("id",), ("u", "v")), want, traverse.betweenness(kg, sources)):
        a, b = ({tuple(r[c] for c in cols): round(r["betweenness"], 9) for r in df.collect()} for df in (a, b))
        assert a == b


def test_a_walk_holds_numbers_only(spark, monkeypatch):
    kg = some_graph(spark)
    want = [traverse.dfs(kg, start(spark, "n007", "n003"), d).orderBy("step").collect() for d in (0, 1, 3, 6)]
    monkeypatch.setattr(traverse, "CHUNK", 7)
    assert want == [traverse.dfs(kg, start(spark, "n007", "n003"), d).orderBy("step").collect() for d in (0, 1, 3, 6)]
    frames = []
    monkeypatch.setattr(traverse, "cut", lambda df: frames.append(df) or df.localCheckpoint())
    traverse.dfs(kg, start(spark, "n007"), 4).collect()
    packed = next(df for df in frames if "dst" in df.columns).collect()
    assert sum(len(r["dst"]) for r in packed) == 8 * kg.edges.where("u <> v").count()


def test_rounds_of_moving_release_what_they_leave(spark, monkeypatch):
    released = []
    monkeypatch.setattr(community, "ROUNDS", 3)
    monkeypatch.setattr(community, "release", lambda s: released.append(s), raising=False)
    e = spark.createDataFrame([("n0", f"n{i}", f"n{i + 1}", 1.0) for i in range(9)], "component string, u string, v string, w double")
    assert community._moved(e).count() == 10 and len(released) == 3
