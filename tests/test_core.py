import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import analyze as A
from kgloom.operators import build as B
from kgloom.operators import community, export, toc, traverse
from kgloom.schema import KG
from kgloom.sources import files as S
from kgloom.sources import graphjson, web
from kgloom.streaming import watch

N, E = "id string, label string, file_type string, source_file string, community int, ord long", "source string, target string, relation string, confidence string, confidence_score double, weight double, source_file string, source_location string, ord long"


def make(spark, nodes, edges):
    """Graph of (id, label, file, community) and (source, target, relation, confidence)."""
    n = spark.createDataFrame([(i, lab, "code", f, c, k) for k, (i, lab, f, c) in enumerate(nodes)], N)
    e = spark.createDataFrame([(s, t, r, c, None, 1.0, "f.py", "L1", k) for k, (s, t, r, c) in enumerate(edges)], E)
    return B.build_graph(n, e)


@pytest.fixture(scope="module")
def served(spark):
    nodes = [("n1", "extract", "extract.py", 0), ("n2", "cluster", "cluster.py", 0), ("n3", "build", "build.py", 1), ("n4", "report", "report.py", 1), ("n5", "isolated", "other.py", 2)]
    return make(spark, nodes, [("n3", "n4", "uses", "EXTRACTED"), ("n1", "n2", "calls", "INFERRED"), ("n2", "n3", "imports", "EXTRACTED")])


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- build
def test_last_writer_wins_by_attribute_and_first_place_stays(spark):
    n = spark.createDataFrame([("a", "A", None, "x.py", None, 0), ("b", "B", "code", "y.py", None, 1), ("a", None, "paper", None, 3, 2), (None, "?", "code", "z", 1, 3)], N)
    e = spark.createDataFrame([("b", "a", "calls", "EXTRACTED", 0.9, 1.0, None, None, 5), ("a", "b", "uses", None, None, 2.0, "f", None, 9), ("a", "zz", "uses", "EXTRACTED", None, 1.0, "f", None, 1), ("a", "a", "calls", "INFERRED", None, 1.0, "f", None, 2), (None, "a", "x", "y", None, 1.0, "f", None, 3)], E)
    kg = B.build_graph(n, e)
    assert got(kg.nodes, "id", "label", "file_type", "source_file", "community", "ord") == [("a", "A", "paper", "x.py", 3, 0), ("b", "B", "code", "y.py", None, 1)]
    assert got(kg.edges, "u", "v", "src", "tgt", "relation", "confidence", "confidence_score", "weight", "ord") == [("a", "a", "a", "a", "calls", "INFERRED", None, 1.0, 2), ("a", "b", "a", "b", "uses", "EXTRACTED", 0.9, 2.0, 5)]
    assert dict(got(B.degrees(kg), "id", "degree")) == {"a": 3, "b": 1}


def test_validation(spark):
    n = spark.createDataFrame([("a", "A", "movie", None, None, 0)], N)
    e = spark.createDataFrame([("a", "b", "calls", "SURE", None, 1.0, "f", None, 0)], E)
    errors = {r["error"] for r in B.validate(n, e).collect()}
    assert errors == {"missing source_file", "unknown file_type movie", "unknown confidence SURE", "target is no node"}
    with pytest.raises(ValueError):
        B.assert_valid(n, e)
    assert B.dangling_edges(spark.createDataFrame([], N), e).collect() == []  # nothing dangles where there are no nodes


def test_empty_graph(spark):
    kg = make(spark, [], [])
    assert A.god_nodes(kg).collect() == [] and A.cohesion(kg).collect() == [] and A.graph_stats(kg).first()["edges"] == 0
    assert community.cluster(kg).collect() == [] and traverse.query_graph(kg, "anything") == "No matching nodes found."


def test_scores_have_defaults(spark, served):
    kg = KG(served.nodes, B.with_scores(served.edges))
    assert got(kg.edges, "u", "confidence_score") == [("n1", 0.5), ("n2", 1.0), ("n3", 1.0)]


def test_lenient_build_keeps_unknown_ends(spark):
    n, e = spark.createDataFrame([("a", "A", "code", "x", None, 0)], N), spark.createDataFrame([("b", "a", "calls", "EXTRACTED", None, 1.0, "f", None, 0)], E)
    assert got(B.build_edges_lenient(e), "u", "v", "src") == [("a", "b", "b")]
    assert got(B.lenient_nodes(n, e), "id", "label") == [("a", "A"), ("b", None)]


# --- analysis
def test_cohesion(spark):
    k4 = [(a, b, "calls", "EXTRACTED") for a in "abcd" for b in "abcd" if a < b]
    kg = make(spark, [(x, x, f"{x}.py", c) for x, c in zip("abcdefgh", [0] * 4 + [1] * 3 + [2])], k4)
    assert got(A.cohesion(kg), "community", "cohesion") == [(0, 1.0), (1, 0.0), (2, 1.0)]


def test_file_and_concept_nodes(spark):
    rows = [("a", "x.py", "x.py", 0), ("b", ".m()", "x.py", 0), ("c", "f()", "x.py", 0), ("d", "go", "x.py", 0), ("e", "", "x.py", 0), ("f", "Real", "", 0), ("g", "Real", "dir/notes", 0), ("h", "busy()", "x.py", 0)]
    f = A.node_facts(make(spark, rows, [("h", "g", "calls", "INFERRED"), ("h", "f", "calls", "INFERRED"), ("c", "g", "calls", "INFERRED")]))
    assert got(f.where("is_file"), "id") == [("a",), ("b",), ("c",), ("d",)] and got(f.where("is_concept"), "id") == [("f",), ("g",)]


def test_similarity_weighs_more_before_the_hub_bonus(spark):
    nodes = [("a", "A", "one/a.py", 0), ("b", "B", "two/b.py", 0)] + [(f"h{i}", f"H{i}", "two/h.md", 1) for i in range(5)]
    edges = [("a", "b", "semantically_similar_to", "INFERRED")] + [("b", f"h{i}", "calls", "EXTRACTED") for i in range(5)]
    s = {(r["u"], r["v"]): r for r in A.surprise_scores(make(spark, nodes, edges)).collect()}
    assert s["a", "b"]["score"] == int((2 + 2) * 1.5) + 1 and "peripheral `A` reaches hub `B`" in s["a", "b"]["why"]


def test_surprises_fall_back_to_communities(spark):
    nodes = [(f"{g}{i}", f"N{g}{i}", "one.md", c) for c, g in enumerate("ab") for i in range(5)]
    edges = [(f"{g}{i}", f"{g}{i + 1}", "calls", "EXTRACTED") for g in "ab" for i in range(4)] + [("a4", "b0", "references", "INFERRED")]
    rows = A.surprising_connections(make(spark, nodes, edges)).collect()
    assert [(r["source"], r["target"], r["reason"]) for r in rows] == [("Na4", "Nb0", "joins community 0 to 1")]


def test_diff(spark):
    old = make(spark, [("a", "A", "a.py", 0), ("b", "B", "b.py", 0)], [("a", "b", "calls", "EXTRACTED")])
    new = make(spark, [("b", "B", "b.py", 0), ("a", "A", "a.py", 0), ("c", "C", "c.py", 0)], [("b", "a", "calls", "EXTRACTED"), ("a", "c", "uses", "INFERRED")])
    n, e = A.graph_diff_nodes(old, new), A.graph_diff_edges(old, new)
    assert A.diff_summary(n, e) == "1 node added, 1 edge added" and A.diff_summary(*(f(old, old) for f in (A.graph_diff_nodes, A.graph_diff_edges))) == "no changes"


def test_questions(spark, served):
    rows = A.suggest_questions(served, traverse.betweenness(served)[0]).collect()
    assert {r["type"] for r in rows} >= {"bridge_node", "isolated_nodes"}
    lone = make(spark, [("a", "a.py", "a.py", 0)], [])
    assert [r["type"] for r in A.suggest_questions(lone, traverse.betweenness(lone)[0]).collect()] == ["no_signal"]


# --- traversal
def test_bfs_and_dfs(spark, served):
    ids = lambda f, d, s="n1": {r["id"] for r in f(served, start(spark, s), d).collect()}
    assert ids(traverse.bfs, 1) == {"n1", "n2"} and ids(traverse.bfs, 2) == {"n1", "n2", "n3"} and ids(traverse.bfs, 3, "n5") == {"n5"} and ids(traverse.bfs, 3, "no") == set()
    assert ids(traverse.dfs, 1) == {"n1", "n2"} and ids(traverse.dfs, 5) == {f"n{i}" for i in range(1, 5)}
    d = traverse.bfs(served, start(spark, "n1"), 3)
    assert got(traverse.bfs_edges(served, d, 3), "src", "dst") == [("n1", "n2"), ("n2", "n3"), ("n3", "n4")]


def test_dfs_equals_a_stack_walk(spark):
    r = random.Random(3)
    nodes = [(f"n{i}", f"n{i}", "a.py", 0) for i in range(40)]
    edges = [(f"n{a}", f"n{b}", "calls", "EXTRACTED") for a, b in (r.sample(range(40), 2) for _ in range(70))]
    near, seen = defaultdict(list), set()
    for a, b, _, _ in edges:
        if frozenset((a, b)) not in seen:
            seen.add(frozenset((a, b)))
            near[a].append(b)
            near[b].append(a)
    met, stack = [], [("n5", 0), ("n1", 0)]  # starts in order of place, last on the stack first
    while stack:
        x, level = stack.pop()
        if x in met or level > 3:
            continue
        met.append(x)
        stack.extend((y, level + 1) for y in reversed(near[x]) if y not in met)
    rows = traverse.dfs(make(spark, nodes, edges), start(spark, "n1", "n5"), 3).orderBy("step").collect()
    assert [x["id"] for x in rows] == met


def test_paths(spark, served):
    assert traverse.shortest_path(served, "extract", "report") == "Shortest path (3 hops):\n  extract --> cluster --> build --> report"
    assert "No path" in traverse.shortest_path(served, "extract", "isolated") and "No path" in traverse.shortest_path(served, "extract", "report", 2) and "No node matches" in traverse.shortest_path(served, "zzz", "report")


def test_query_text(spark, served):
    text = traverse.query_graph(served, "how does extract work")
    assert "NODE extract [src=extract.py community=0]" in text and "EDGE extract --calls [INFERRED]--> cluster" in text
    assert traverse.query_graph(served, "extract", token_budget=10).endswith("... (cut at the token budget)")
    assert got(traverse.get_neighbors(served, "cluster", "imp"), "neighbour", "relation") == [("n3", "imports")]
    assert traverse.get_node(served, "N3").first()["degree"] == 2


def test_betweenness_by_hand(spark):
    star = make(spark, [(x, x, "a.py", 0) for x in "abcd"], [("a", x, "calls", "EXTRACTED") for x in "bcd"])
    node, edge = traverse.betweenness(star)
    assert {r["id"]: round(r["betweenness"], 6) for r in node.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    assert {round(r["betweenness"], 6) for r in edge.collect()} == {0.5}


# --- communities
def test_communities_keep_their_promises(spark):
    r = random.Random(8)
    nodes = [(f"n{i:03d}", f"n{i}", "a.py", None) for i in range(150)]
    edges = []
    for g in range(6):
        own = range(g * 22, g * 22 + 22)
        edges += [(f"n{a:03d}", f"n{b:03d}", "calls", "EXTRACTED") for a in own for b in own if a < b and r.random() < 0.4]
        edges.append((f"n{g * 22:03d}", f"n{(g * 22 + 22) % 132:03d}", "calls", "EXTRACTED"))
    kg = make(spark, nodes, edges)
    found = community.cluster(kg)
    cid = dict(got(found, "id", "cid"))
    assert len(cid) == 150 and len({cid[f"n{i:03d}"] for i in range(132, 150)}) == 18  # isolated nodes stand alone
    sizes = defaultdict(int)
    for c in cid.values():
        sizes[c] += 1
    assert [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)
    whole = community.with_communities(kg, found)
    assert community.disconnected(whole).collect() == [] and community.modularity(whole).first()[0] > 0.6
    for g in range(6):
        assert len({cid[f"n{i:03d}"] for i in range(g * 22, g * 22 + 22)}) <= 2
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    assert dict(got(community.cluster(kg), "id", "cid")) == cid
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_components_too_large_for_one_task(spark, monkeypatch):
    monkeypatch.setattr(community, "LOCAL_EDGES", 60)
    monkeypatch.setattr(community, "ROUNDS", 4)
    r = random.Random(8)
    nodes = [(f"n{i:03d}", f"n{i}", "a.py", None) for i in range(80)]
    edges = [(f"n{a:03d}", f"n{b:03d}", "calls", "EXTRACTED") for g in range(4) for a in range(g * 20, g * 20 + 20) for b in range(a + 1, g * 20 + 20) if r.random() < 0.5]
    edges += [(f"n{g * 20:03d}", f"n{(g * 20 + 20) % 80:03d}", "calls", "EXTRACTED") for g in range(4)]
    kg = make(spark, nodes, edges)
    found = community.cluster(kg)
    whole = community.with_communities(kg, found)
    assert found.count() == 80 and community.disconnected(whole).collect() == [] and community.modularity(whole).first()[0] > 0.55


def test_large_community_of_many_edges_is_split_too(spark, monkeypatch):
    monkeypatch.setattr(community, "LOCAL_EDGES", 50)
    monkeypatch.setattr(community, "ROUNDS", 2)
    nodes = [(f"n{i:02d}", f"n{i}", "a.py", None) for i in range(18)]
    edges = [(f"n{a:02d}", f"n{b:02d}", "calls", "EXTRACTED") for g in (0, 8) for a in range(g, g + 8) for b in range(a + 1, g + 8)]
    edges += [("n00", "n08", "calls", "EXTRACTED"), ("n08", "n16", "calls", "EXTRACTED"), ("n16", "n17", "calls", "EXTRACTED")]
    kg = make(spark, nodes, edges)
    heavy = kg.edges.withColumn("weight", F.when(F.col("u") == "n16", 10000.0).otherwise(F.col("weight")))  # beside it both cliques are one community
    cid = dict(got(community.cluster(KG(kg.nodes, heavy)), "id", "cid"))
    assert cid["n01"] != cid["n09"] and len({cid[f"n{i:02d}"] for i in range(8)}) == 1


def test_large_components_are_contracted_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(community, "LOCAL_EDGES", 20)
    monkeypatch.setattr(community, "ROUNDS", 2)
    path = [(f"n{i:03d}", f"n{i + 1:03d}", 1.0, "n000") for i in range(39)]
    e = spark.createDataFrame(path, "u string, v string, w double, component string").select("component", "u", "v", "w")
    part = dict(got(community._large_parts(e, 42), "id", "part"))
    assert len(part) == 40 and len(set(part.values())) <= 12
    assert sum(part[u] != part[v] for u, v, _, _ in path) == len(set(part.values())) - 1  # parts are connected


def test_rows_are_numbered_in_order(spark):
    from kgloom.runtime import number

    rows = number(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert all(x["n"] == 999 - x["id"] for x in rows) and len(rows) == 1000


def test_large_community_is_split_once(spark):
    nodes = [(f"n{i:02d}", f"n{i}", "a.py", None) for i in range(44)]
    path = [(f"n{i:02d}", f"n{i + 1:02d}", "calls", "EXTRACTED") for i in range(43)]
    cid = dict(got(community.cluster(make(spark, nodes, path)), "id", "cid"))
    assert len(cid) == 44 and len(set(cid.values())) > 3


# --- texts, files, web
def test_texts(spark):
    df = spark.createDataFrame([("_a.B c__", "x/y.tar.gz", "one two　three  four", "<b>\x01&\"'" + "y" * 300)], "a string, p string, w string, l string")
    r = df.select(T.make_id("a", F.lit("__init__"), F.lit("..")).alias("i"), T.suffix(F.col("p")).alias("s"), T.stem(F.col("p")).alias("t"), T.word_count(F.col("w")).alias("n"), T.sanitize_label(F.col("l")).alias("l")).first()
    assert (r["i"], r["s"], r["t"], r["n"]) == ("a_b_c_init", "gz", "y.tar", 4) and r["l"].startswith("&lt;b&gt;&amp;&quot;&#x27;y") and r["l"].count("y") == 250
    assert spark.range(1).select(T.make_id(F.lit("한글"), F.lit(None).cast("string"))).first()[0] == ""


@pytest.mark.parametrize("path, kind", [("a.py", "code"), ("b.TSX", "code"), ("c.md", "document"), ("d.pdf", "paper"), ("e.PNG", "image"), ("f.bin", None), ("noext", None), (".py", None)])
def test_file_types(spark, path, kind):
    assert spark.range(1).select(T.classify(F.lit(path))).first()[0] == kind


def test_papers(spark):
    yes, no = "Abstract\nWe propose X, see arXiv [12].", "# notes\nplain text about nothing"
    df = spark.createDataFrame([(yes,), (no,), ("x" * 3000 + yes,)], "t string").select(T.classify(F.lit("a.md"), F.col("t")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["paper", "document", "document"]


@pytest.mark.parametrize("path, bad", [(".env", True), ("a/.envrc", True), ("my_password.txt", True), ("k/id_rsa", True), ("k/ID_RSA", False), ("server.PEM", True), ("a.py", False), ("service_account.json", True), ("environment.py", False)])
def test_sensitive(spark, path, bad):
    assert spark.range(1).select(T.is_sensitive(F.lit(path))).first()[0] is bad


def test_scan_detect_and_changes(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "node_modules/b.js": "x", ".hidden/c.py": "x", "my_venv/d.py": "x", "docs/e.md": "two words", ".env": "s", "secret.txt": "s", "f.bin": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = S.scan(spark, str(tmp_path))
    found = {r["path"]: (r["file_type"], r["words"], r["sensitive"]) for r in S.detect(files).collect()}
    assert found == {"a.py": ("code", 3, False), "docs/e.md": ("document", 2, False), "secret.txt": ("document", 1, True)}
    S.save_manifest(files, str(tmp_path / "kgloom-out/manifest"))
    old = S.load_manifest(spark, str(tmp_path / "kgloom-out/manifest"))
    assert {r["status"] for r in S.changed(files, old).collect()} == {"unchanged"} and S.load_manifest(spark, str(tmp_path / "no")) is None
    assert {r["status"] for r in S.changed(files, None).collect()} == {"new"}


def test_scan_lists_every_name(spark, tmp_path, monkeypatch):
    names = ["pkg/__init__.py", "_a.py", "_pkg/c.py", "b.py", "has space/d.py", "p%20q/e.py", "deep/x/y/z/f.py", "é/g.py", "kgloom-out/memory/.note.md"]
    noise = ["node_modules/b.js", "_pkg/node_modules/x.js", ".git/c.py", "kgloom-out/graph.json", "x_venv/d.py"]
    for name in names + noise:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "loop").symlink_to(tmp_path)
    for step in (S.STEP, 1):  # all in one round, and one folder a round
        monkeypatch.setattr(S, "STEP", step)
        got = {r["path"]: bytes(r["content"]).decode() for r in S.scan(spark, str(tmp_path)).collect()}
        assert got == {n: n for n in names}
    listed = S.scan(spark, str(tmp_path)).select("path", "length")
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString()  # nothing is read for a listing
    assert S.common_root(spark.createDataFrame([("a/b/c.py",), ("a/b/d/e.py",)], "path string")) == "a/b"
    assert S.common_root(spark.createDataFrame([("a/bc/c.py",), ("a/bd/e.py",)], "path string")) == "a" and S.common_root(spark.createDataFrame([], "path string")) == ""
    (tmp_path / "none").mkdir()
    assert S.scan(spark, str(tmp_path / "none")).count() == 0


def test_web(spark):
    page = "<html><head><title> A\n b </title><style>x{}</style></head><body><script>var t='<p>'</script>Hi  <b>there</b></body></html>"
    df = spark.createDataFrame([("https://e.org/a", page), ("https://e.org/b", "<p>x</p>")], "url string, html string")
    assert [tuple(r) for r in df.select(web.page_title(F.col("html"), F.col("url")), web.html_to_text(F.col("html"))).collect()] == [("A b", "A b Hi there"), ("https://e.org/b", "x")]
    rec = web.webpage_records(df, "now").first()
    assert rec["file_name"] == "e.org_a.md" and rec["markdown"].startswith('---\nsource_url: "https://e.org/a"')
    t = spark.createDataFrame([("u", '{"html": "<p>hello</p>", "author_name": "me"}'), ("v", "broken")], "url string, body string")
    assert [(r["author"], r["text"][:5]) for r in web.tweet_records(t).collect()] == [("me", "hello"), ("unknown", "Tweet")]
    for bad in ("file:///etc/passwd", "ftp://x", "javascript:1", ""):
        with pytest.raises(ValueError):
            web.validate_url(bad)


# --- exports
def test_json_round_trip(spark, served, tmp_path):
    path = str(tmp_path / "graph.json")
    export.to_json(served, path)
    doc = json.load(open(path))
    assert [n["id"] for n in doc["nodes"]] == ["n1", "n2", "n3", "n4", "n5"] and doc["links"][0]["confidence_score"] == 0.5 and "community" in doc["nodes"][0]
    back = graphjson.load(spark, path)
    assert got(back.edges, "u", "v", "relation") == got(served.edges, "u", "v", "relation") and got(back.nodes, "id", "community") == got(served.nodes, "id", "community")
    (tmp_path / "bad.json").write_text("{nonsense")
    with pytest.raises(ValueError):
        graphjson.load(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        graphjson.guard("/etc/passwd", str(tmp_path))


def test_files_are_written(spark, served, tmp_path):
    export.to_graphml(served, str(tmp_path / "g.xml"))
    export.to_html(served, str(tmp_path / "g.html"))
    export.to_svg(served, str(tmp_path / "g.svg"))
    export.to_canvas(served, str(tmp_path / "g.canvas"))
    export.to_cypher(served, str(tmp_path / "cypher"))
    import xml.etree.ElementTree as ET

    assert len(ET.parse(tmp_path / "g.xml").findall(".//{*}node")) == 5 and ET.parse(tmp_path / "g.svg")
    assert len(json.load(open(tmp_path / "g.canvas"))["nodes"]) == 8 and "extract" in (tmp_path / "g.html").read_text()
    assert export.to_obsidian(served, str(tmp_path / "vault")) == 8 and "[[cluster]]" in (tmp_path / "vault/extract.md").read_text()
    assert export.to_wiki(served, str(tmp_path / "wiki")) >= 4 and (tmp_path / "wiki/index.md").exists()
    with pytest.raises(ValueError):
        big = spark.range(export.MOST_DRAWN + 1).selectExpr("cast(id as string) id", "'x' label", "id ord")
        export.to_html(KG(big, served.edges), str(tmp_path / "big.html"))


def test_wiki_overflow(spark):
    kg = make(spark, [(f"n{i}", f"node{i}", "a.py", 0) for i in range(30)], [(f"n{i}", f"n{i + 1}", "calls", "EXTRACTED") for i in range(29)])
    assert "... and 5 more nodes" in {r["filename"]: r["markdown"] for r in export.wiki_rows(kg).collect()}["Community_0"]


def test_report(spark, served):
    text = export.report(served, traverse.betweenness(served)[0], "5 files", "2024-01-01")
    for part in ("# Graph report 2024-01-01", "## Corpus check", "## God nodes", "## Surprising connections", "## Communities", "## Knowledge gaps", "## Suggested questions", "67% EXTRACTED, 33% INFERRED, 0% AMBIGUOUS"):
        assert part in text


# --- lines and streams
def test_table_of_contents(spark):
    lines = ["가나과", "소나무 Pinus densiflora ..... 12", "junk", "다라과", "민들레Taraxacum platycarpum 30"]
    df = toc.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))
    rows = toc.carry_forward(df, "family", ["line_no"]).where("page is not null").orderBy("line_no").collect()
    assert [(r["family"], r["name"], r["scientific_name"], r["page"]) for r in rows] == [("가나과", "소나무", "Pinus densiflora", 12), ("다라과", "민들레", "Taraxacum platycarpum", 30)]
    runs = toc.run_groups(spark.createDataFrame(list(enumerate(["a", "a", None, None, "b", "a"])), "n long, g string"), "g", ["n"])
    assert [r["run"] for r in runs.orderBy("n").collect()] == [1, 1, 2, 2, 3, 4]
    html = spark.createDataFrame([('<script>var DB = [{"a":1}]; go()</script>',)], "h string").select(toc.patch_json_in_html(F.col("h"), "DB", F.lit('[{"a":2}]'))).first()[0]
    assert html == '<script>var DB = [{"a":2}]; go()</script>'


def test_stream_of_bursts(spark, tmp_path):
    schema, src = "ts timestamp, path string", tmp_path / "in"
    rows = [("2024-01-01 00:00:00", "a.py"), ("2024-01-01 00:00:02", "b.py"), ("2024-01-01 00:00:02", ".git/x.py"), ("2024-01-01 00:01:00", "c.md"), ("2024-01-01 00:01:01", "a.py"), ("2024-01-01 01:00:00", "z.py")]
    spark.createDataFrame(rows, "ts string, path string").selectExpr("timestamp(ts) ts", "path").coalesce(1).write.parquet(str(src))
    built, flagged = [], []
    q = watch.watch(spark.readStream.schema(schema).parquet(str(src)), built.append, flagged.append, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert built == [["a.py", "b.py"]] and flagged == [["a.py", "c.md"]]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(500)) + "\nlast")
    got = sorted(tuple(r) for r in toc.text_lines(spark, str(tmp_path / "t.txt")).select("line_no", "line").collect())
    assert got == [(i, f"line {i}") for i in range(500)] + [(500, ""), (501, "last")]


def test_entry_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    assert math.isfinite(len(e.oracle_sql()))


def test_queries_without_sql_cover_every_edge(spark, data):
    from kgloom.operators.community import cluster
    from kgloom.plans import views as V
    from kgloom.plans import workload

    table = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    n_edges = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct().count()
    n_nodes = table("customer").count() + table("supplier").count()
    run = lambda q: workload.QUERIES[q](spark, data)
    assert {r["part"]: r["count"] for r in run("node_links").groupBy("part").count().collect()} == {"nodes": n_nodes, "links": n_edges}
    assert run("graphml_rows").where("line like '%<edge%'").count() == n_edges
    full = V.graph(spark, data, V.FULL)
    assert got(run("cluster"), "id", "cid") == got(cluster(full), "id", "cid")
    assert got(run("dfs_nodes"), "id", "step") == got(traverse.dfs(full, start(spark, "s1"), 4), "id", "step")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(run("wiki_rows")) == rows(export.wiki_rows(full))
    assert rows(run("note_rows")) == rows(export.note_rows(full).union(export.community_notes(full)))


def test_bridge_questions_cover_the_whole_graph(spark, data):
    from kgloom.plans import views as V
    from kgloom.plans import workload

    full = V.graph(spark, data, V.FULL)
    near = defaultdict(set)
    for e in full.edges.where("u <> v").select("u", "v").collect():
        near[e["u"]].add(e["v"])
        near[e["v"]].add(e["u"])
    score = dict.fromkeys((r["id"] for r in full.nodes.select("id").collect()), 0.0)
    for s in list(score):  # shortest paths counted from every node
        dist, ways, line = {s: 0}, defaultdict(int, {s: 1}), [s]
        for a in line:
            for b in near[a]:
                if b not in dist:
                    dist[b] = dist[a] + 1
                    line.append(b)
                if dist[b] == dist[a] + 1:
                    ways[b] += ways[a]
        dep = defaultdict(float)
        for b in reversed(line):
            for a in near[b]:
                if dist[a] == dist[b] - 1:
                    dep[a] += ways[a] / ways[b] * (1 + dep[b])
            if b != s:
                score[b] += dep[b]
    n = len(score)
    brute = spark.createDataFrame([(i, x / ((n - 1) * (n - 2))) for i, x in score.items()], "id string, betweenness double")
    shown = ("type", "question", "why", "rank")
    assert got(workload.QUERIES["q_bridges"](spark, data), *shown) == got(A.q_bridges(full, brute), *shown)
    shown = ("rank", "type", "question", "why")
    assert got(workload.QUERIES["suggest_questions"](spark, data), *shown) == got(A.suggest_questions(full, brute), *shown)
