import os
import textwrap
import time

import pytest

from kgloom.extract import registry as R
from kgloom.operators import traverse
from kgloom.operators.build import build_graph
from kgloom.plans import pipeline
from kgloom.sources import files as S

PY = '''
import os.path
from .models import Base, Other

class Runner(Base):
    def __init__(self):
        self.go()

    @property
    def go(self):
        def inner():
            helper()
        return Other()

async def helper():
    Runner().go()
    helper()
'''
SOURCES = {
    "m.py": (PY, {"m.py", "Base", "Runner", ".__init__()", ".go()", "helper()"}, {("m", "os_path", "imports"), ("m", "models", "imports_from")}, {("m_runner_init", "m_runner_go"), ("m_helper", "m_runner"), ("m_helper", "m_runner_go")}),
    "m.ts": ("import { A } from './lib/models';\nclass Client {\n  constructor(u: string) { this.u = u; }\n  async get(p: string): Promise<A> { return fetch(p); }\n  post(p: string) { return this.get(p); }\n}\nfunction build(t: string) { return `x${t}`; }\nconst arrow = (x) => { build(x); };\n", {"m.ts", "Client", ".constructor()", ".get()", ".post()", "build()", "arrow()"}, {("m", "models", "imports_from")}, {("m_client_post", "m_client_get"), ("m_arrow", "m_build")}),
    "m.go": ('package main\n\nimport (\n\t"fmt"\n\t"net/http"\n)\n\ntype Server struct {\n\tport int\n}\n\nfunc New(p int) *Server {\n\treturn &Server{port: p}\n}\n\nfunc (s *Server) Start() error {\n\treturn http.Listen(fmt.Sprint("x"))\n}\n\nfunc main() {\n\ts := New(1)\n\ts.Start()\n}\n', {"m.go", "Server", "New()", ".Start()", "main()"}, {("m", "fmt", "imports_from"), ("m", "http", "imports_from")}, {("m_main", "m_new"), ("m_main", "m_server_start")}),
    "m.rs": ("use std::collections::HashMap;\n\nstruct Graph { n: u8 }\n\nimpl Graph {\n    fn new() -> Self { Graph { n: 0 } }\n    pub fn add(&mut self, s: String) { self.n += 1; }\n}\n\nfn build<'a>(e: &'a str) -> Graph {\n    let mut g = Graph::new();\n    g.add(e);\n    g\n}\n", {"m.rs", "Graph", ".new()", ".add()", "build()"}, {("m", "hashmap", "imports_from")}, {("m_build", "m_graph_new"), ("m_build", "m_graph_add")}),
    "m.java": ("import java.util.List;\n\npublic class Proc {\n    public Proc() { }\n    @Override\n    public List<String> run(String s) {\n        return check(s); // check(x)\n    }\n    private List<String> check(String s) { return null; }\n}\n\ninterface Api { void call(); }\n", {"m.java", "Proc", "Api", ".Proc()", ".run()", ".check()", ".call()"}, {("m", "list", "imports")}, {("m_proc_run", "m_proc_check")}),
    "m.c": ("#include <stdio.h>\n#include \"my/util.h\"\n\nstatic int check(int x) { return x > 0; }\n\nint main(void) {\n    if (check(1)) { printf(\"check(2)\"); }\n    return 0;\n}\n", {"m.c", "check()", "main()"}, {("m", "stdio", "imports"), ("m", "util", "imports")}, {("m_main", "m_check")}),
    "m.cpp": ("#include <vector>\n\nclass Client {\npublic:\n    Client(int a) : a_(a) {}\n    int get(int p) { return build(p); }\nprivate:\n    int build(int p) { return p; }\n};\n\nint main() { Client c(1); return c.get(2); }\n", {"m.cpp", "Client", ".Client()", ".get()", ".build()", "main()"}, {("m", "vector", "imports")}, {("m_client_get", "m_client_build"), ("m_main", "m_client_get")}),
    "m.rb": ("require 'json'\nclass Api\n  def get(p)\n    if p then fetch(p) end\n  end\n\n  def fetch(p)\n    p # get(p)\n  end\nend\n\ndef parse(r)\n  r\nend\n", {"m.rb", "Api", ".get()", ".fetch()", "parse()"}, set(), {("m_api_get", "m_api_fetch")}),
    "m.cs": ("using System.Net.Http;\nnamespace Demo\n{\n    public class Proc\n    {\n        public List<string> Run(List<string> x) { return Check(x); }\n        private List<string> Check(List<string> x) { return x; }\n    }\n}\n", {"m.cs", "Demo", "Proc", ".Run()", ".Check()"}, {("m", "http", "imports")}, {("m_proc_run", "m_proc_check")}),
    "m.kt": ("import kotlin.math.max\n\ndata class Config(val a: Int)\n\nclass Client(private val c: Config) {\n    fun get(p: String): String { return build(p) }\n    private fun build(p: String) = p\n}\n\nfun create(): Client { return Client(Config(1)) }\n", {"m.kt", "Config", "Client", ".get()", ".build()", "create()"}, {("m", "kotlin_math_max", "imports")}, {("m_client_get", "m_client_build"), ("m_create", "m_client"), ("m_create", "m_config")}),
    "m.scala": ("import scala.collection.mutable.ListBuffer\n\nclass Client(c: Int) {\n  def get(p: String): String = {\n    build(p)\n  }\n  private def build(p: String): String = { p }\n}\n\nobject Factory {\n  def create(): Client = { new Client(1) }\n}\n", {"m.scala", "Client", "Factory", ".get()", ".build()", ".create()"}, {("m", "listbuffer", "imports")}, {("m_client_get", "m_client_build"), ("m_factory_create", "m_client")}),
    "m.php": ("<?php\nnamespace App;\nuse App\\Auth\\Guard;\n\nclass Api\n{\n    public function get(string $p): string\n    {\n        return $this->fetch($p);\n    }\n    private function fetch(string $p): string { return $p; }\n}\n\nfunction parse(string $r): array { return []; }\n", {"m.php", "Api", ".get()", ".fetch()", "parse()"}, {("m", "guard", "imports")}, {("m_api_get", "m_api_fetch")}),
}


@pytest.mark.parametrize("path", SOURCES)
def test_languages(path):
    text, labels, imports, calls = SOURCES[path]
    out = R.extract_one(path, text)
    assert {n["label"] for n in out["nodes"]} == labels
    assert {(e["source"], e["target"], e["relation"]) for e in out["edges"] if e["relation"].startswith("imports")} == imports
    made = [x for x in out["edges"] if "calls" == x["relation"]]
    assert {(x["source"], x["target"]) for x in made} == calls and {(x["confidence"], x["weight"]) for x in made} == {("INFERRED", 0.8)}
    ids = {n["id"] for n in out["nodes"]}
    assert all(e["source"] in ids and (e["target"] in ids or e["relation"].startswith("imports")) for e in out["edges"])


def test_golden_lines():
    text = textwrap.dedent("""\
        class Transformer:
            def __init__(self):
                pass

            def forward(self, x):
                return x
        """)
    out = R.extract_one("sample.py", text)
    assert [(n["id"], n["label"], n["source_location"]) for n in out["nodes"]] == [("sample", "sample.py", "L1"), ("sample_transformer", "Transformer", "L1"), ("sample_transformer_init", ".__init__()", "L2"), ("sample_transformer_forward", ".forward()", "L5")]
    assert [(e["source"], e["relation"], e["target"], e["source_location"]) for e in out["edges"]] == [("sample", "contains", "sample_transformer", "L1"), ("sample_transformer", "method", "sample_transformer_init", "L2"), ("sample_transformer", "method", "sample_transformer_forward", "L5")]


@pytest.mark.parametrize("path", [*SOURCES, "x.swift", "noext"])
def test_any_text_is_survived(path):
    for text in ("", "{", "}}}}((", "class", "\x00", "def (", "'" * 99, "class A {" * 200):
        out = R.extract_one(path, text)
        assert isinstance(out["nodes"], list)
    assert R.extract_one("x.swift", "class A {}")["nodes"] == []


def test_tables_cache_and_uses_across_files(spark):
    files = spark.createDataFrame([("a/models.py", "class Base:\n    pass\n"), ("b/m.py", PY), ("bad.py", "def ("), ("c.txt", "x"), ("m.go", SOURCES["m.go"][0])], "path string, text string")
    nodes, edges = R.extract(files)
    assert {r["label"] for r in nodes.collect()} >= {"Base", "Runner", "Server"}
    uses = {(r["source"], r["target"]) for r in edges.where("relation = 'uses'").collect()}
    assert uses == {("m_runner", "models_base")}
    parsed = R.parse(files)
    assert [r["path"] for r in parsed.where("error is not null").collect()] == ["bad.py"]
    cache = parsed.where("path <> 'm.go'")
    both, new = R.with_cache(files, cache)
    assert [r["path"] for r in new.collect()] == ["m.go"] and both.count() == 4
    by_path, _ = R.extract(files, by_path=True)
    assert "b_m_runner" in {r["id"] for r in by_path.collect()}


def test_folder_to_graph_and_update(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text(PY)
    (src / "models.py").write_text("class Base:\n    def ok(self):\n        pass\n")
    out = str(tmp_path / "out")
    kg = pipeline.run(spark, str(src), out)
    assert kg.nodes.where("community is null").isEmpty() and (tmp_path / "out/graph.json").exists() and "## God nodes" in (tmp_path / "out/GRAPH_REPORT.md").read_text()
    n = kg.nodes.count()
    assert pipeline.run(spark, str(src), out).nodes.count() == n  # the second run reads the cache
    files = pipeline.code_files(spark, str(src))
    old_nodes, old_edges = R.extract(files.select("path", "text"))
    old_nodes, old_edges = spark.createDataFrame(old_nodes.collect(), old_nodes.schema), spark.createDataFrame(old_edges.collect(), old_edges.schema)
    (src / "models.py").unlink()
    (src / "new.py").write_text("class Fresh:\n    pass\n")
    _, new, said = pipeline.update(spark, str(src), out, old_nodes, old_edges)
    ids = {r["id"] for r in new.nodes.collect()}
    assert "new_fresh" in ids and "models_base_ok" not in ids and "added" in said and "removed" in said
    note = pipeline.save_answer(str(tmp_path / "memory"), 'What "is"\nthis?', "It.", [f"n{i}" for i in range(12)])
    assert note.name.endswith("what__is__this.md") and 'question: "What \'is\' this?"' in note.read_text() and "- n11" in note.read_text()


def test_update_equals_a_full_run(spark, tmp_path):
    import random

    rng, src, out = random.Random(5), tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "base.py").write_text("class Base:\n    pass\n")
    (src / "child.py").write_text("from base import Base\n\nclass Child(Base):\n    pass\n")
    (src / "__init__.py").write_text("from child import Child\n\nclass Top:\n    pass\n")

    def rows():
        return tuple(spark.createDataFrame(df.collect(), df.schema) for df in R.extract(pipeline.code_files(spark, str(src)).select("path", "text")))

    def shape(kg):
        return {(r["id"], r["label"]) for r in kg.nodes.collect()}, {(r["u"], r["v"], r["relation"]) for r in kg.edges.collect()}

    files = pipeline.code_files(spark, str(src))
    S.save_manifest(files, f"{out}/manifest")
    R.parse(files).write.parquet(f"{out}/cache")
    edits = [("child.py", lambda t: t + "# note\n"), ("base.py", lambda t: t.replace("Base", "Root")), ("base.py", lambda t: t.replace("Root", "Base")), ("__init__.py", lambda t: t + "\nclass Other:\n    pass\n")]
    at = 2_000_000_000
    for name, edit in edits + [("child.py", None)]:
        n, e = rows()
        path = src / name
        path.write_text(edit(path.read_text())) if edit else path.unlink()
        if path.exists():
            at += 10
            os.utime(path, (at, at))
        _, new, said = pipeline.update(spark, str(src), out, n, e)
        assert shape(new) == shape(build_graph(*rows())), name
        if name == "child.py" and edit:
            assert said == "no changes"
    assert R.cached_files(spark.read.parquet(f"{out}/cache")).count() == 2
    R.clear_cache(spark, f"{out}/cache")
    assert not (tmp_path / "out/cache").exists()


def test_edits_are_watched(spark, tmp_path):
    src, out, said = tmp_path / "src", tmp_path / "out", []
    src.mkdir()
    (src / "m.py").write_text("class A:\n    pass\n")
    q = pipeline.watch_folder(spark, str(src), str(out), every="1 second", quiet=0.0, rebuilt=said.append)
    try:
        for _ in range(60):
            if (out / "watched/_SUCCESS").exists():
                break
            time.sleep(0.5)
        (src / "m.py").write_text("class A:\n    pass\n\nclass B:\n    pass\n")
        (src / "n.md").write_text("words")
        for _ in range(120):
            if {p for s in said for p in s} == {"m.py", "n.md"}:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert {p for s in said for p in s} == {"m.py", "n.md"}
    assert "m_b" in (out / "graph.json").read_text() and (out / "needs_update").exists()


def test_large_graphs_have_a_report_without_bridges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(traverse, "MOST_EDGES", 0)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text(PY)
    pipeline.run(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    assert "too large for exact betweenness" in (tmp_path / "out/GRAPH_REPORT.md").read_text()


def test_pages_are_ingested_by_kind(spark, tmp_path):
    pages = [("https://arxiv.org/abs/1706.03762", '<h1 class="title">T</h1><blockquote class="abstract">A b</blockquote><div class="authors">Me</div>'), ("https://x.com/u/status/1", '{"html": "<p>hello</p>", "author_name": "me"}'), ("https://e.org/a", "<title>One</title>x"), ("https://e.org/a?", "<title>Two</title>y")]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {p.name: p.read_text() for p in pipeline.ingest(spark, df, str(tmp_path), "now")}
    assert set(got) >= {"arxiv_1706_03762.md", "x.com_u_status_1.md", "e.org_a.md"} and len(got) == 4
    assert "A b" in got["arxiv_1706_03762.md"] and "hello" in got["x.com_u_status_1.md"] and "author: me" in got["x.com_u_status_1.md"]
    again = pipeline.ingest(spark, df, str(tmp_path), "now")
    assert len({p.name for p in again} | set(got)) == 8
    with pytest.raises(ValueError):
        pipeline.ingest(spark, spark.createDataFrame([("file:///etc/passwd", "x")], "url string, html string"), str(tmp_path), "now")
