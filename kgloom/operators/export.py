"""Reports and graph formats. Bodies are DataFrames; only bounded or explicitly small outputs are put together on the driver."""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import KG
from . import analyze as A
from .build import adjacency, degrees, with_scores

MOST_DRAWN, CANVAS_EDGES = 5000, 200
COLORS = "#1b9e77 #d95f02 #7570b3 #e7298a #66a61e #e6ab02 #a6761d #666666 #1f78b4 #b2df8a".split()


def label_of(df_col: str = "label", fallback: str = "id") -> Column:
    return F.coalesce(df_col, fallback)


def _quote(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


# --- graph formats as rows
def cypher_nodes(kg: KG) -> DataFrame:
    kind = F.initcap(F.coalesce("file_type", F.lit("unknown")))
    return kg.nodes.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), _quote(F.col("id")), F.lit("', label: '"), _quote(label_of()), F.lit("'});")).alias("line"))


def relation_name(c: Column) -> Column:
    """Relation as an upper-case identifier."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit("RELATES_TO"))), "[^A-Z0-9_]", "_")


def cypher_edges(kg: KG) -> DataFrame:
    parts = [F.lit("MATCH (a {id: '"), _quote(F.col("u")), F.lit("'}), (b {id: '"), _quote(F.col("v")), F.lit("'}) MERGE (a)-[:"), relation_name(F.col("relation")), F.lit(" {confidence: '"), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("'}]->(b);")]
    return kg.edges.select(F.concat(*parts).alias("line"))


def to_cypher(kg: KG, path: str) -> None:
    cypher_nodes(kg).union(cypher_edges(kg)).write.mode("overwrite").text(path)


def graphml_rows(kg: KG) -> DataFrame:
    x = lambda c: T.sanitize_label(F.coalesce(c, F.lit("")), 100_000)
    n = kg.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), x(F.col("id")), F.lit('"><data key="label">'), x(label_of()), F.lit('</data><data key="community">'), F.coalesce("community", F.lit(-1)), F.lit("</data></node>")).alias("line"))
    e = kg.edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), x(F.col("u")), F.lit('" target="'), x(F.col("v")), F.lit('"><data key="relation">'), x(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return n.union(e)


def to_graphml(kg: KG, path: str) -> None:
    """One GraphML file; its lines are streamed through the driver, nodes before edges."""
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n<key id="community" for="node" attr.name="community" attr.type="long"/>\n<key id="relation" for="edge" attr.name="relation" attr.type="string"/>\n<graph edgedefault="undirected">\n'
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(head)
        for part in (1, 2):
            for r in graphml_rows(kg).where(F.col("part") == part).toLocalIterator():
                f.write(r["line"] + "\n")
        f.write("</graph>\n</graphml>\n")


_NULLS = {"ignoreNullFields": "false"}


def node_json(kg: KG) -> DataFrame:
    """(ord, json): one JSON object for each node, nulls included."""
    return kg.nodes.select("ord", F.to_json(F.struct("id", "label", "file_type", "source_file", "community"), _NULLS).alias("json"))


def link_json(kg: KG) -> DataFrame:
    """(u_ord, ord, json): one JSON object for each link."""
    cols = [F.col("u").alias("source"), F.col("v").alias("target"), F.col("src").alias("_src"), F.col("tgt").alias("_tgt"), "relation", "confidence", "confidence_score", "weight", "source_file"]
    return with_scores(kg.edges).select("u_ord", "ord", F.to_json(F.struct(*cols), _NULLS).alias("json"))


def to_json(kg: KG, path: str) -> None:
    """A node-link JSON file, streamed through the driver in order."""
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(json.dumps(dict(directed=False, multigraph=False, graph={}))[:-1])
        for part, rows in (("nodes", node_json(kg).orderBy("ord")), ("links", link_json(kg).orderBy("u_ord", "ord"))):
            f.write(f', "{part}": [')
            for i, r in enumerate(rows.toLocalIterator()):
                f.write((", " if i else "") + r["json"])
            f.write("]")
        hyper = [r.asDict(True) for r in kg.hyperedges.collect()] if kg.hyperedges is not None else []
        f.write(f', "hyperedges": {json.dumps(hyper)}}}')


def push_to_neo4j(kg: KG, uri: str, user: str, password: str) -> None:
    """Upserts nodes and edges from the executors; needs the neo4j driver there."""

    def send(statement: str, params: list[str]):
        def work(rows):
            from neo4j import GraphDatabase

            with GraphDatabase.driver(uri, auth=(user, password)) as driver, driver.session() as session:
                for r in rows:
                    session.run(statement.format(**r.asDict()), {p: r[p] for p in params})

        return work

    kg.nodes.select("id", label_of().alias("label"), F.regexp_replace(F.initcap(F.coalesce("file_type", F.lit("Entity"))), "[^A-Za-z0-9_]", "_").alias("kind")).foreachPartition(send("MERGE (n:{kind} {{id: $id}}) SET n.label = $label", ["id", "label"]))
    kg.edges.select("u", "v", relation_name(F.col("relation")).alias("rel"), "confidence").foreachPartition(send("MATCH (x {{id: $u}}) MATCH (y {{id: $v}}) MERGE (x)-[e:{rel}]->(y) SET e.confidence = $confidence", ["u", "v", "confidence"]))


# --- drawing
def viz_nodes(kg: KG) -> DataFrame:
    """(id, label, size, font_size, color, degree) of nodes as drawn."""
    d = kg.nodes.join(degrees(kg), "id")
    most = F.greatest(F.max("degree"), F.lit(1))
    d = d.join(F.broadcast(d.agg(most.alias("most"))), how="cross")
    color = F.element_at(F.array(*[F.lit(c) for c in COLORS]), (F.coalesce("community", F.lit(0)) % len(COLORS) + 1).cast("int"))
    return d.select("id", T.sanitize_label(label_of()).alias("label"), F.bround(10 + 30 * F.col("degree") / F.col("most"), 1).alias("size"), F.when(F.col("degree") >= F.col("most") * 0.15, 12).otherwise(0).alias("font_size"), color.alias("color"), "degree", "community")


def viz_edges(kg: KG) -> DataFrame:
    c = F.coalesce("confidence", F.lit("EXTRACTED"))
    return kg.edges.select(F.col("u").alias("from"), F.col("v").alias("to"), T.sanitize_label(F.coalesce("relation", F.lit(""))).alias("label"), (c != "EXTRACTED").alias("dashes"), F.when(c == "EXTRACTED", 2).otherwise(1).alias("width"), F.when(c == "EXTRACTED", 0.7).otherwise(0.35).alias("opacity"))


def _page(title: str, body: str, script: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body style='margin:0;background:#111'>{body}<script>{script}</script></body></html>"


_DRAW = """
const byId=new Map(N.map((n,i)=>[n.id,Object.assign(n,{x:500+400*Math.cos(i*2.4)*Math.sqrt((i+1)/N.length),y:400+350*Math.sin(i*2.4)*Math.sqrt((i+1)/N.length)})]));
const g=document.getElementById('g'),s=(t,a,p)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in a)e.setAttribute(k,a[k]);p.appendChild(e);return e};
for(const e of E){const a=byId.get(e.from),b=byId.get(e.to);if(a&&b)s('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y,stroke:'#999','stroke-opacity':e.opacity,'stroke-width':e.width,'stroke-dasharray':e.dashes?'4':'0'},g)}
for(const n of N){const c=s('circle',{cx:n.x,cy:n.y,r:n.size/4,fill:n.color},g);s('title',{},c).textContent=n.label+' ('+n.degree+')';if(n.font_size)s('text',{x:n.x+6,y:n.y,fill:'#fff','font-size':n.font_size},g).textContent=n.label}
"""


def to_html(kg: KG, path: str) -> None:
    """A page that draws the graph; ValueError beyond MOST_DRAWN nodes."""
    if (n := kg.nodes.limit(MOST_DRAWN + 1).count()) > MOST_DRAWN:
        raise ValueError(f"the graph has more than {MOST_DRAWN} nodes, too many to draw ({n}+)")
    rows = lambda df: "[" + ",".join(df.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]) + "]"
    safe = lambda s: s.replace("</", "<\\/")
    Path(path).write_text(_page("Knowledge graph", "<svg id='g' viewBox='0 0 1000 800' width='100%' height='100%'></svg>", f"const N={safe(rows(viz_nodes(kg)))},E={safe(rows(viz_edges(kg)))};{_DRAW}"), encoding="utf-8")


def to_svg(kg: KG, path: str, seed: int = 42, rounds: int = 60) -> None:
    """A picture of a graph of at most MOST_DRAWN nodes, laid out by springs."""
    import numpy as np

    if kg.nodes.limit(MOST_DRAWN + 1).count() > MOST_DRAWN:
        raise ValueError(f"the graph has more than {MOST_DRAWN} nodes, too many to draw")
    n, e = viz_nodes(kg).toPandas(), viz_edges(kg).toPandas()
    at = {x: i for i, x in enumerate(n["id"])}
    u, v = e["from"].map(at).to_numpy(int), e["to"].map(at).to_numpy(int)
    p, k, step = np.random.default_rng(seed).random((len(n), 2)), 1 / math.sqrt(max(1, len(n))), 0.1
    for _ in range(rounds):
        d = p[:, None] - p[None]
        dist = np.maximum(np.linalg.norm(d, axis=-1), 1e-3)
        move = (d * (k * k / dist**2)[..., None]).sum(1)
        if len(u):
            f = (p[u] - p[v]) * (np.linalg.norm(p[u] - p[v], axis=1, keepdims=True) / k)
            np.add.at(move, u, -f)
            np.add.at(move, v, f)
        p += move / np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9) * step
        step *= 0.95
    p = (p - p.min(0)) / np.maximum(np.ptp(p, axis=0), 1e-9) * 900 + 50 if len(p) else p
    lines = [f'<line x1="{p[a][0]:.1f}" y1="{p[a][1]:.1f}" x2="{p[b][0]:.1f}" y2="{p[b][1]:.1f}" stroke="#888" stroke-opacity="{o}"/>' for a, b, o in zip(u, v, e["opacity"])]
    dots = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{s / 4:.1f}" fill="{c}"><title>{label}</title></circle>' for (x, y), s, c, label in zip(p, n["size"], n["color"], n["label"])]
    Path(path).write_text('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">' + "".join(lines + dots) + "</svg>", encoding="utf-8")


# --- notes, canvas, wiki
def _file_base(c: Column) -> Column:
    x = F.trim(F.regexp_replace(c, r'[\\/*?:"<>|#^\[\]]', ""))
    return F.when(x == "", "unnamed").otherwise(x)


def note_filenames(nodes: DataFrame) -> DataFrame:
    """(id, filename): names cleaned for files; of equal names the first stays, later ones get _1, _2 and so on."""
    w = Window.partitionBy("base").orderBy("ord")
    n = nodes.withColumn("base", _file_base(label_of())).withColumn("k", F.row_number().over(w) - 1)
    return n.select("id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), "k")).alias("filename"))


def dominant_confidence(kg: KG) -> DataFrame:
    """(id, confidence): the commonest among a node's edges, of equal ones the first met; EXTRACTED without edges."""
    a = adjacency(kg.edges, "confidence", "ord").withColumn("confidence", F.coalesce("confidence", F.lit("EXTRACTED")))
    c = a.groupBy("src", "confidence").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "first")
    best = c.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("src").alias("id"), "confidence")
    return kg.nodes.select("id").join(best, "id", "left").select("id", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"))


def inter_community_edges(kg: KG) -> DataFrame:
    """(community, other, n_edges), both ways."""
    e = A.edge_facts(kg, "community").where(F.col("u_community") != F.col("v_community"))
    pairs = e.select(F.explode(F.array(F.struct(F.col("u_community").alias("community"), F.col("v_community").alias("other")), F.struct(F.col("v_community").alias("community"), F.col("u_community").alias("other")))).alias("p"))
    return pairs.groupBy("p.community", "p.other").agg(F.count("*").alias("n_edges"))


def bridge_nodes(kg: KG, n: int = 5) -> DataFrame:
    """(community, rank, id, reach, degree): members that reach most other communities."""
    b = kg.nodes.select("id", "community", "ord").join(degrees(kg), "id").join(A.community_reach(kg), "id").where("reach > 0 and community is not null")
    w = Window.partitionBy("community").orderBy(F.desc("reach"), F.desc("degree"), "ord")
    return b.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("community", "rank", "id", "reach", "degree")


def canvas_layout(kg: KG) -> DataFrame:
    """(community, x, y, width, height): a square grid of groups, each column as wide and each row as high as its largest."""
    g = kg.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("n"))
    g = g.select("community", F.greatest(F.lit(600), 220 * F.ceil(F.sqrt("n"))).cast("long").alias("width"), F.greatest(F.lit(400), 100 * F.ceil(F.col("n") / 3) + 120).cast("long").alias("height"))
    g = g.withColumn("i", F.row_number().over(Window.orderBy("community")) - 1).withColumn("cols", F.ceil(F.sqrt(F.count("*").over(Window.partitionBy()))).cast("int"))
    g = g.withColumn("c", F.col("i") % F.col("cols")).withColumn("r", F.floor(F.col("i") / F.col("cols")).cast("int"))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    xs = g.groupBy(F.col("c").alias("k")).agg(F.max("width").alias("m")).select(F.col("k").alias("c"), (F.coalesce(F.sum("m").over(before), F.lit(0)) + 80 * F.col("k")).alias("x"))
    ys = g.groupBy(F.col("r").alias("k")).agg(F.max("height").alias("m")).select(F.col("k").alias("r"), (F.coalesce(F.sum("m").over(before), F.lit(0)) + 80 * F.col("k")).alias("y"))
    return g.join(xs, "c").join(ys, "r").select("community", "x", "y", "width", "height")


def canvas_cards(kg: KG) -> DataFrame:
    """(id, x, y): cards of members in rows of three, by label."""
    w = Window.partitionBy("community").orderBy(label_of(), "ord")
    n = kg.nodes.where("community is not null").withColumn("i", F.row_number().over(w) - 1)
    m = n.join(canvas_layout(kg), "community")
    return m.select("id", (F.col("x") + 20 + F.col("i") % 3 * 200).alias("x"), (F.col("y") + 80 + F.floor(F.col("i") / 3) * 80).alias("y"))


def canvas_top_edges(kg: KG, n: int = CANVAS_EDGES) -> DataFrame:
    """(rank, u, v, label, weight) of the heaviest edges between nodes of communities."""
    c = kg.nodes.where("community is not null").select("id")
    e = kg.edges.join(c.withColumnRenamed("id", "u"), "u", "left_semi").join(c.withColumnRenamed("id", "v"), "v", "left_semi").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    label = F.concat(F.when(F.coalesce("relation", F.lit("")) != "", F.concat("relation", F.lit(" "))).otherwise(""), F.lit("["), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("]"))
    return A.top(e.withColumn("label", label), [F.desc("weight"), F.asc("u_ord"), F.asc("ord")], n).select("rank", "u", "v", "label", "weight")


def to_canvas(kg: KG, path: str, folder: str = "notes") -> None:
    """A canvas file of groups, cards and the heaviest edges; for graphs small enough to look at."""
    groups = [{"id": f"g{r['community']}", "type": "group", "label": f"Community {r['community']}", "x": int(r["x"]), "y": int(r["y"]), "width": r["width"], "height": r["height"], "color": str(i % 6 + 1)} for i, r in enumerate(canvas_layout(kg).orderBy("community").collect())]
    cards = [dict(id=f"n_{r['id']}", type="file", file=f"{folder}/{r['filename']}.md", x=int(r["x"]), y=int(r["y"]), width=180, height=60) for r in canvas_cards(kg).join(note_filenames(kg.nodes), "id").orderBy("id").collect()]
    edges = [{"id": f"e_{r['u']}_{r['v']}", "fromNode": f"n_{r['u']}", "toNode": f"n_{r['v']}", "label": r["label"]} for r in canvas_top_edges(kg).orderBy("rank").collect()]
    Path(path).write_text(json.dumps({"nodes": groups + cards, "edges": edges}, indent=1), encoding="utf-8")


def note_rows(kg: KG) -> DataFrame:
    """(filename, markdown): a note for each node, with links to its neighbours."""
    names = note_filenames(kg.nodes)
    near = adjacency(kg.edges, "relation", "confidence").join(names.withColumnRenamed("id", "dst"), "dst")
    links = near.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [["), "filename", F.lit("]] - `"), F.coalesce("relation", F.lit("")), F.lit("` ["), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("]")))), "\n").alias("links"))
    n = kg.nodes.join(names, "id").join(dominant_confidence(kg), "id").join(links, F.col("id") == F.col("src"), "left")
    yaml = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = F.concat(F.lit("---\nsource_file: "), yaml(F.col("source_file")), F.lit("\ntype: "), yaml(F.col("file_type")), F.lit("\ncommunity: "), F.coalesce(F.col("community").cast("string"), F.lit("none")), F.lit("\nconfidence: "), F.col("confidence"), F.lit("\n---\n\n# "), label_of(), F.lit("\n\n## Connections\n"), F.coalesce("links", F.lit("")), F.lit("\n"))
    return n.select("filename", head.alias("markdown"))


def community_notes(kg: KG) -> DataFrame:
    """(filename, markdown): an overview of each community, with cohesion, members, links to others and bridges."""
    names = note_filenames(kg.nodes)
    c = A.cohesion(kg)
    word = F.when(F.col("cohesion") >= 0.7, "tightly connected").when(F.col("cohesion") >= 0.4, "moderately connected").otherwise("loosely connected")
    members = kg.nodes.join(names, "id").groupBy("community").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [["), "filename", F.lit("]]")))), "\n").alias("members"))
    others = inter_community_edges(kg).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_edges")).alias("k"), "other"))), lambda x: F.concat(F.lit("- "), (-x["k"]).cast("string"), F.lit(" edges to [[_COMMUNITY_"), x["other"].cast("string"), F.lit("]]"))), "\n").alias("others"))
    bridges = bridge_nodes(kg).join(names, "id").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "filename", "degree", "reach"))), lambda x: F.concat(F.lit("- [["), x["filename"], F.lit("]] - degree "), x["degree"].cast("string"), F.lit(", reaches "), x["reach"].cast("string"))), "\n").alias("bridges"))
    m = c.join(members, "community").join(others, "community", "left").join(bridges, "community", "left")
    part = lambda title, x: F.when(F.col(x).isNotNull(), F.concat(F.lit(f"\n## {title}\n"), F.col(x), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\n"), F.col("n_nodes").cast("string"), F.lit(" nodes, cohesion "), F.format_string("%.2f", "cohesion"), F.lit(", "), word, F.lit("\n"), part("Members", "members"), part("Other communities", "others"), part("Bridges", "bridges"))
    return m.select(F.concat(F.lit("_COMMUNITY_"), F.col("community").cast("string")).alias("filename"), text.alias("markdown"))


def write_notes(rows: DataFrame, folder: str) -> int:
    """One file for each (filename, markdown), streamed through the driver."""
    out, n = Path(folder), 0
    out.mkdir(parents=True, exist_ok=True)
    for r in rows.toLocalIterator():
        (out / (re.sub(r"[\\/]", "-", r["filename"]) + ".md")).write_text(r["markdown"], encoding="utf-8")
        n += 1
    return n


def to_obsidian(kg: KG, folder: str) -> int:
    return write_notes(note_rows(kg).union(community_notes(kg)), folder)


def wiki_cross_links(kg: KG, n: int = 12) -> DataFrame:
    """(community, rank, other, n_links): the communities that a community's edges lead to most."""
    w = Window.partitionBy("community").orderBy(F.desc("n_edges"), "other")
    return inter_community_edges(kg).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("community", "rank", "other", F.col("n_edges").alias("n_links"))


def wiki_top_nodes(kg: KG, n: int = 25) -> DataFrame:
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "ord")
    d = kg.nodes.where("community is not null").join(degrees(kg), "id").withColumn("rank", F.row_number().over(w))
    return d.where(F.col("rank") <= n).select("community", "rank", "id", "label", "degree")


def wiki_audit(kg: KG) -> DataFrame:
    """(community, confidence, n, pct) of the edges at a community's members; an edge inside counts at both ends."""
    a = adjacency(kg.edges, "confidence").join(kg.nodes.where("community is not null").select(F.col("id").alias("src"), "community"), "src")
    c = a.groupBy("community", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("community"))
    return c.select("community", "confidence", "n", F.bround(F.col("n") * 100.0 / total).cast("long").alias("pct"))


def god_node_articles(kg: KG, n: int = 10, shown: int = 20) -> DataFrame:
    """(filename, markdown): an article for each of the best connected nodes, neighbours grouped by relation."""
    g = A.god_nodes(kg, n).select(F.col("id").alias("src"), "label", "degree")
    near = adjacency(kg.edges, "relation").join(F.broadcast(g), "src").join(kg.nodes.select(F.col("id").alias("dst"), F.coalesce("label", "id").alias("other")), "dst").join(degrees(kg).select(F.col("id").alias("dst"), F.col("degree").alias("d")), "dst")
    w = Window.partitionBy("src").orderBy(F.desc("d"), "other")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    rel = near.groupBy("src", "label", "degree", F.coalesce("relation", F.lit("related")).alias("relation")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: F.concat(F.lit("- [["), x["other"], F.lit("]]"))), "\n").alias("l"))
    body = rel.groupBy("src", "label", "degree").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("### "), "relation", F.lit("\n"), "l"))), "\n").alias("b"))
    return body.select(T.safe_filename(F.coalesce("label", "src")).alias("filename"), F.concat(F.lit("# "), F.coalesce("label", "src"), F.lit("\n\n"), F.col("degree").cast("string"), F.lit(" connections\n\n"), "b", F.lit("\n")).alias("markdown"))


def wiki_rows(kg: KG) -> DataFrame:
    """(filename, markdown) of community and god-node articles and the index; equal names get a number."""
    top_ = wiki_top_nodes(kg).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("label", "id").alias("l"), "degree"))), lambda x: F.concat(F.lit("- **"), x["l"], F.lit("** ("), x["degree"].cast("string"), F.lit(" connections)"))), "\n").alias("t"))
    size = kg.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("source_file") != "", F.concat(F.lit("- `"), "source_file", F.lit("`"))))), 1, 20), "\n").alias("s"))
    cross = wiki_cross_links(kg).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "n_links"))), lambda x: F.concat(F.lit("- [[Community "), x["other"].cast("string"), F.lit("]] ("), x["n_links"].cast("string"), F.lit(" shared connections)"))), "\n").alias("x"))
    audit = wiki_audit(kg).groupBy("community").agg(F.array_join(F.sort_array(F.collect_list(F.format_string("- %s: %d (%d%%)", "confidence", "n", "pct"))), "\n").alias("a"))
    m = size.join(top_, "community", "left").join(cross, "community", "left").join(audit, "community", "left")
    more = F.when(F.col("n") > 25, F.format_string("\n- ... and %d more nodes", F.col("n") - 25)).otherwise("")
    none = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\n> "), F.col("n").cast("string"), F.lit(" nodes\n\n## Key concepts\n"), none("t"), more, F.lit("\n\n## Relationships\n"), none("x"), F.lit("\n\n## Source files\n"), none("s"), F.lit("\n\n## Audit trail\n"), none("a"), F.lit("\n"))
    rows = m.select(F.concat(F.lit("Community_"), F.col("community").cast("string")).alias("filename"), text.alias("markdown")).union(god_node_articles(kg))
    w = Window.partitionBy("filename").orderBy("markdown")
    rows = rows.withColumn("k", F.row_number().over(w)).select(F.when(F.col("k") == 1, F.col("filename")).otherwise(F.concat("filename", F.lit("_"), F.col("k") - 1)).alias("filename"), "markdown")
    index = rows.agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- [["), "filename", F.lit("]]")))), "\n"), F.lit("\n")).alias("markdown")).select(F.lit("index").alias("filename"), "markdown")
    return rows.union(index)


def to_wiki(kg: KG, folder: str) -> int:
    return write_notes(wiki_rows(kg), folder)


# --- report
def report(kg: KG, betweenness: DataFrame | None, corpus: str = "", date: str = "", tokens: tuple[int, int] = (0, 0)) -> str:
    """The graph report as markdown; every section is a bounded query."""
    s = A.graph_stats(kg).first()
    avg = A.inferred_confidence(kg).first()
    out = [f"# Graph report {date}".rstrip(), "", "## Corpus check", corpus or "no figures", "", "## Summary", f"- {s['nodes']} nodes, {s['edges']} edges, {s['communities']} communities", f"- Extraction: {s['extracted_pct']}% EXTRACTED, {s['inferred_pct']}% INFERRED, {s['ambiguous_pct']}% AMBIGUOUS" + (f" (mean inferred confidence {avg['avg_inferred']})" if avg["n_inferred"] else ""), f"- Tokens: {tokens[0]:,} in, {tokens[1]:,} out", "", "## God nodes"]
    out += [f"{r['rank']}. `{r['label']}` - {r['degree']} edges" for r in A.god_nodes(kg).orderBy("rank").collect()]
    out += ["", "## Surprising connections"] + [f"- `{r['source']}` --{r['relation']}--> `{r['target']}` [{r['confidence']}] {r['reason']}" for r in A.surprising_connections(kg).orderBy("rank").collect()]
    if kg.hyperedges is not None and (hyper := kg.hyperedges.orderBy("id").limit(50).collect()):
        out += ["", "## Hyperedges"] + [f"- **{r['label']}**: {', '.join(r['nodes'])} [{r['confidence']} {r['confidence_score'] or 0:.2f}]" for r in hyper]
        out += [f"- {m - 50} more"] if (m := kg.hyperedges.count()) > 50 else []
    coh = {r["community"]: r["cohesion"] for r in A.cohesion(kg).orderBy(F.desc("n_nodes")).limit(200).collect()}
    out += ["", "## Communities"]
    for r in A.community_summary(kg).orderBy("community").limit(200).collect():
        out += [f"### Community {r['community']}", f"Cohesion {coh.get(r['community'])}", f"Nodes ({r['n_real']}): {r['shown']}" + (f" (+{r['more']} more)" if r["more"] else ""), ""]
    out += [f"{s['communities'] - 200} more communities are in the graph file.", ""] if s["communities"] > 200 else []
    if amb := A.ambiguous_edges(kg).orderBy("source", "target").limit(50).collect():
        out += ["## Ambiguous edges"] + [f"- `{r['source']}` - `{r['target']}` ({r['relation']})" for r in amb] + ([f"- {m - 50} more"] if (m := A.ambiguous_edges(kg).count()) > 50 else []) + [""]
    lone, thin = A.isolated_nodes(kg), A.thin_communities(kg)
    n, t = lone.count(), thin.count()
    if n or t or s["ambiguous_pct"] > 20:
        names = [f"`{r['label']}`" for r in A.top(lone, [F.asc("ord")], 5).orderBy("rank").collect()]
        out += ["## Knowledge gaps"] + ([f"- {n} weakly connected nodes: {', '.join(names)}" + (f" (+{n - 5} more)" if n > 5 else "")] if n else []) + ([f"- {t} thin communities (under 3 nodes)"] if t else []) + ([f"- {s['ambiguous_pct']}% of edges are ambiguous"] if s["ambiguous_pct"] > 20 else []) + [""]
    if betweenness is None:
        out += ["Bridges between communities were not looked for: the graph is too large for exact betweenness.", ""]
    out += ["## Suggested questions"] + [f"- **{r['question']}** {r['why']}" if r["question"] else r["why"] for r in A.suggest_questions(kg, betweenness).orderBy("rank").collect()]
    return "\n".join(out) + "\n"
