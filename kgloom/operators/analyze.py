"""Ranking, scoring and comparison of graphs whose nodes carry a `community`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import number
from ..schema import KG, STRUCTURAL, score_default
from .build import adjacency, degrees

FILE_EXTS = ("c", "cpp", "go", "h", "java", "js", "py", "rb", "rs", "ts")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, numbered in `rank`; only those n rows are ever in one place."""
    some = df.orderBy(*order).limit(n)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def is_file_node(label: Column, degree: Column) -> Column:
    """Labels of files, method stubs, and functions with one edge or none."""
    x = F.coalesce(label, F.lit(""))
    call = x.endswith("()")
    return (x != "") & (F.element_at(F.split(x, r"\."), -1).isin(*FILE_EXTS) | (x.startswith(".") & call) | (call & (degree <= 1)))


def is_concept_node(source_file: Column) -> Column:
    x = F.coalesce(source_file, F.lit(""))
    return (x == "") | ~T.file_name(x).contains(".")


def node_facts(kg: KG) -> DataFrame:
    """Nodes with degree, is_file and is_concept."""
    n = kg.nodes.join(degrees(kg), "id")
    return n.withColumn("is_file", is_file_node(F.col("label"), F.col("degree"))).withColumn("is_concept", is_concept_node(F.col("source_file")))


def edge_facts(kg: KG, *cols: str) -> DataFrame:
    """Edges with facts of both ends, as u_<name> and v_<name>."""
    cols = cols or ("label", "source_file", "community", "degree", "is_file", "is_concept")
    f = node_facts(kg).select("id", *cols)
    out = kg.edges
    for end in ("u", "v"):
        out = out.join(f.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end)
    return out


def name(end: str) -> Column:
    return F.coalesce(f"{end}_label", end)


def oriented(df: DataFrame, *more: str) -> DataFrame:
    """Source and target by the edge's direction, whatever the order of its ends."""
    fwd = F.col("src") == F.col("u")
    pick = lambda a, b: F.when(fwd, a).otherwise(b)
    return df.select(
        pick(name("u"), name("v")).alias("source"), pick(name("v"), name("u")).alias("target"), pick(F.col("u_source_file"), F.col("v_source_file")).alias("source_file"), pick(F.col("v_source_file"), F.col("u_source_file")).alias("target_file"),
        F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "relation", *more,
    )


def god_nodes(kg: KG, n: int = 10) -> DataFrame:
    """(rank, id, label, degree) of the best connected real entities."""
    f = node_facts(kg).where(~F.col("is_file") & ~F.col("is_concept"))
    return top(f.select("id", "label", "degree", "ord"), [F.desc("degree"), F.asc("ord")], n).select("rank", "id", "label", "degree")


def _surprise(df: DataFrame) -> DataFrame:
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    cat_u, cat_v = T.file_category(F.col("u_source_file")), T.file_category(F.col("v_source_file"))
    far = T.top_dir(F.col("u_source_file")) != T.top_dir(F.col("v_source_file"))
    apart = F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False))
    like = F.coalesce(F.col("relation") == "semantically_similar_to", F.lit(False))
    hub = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    base = F.when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1) + F.when(cat_u != cat_v, 2).otherwise(0) + F.when(far, 2).otherwise(0) + F.when(apart, 1).otherwise(0)
    score = F.when(like, F.floor(base * 1.5)).otherwise(base) + F.when(hub, 1).otherwise(0)
    low = F.col("u_degree") <= 2
    why = [
        F.when(conf.isin("AMBIGUOUS", "INFERRED"), F.concat(F.lower(conf), F.lit(" connection, not stated outright in the source"))),
        F.when(cat_u != cat_v, F.concat(F.lit("joins file types "), cat_u, F.lit(" and "), cat_v)),
        F.when(far, F.lit("joins top-level folders")),
        F.when(apart, F.lit("joins communities")),
        F.when(like, F.lit("alike in meaning without a structural link")),
        F.when(hub, F.concat(F.lit("peripheral `"), F.when(low, name("u")).otherwise(name("v")), F.lit("` reaches hub `"), F.when(low, name("v")).otherwise(name("u")), F.lit("`"))),
    ]
    reasons = F.array_join(F.filter(F.array(*why), lambda x: x.isNotNull()), "; ")
    return df.withColumn("score", score.cast("long")).withColumn("why", F.when(reasons == "", "cross-file connection").otherwise(reasons))


def surprise_scores(kg: KG) -> DataFrame:
    """(u, v, score, why) of every edge between two files."""
    e = edge_facts(kg).where("u_source_file <> '' and v_source_file <> '' and u_source_file <> v_source_file")
    return _surprise(e).select("u", "v", "score", "why")


def _not_structural() -> Column:
    return ~F.coalesce(F.col("relation").isin(*STRUCTURAL), F.lit(False))


def cross_file_surprises(kg: KG, n: int = 5) -> DataFrame:
    """The n most surprising edges between files and real entities."""
    e = edge_facts(kg).where(_not_structural() & ~F.col("u_is_concept") & ~F.col("v_is_concept") & ~F.col("u_is_file") & ~F.col("v_is_file"))
    e = _surprise(e.where("u_source_file <> v_source_file"))
    best = top(e, [F.desc("score"), F.asc("u_ord"), F.asc("ord")], n)
    return oriented(best, "score", "why", "rank")


def cross_community_surprises(kg: KG, n: int = 5) -> DataFrame:
    """One edge for each pair of communities that edges join, the least certain first."""
    e = edge_facts(kg).where(_not_structural() & ~F.col("u_is_file") & ~F.col("v_is_file") & (F.col("u_community") != F.col("v_community")))
    sure = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.coalesce("confidence", F.lit("EXTRACTED")) == "EXTRACTED", 2).otherwise(3)
    e = e.withColumn("sure", sure)
    order = [F.asc("sure"), F.asc("u_ord"), F.asc("ord")]
    w = Window.partitionBy(F.least("u_community", "v_community"), F.greatest("u_community", "v_community")).orderBy(*order)
    e = e.withColumn("k", F.row_number().over(w)).where("k = 1")
    note = F.concat(F.lit("joins community "), F.col("u_community"), F.lit(" to "), F.col("v_community"))
    return oriented(top(e, order, n).withColumn("note", note), "note", "rank")


def bridging_edges(kg: KG, betweenness: DataFrame, n: int = 5) -> DataFrame:
    """The n edges of highest betweenness (u, v, betweenness), for graphs without communities."""
    e = edge_facts(kg, "label", "source_file").join(betweenness.select("u", "v", "betweenness"), ["u", "v"])
    best = top(e, [F.desc(F.round("betweenness", 9)), F.asc("u_ord"), F.asc("ord")], n)
    both = best.select(name("u").alias("source"), name("v").alias("target"), F.col("u_source_file").alias("source_file"), F.col("v_source_file").alias("target_file"), F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), F.coalesce("relation", F.lit("")).alias("relation"), "betweenness", "rank")
    return both.withColumn("note", F.concat(F.lit("holds the graph together (betweenness "), F.format_string("%.3f", "betweenness"), F.lit(")"))).drop("betweenness")


def surprising_connections(kg: KG, n: int = 5, edge_betweenness: DataFrame | None = None) -> DataFrame:
    """Edges between files where there are several; else, or where there are none, edges between communities.

    In a graph without communities the latter are the edges of highest betweenness: (u, v, betweenness), worked out here where it isn't given.
    """
    files = kg.nodes.where("source_file <> ''").agg(F.count_distinct("source_file")).first()[0]
    if files > 1:
        found = cross_file_surprises(kg, n).select("rank", "source", "target", "confidence", "relation", F.col("why").alias("reason"))
        if not found.isEmpty():
            return found
    if kg.nodes.where("community is not null").isEmpty():
        if edge_betweenness is None:
            from .traverse import betweenness

            edge_betweenness = betweenness(kg)[1]
        return bridging_edges(kg, edge_betweenness, n).select("rank", "source", "target", "confidence", "relation", F.col("note").alias("reason"))
    return cross_community_surprises(kg, n).select("rank", "source", "target", "confidence", "relation", F.col("note").alias("reason"))


def cohesion(kg: KG) -> DataFrame:
    """(community, n_nodes, cohesion): edges inside over possible pairs, to 2 digits; 1 for a single node."""
    c = kg.nodes.select("id", "community").where("community is not null")
    e = kg.edges.join(c.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    inside = e.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("m"))
    size = c.groupBy("community").agg(F.count("*").alias("n_nodes"))
    out = size.join(inside, "community", "left")
    ratio = F.bround(F.coalesce("m", F.lit(0)) / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2), 2)
    return out.select("community", "n_nodes", F.when(F.col("n_nodes") <= 1, 1.0).otherwise(ratio).alias("cohesion"))


def community_rank(members: DataFrame) -> DataFrame:
    """(community, size, cid) of (community, id, ord): numbers by falling size, then by first member."""
    s = members.groupBy("community").agg(F.count("*").alias("size"), F.min("ord").alias("first"))
    return number(s, [F.desc("size"), F.asc("first")], "cid").select("community", "size", F.col("cid").cast("int").alias("cid"))


def community_reach(kg: KG) -> DataFrame:
    """(id, reach): communities other than its own among a node's neighbours."""
    c = kg.nodes.select("id", "community")
    a = adjacency(kg.edges).join(c.select(F.col("id").alias("dst"), F.col("community").alias("theirs")), "dst").join(c.withColumnRenamed("id", "src"), "src")
    r = a.groupBy("src").agg(F.count_distinct(F.when(~F.col("theirs").eqNullSafe(F.col("community")), F.col("theirs"))).alias("reach"))
    return c.join(r, c["id"] == r["src"], "left").select("id", F.coalesce("reach", F.lit(0)).alias("reach"))


def graph_stats(kg: KG) -> DataFrame:
    """One row: nodes, edges, communities, and the share of each confidence in percent."""
    n = kg.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"))
    c, total = F.coalesce("confidence", F.lit("EXTRACTED")), F.greatest(F.count("*"), F.lit(1))
    share = [F.bround(F.count_if(c == x) * 100.0 / total).cast("long").alias(x.lower() + "_pct") for x in ("EXTRACTED", "INFERRED", "AMBIGUOUS")]
    return n.join(kg.edges.agg(F.count("*").alias("edges"), *share), how="cross")


def inferred_confidence(kg: KG) -> DataFrame:
    """One row: mean score of inferred edges, those without one counting 0.5, to 2 digits."""
    return kg.edges.where("confidence = 'INFERRED'").agg(F.bround(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 2).alias("avg_inferred"), F.count("*").alias("n_inferred"))


def ambiguous_edges(kg: KG) -> DataFrame:
    return oriented(edge_facts(kg, "label", "source_file").where("confidence = 'AMBIGUOUS'")).select("source", "target", "relation", "source_file", "target_file")


def isolated_nodes(kg: KG) -> DataFrame:
    """(id, label, degree) of real nodes with one edge or none."""
    return node_facts(kg).where((F.col("degree") <= 1) & ~F.col("is_file") & ~F.col("is_concept")).select("id", "label", "degree", "ord")


def thin_communities(kg: KG, below: int = 3) -> DataFrame:
    return kg.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list("id")).alias("members")).where(F.col("n_nodes") < below)


def community_summary(kg: KG, shown: int = 8) -> DataFrame:
    """(community, n_real, shown, more): a community's first real nodes, and how many more there are."""
    f = node_facts(kg).where(~F.col("is_file") & F.col("community").isNotNull())
    w = Window.partitionBy("community").orderBy("ord")
    f = f.withColumn("k", F.row_number().over(w))
    out = f.groupBy("community").agg(F.count("*").alias("n_real"), F.sort_array(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", F.coalesce("label", "id").alias("l"))))).alias("s"))
    return out.select("community", "n_real", F.array_join(F.transform("s", lambda x: x["l"]), ", ").alias("shown"), F.greatest(F.col("n_real") - shown, F.lit(0)).alias("more"))


# --- questions
def q_ambiguous(kg: KG) -> DataFrame:
    e = edge_facts(kg, "label").where("confidence = 'AMBIGUOUS'")
    q = F.concat(F.lit("What exactly relates `"), name("u"), F.lit("` and `"), name("v"), F.lit("`?"))
    why = F.concat(F.lit("The edge is AMBIGUOUS (relation: "), F.coalesce("relation", F.lit("related to")), F.lit(")."))
    return e.select(F.lit("ambiguous_edge").alias("type"), q.alias("question"), why.alias("why"), "u_ord", "ord")


def q_bridges(kg: KG, betweenness: DataFrame, n: int = 3) -> DataFrame:
    """Questions about the n real nodes of highest betweenness that have neighbours in other communities."""
    f = node_facts(kg).join(betweenness, "id").where(~F.col("is_file") & ~F.col("is_concept") & (F.col("betweenness") > 0))
    best = top(f, [F.desc("betweenness"), F.asc("ord")], n)
    c = kg.nodes.select(F.col("id").alias("dst"), F.col("community").alias("theirs"))
    a = adjacency(kg.edges).join(F.broadcast(best.select(F.col("id").alias("src"), "label", "community", "betweenness", "rank")), "src").join(c, "dst").where(~F.col("theirs").eqNullSafe(F.col("community")))
    g = a.groupBy("src", "label", "community", "betweenness", "rank").agg(F.sort_array(F.collect_set(F.coalesce(F.col("theirs").cast("string"), F.lit("none")))).alias("others"))
    q = F.concat(F.lit("Why does `"), F.coalesce("label", "src"), F.lit("` join community "), F.coalesce(F.col("community").cast("string"), F.lit("none")), F.lit(" to "), F.array_join("others", ", "), F.lit("?"))
    return g.select(F.lit("bridge_node").alias("type"), q.alias("question"), F.concat(F.lit("Betweenness "), F.format_string("%.3f", "betweenness")).alias("why"), "rank")


def q_verify_inferred(kg: KG, n: int = 5) -> DataFrame:
    """Questions about the n best connected nodes that have two inferred edges or more."""
    best = top(node_facts(kg).where(~F.col("is_file")).select("id", "label", "degree", "ord"), [F.desc("degree"), F.asc("ord")], n)
    a = adjacency(kg.edges.where("confidence = 'INFERRED'"), "ord").join(F.broadcast(best.select(F.col("id").alias("src"), F.coalesce("label", "id").alias("name"), "rank")), "src")
    a = a.join(kg.nodes.select(F.col("id").alias("dst"), F.coalesce("label", "id").alias("other")), "dst")
    g = a.groupBy("src", "name", "rank").agg(F.count("*").alias("k"), F.slice(F.array_sort(F.collect_list(F.struct("ord", "other"))), 1, 2).alias("two")).where("k >= 2")
    two = F.transform("two", lambda x: x["other"])
    q = F.format_string("Are the %d inferred relations of `%s` (such as those with `%s` and `%s`) right?", "k", "name", two[0], two[1])
    return g.select(F.lit("verify_inferred").alias("type"), q.alias("question"), F.format_string("`%s` has %d INFERRED edges.", "name", "k").alias("why"), "rank")


def q_isolated(kg: KG) -> DataFrame:
    """One question about weakly connected nodes, naming the first three; none where there are none."""
    lone = isolated_nodes(kg)
    first = top(lone, [F.asc("ord")], 3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("label", "id").alias("l")))), lambda x: F.concat(F.lit("`"), x["l"], F.lit("`"))), ", ").alias("names"))
    both = first.join(lone.agg(F.count("*").alias("n")), how="cross").where("n > 0")
    return both.select(F.lit("isolated_nodes").alias("type"), F.concat(F.lit("What connects "), F.col("names"), F.lit(" to the rest?")).alias("question"), F.format_string("%d nodes have one edge or none.", "n").alias("why"))


def q_low_cohesion(kg: KG) -> DataFrame:
    c = cohesion(kg).where("cohesion < 0.15 and n_nodes >= 5")
    return c.select(F.lit("low_cohesion").alias("type"), F.concat(F.lit("Should community "), F.col("community"), F.lit(" be split?")).alias("question"), F.concat(F.lit("Its cohesion is "), F.format_string("%.2f", "cohesion")).alias("why"), "community")


def suggest_questions(kg: KG, betweenness: DataFrame | None, n: int = 7) -> DataFrame:
    """(rank, type, question, why): ambiguous edges, bridges (where betweenness is given), inferred relations, isolated nodes, loose communities, n in all."""
    key = lambda df, s, *o: top(df, list(o), n).select(F.lit(s).alias("section"), "rank", "type", "question", "why")
    parts = [key(q_ambiguous(kg), 1, F.asc("u_ord"), F.asc("ord")), *([] if betweenness is None else [key(q_bridges(kg, betweenness), 2, F.asc("rank"))]), key(q_verify_inferred(kg), 3, F.asc("rank")), key(q_isolated(kg), 4, F.asc("question")), key(q_low_cohesion(kg), 5, F.asc("community"))]
    found = reduce(DataFrame.unionByName, parts)
    out = top(found.withColumnRenamed("rank", "r"), [F.asc("section"), F.asc("r")], n).select("rank", "type", "question", "why")
    if out.isEmpty():
        return kg.nodes.sparkSession.createDataFrame([(1, "no_signal", None, "Too few signals: no ambiguous or inferred edges, no bridges, all communities close-knit.")], "rank int, type string, question string, why string")
    return out


# --- comparison
def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, columns) of rows that only one table holds. Either is read once, and both meet in one shuffle."""
    side = lambda df, is_new: df.withColumns({"_old": F.lit(not is_new), "_new": F.lit(is_new)})
    both = side(old, False).union(side(new, True)).groupBy(*old.columns).agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new")).where("_old <> _new")
    return both.select(F.when(F.col("_new"), "added").otherwise("removed").alias("change"), *old.columns)


def graph_diff_nodes(old: KG, new: KG) -> DataFrame:
    """(change, id): nodes added and removed."""
    return _changes(old.nodes.select("id"), new.nodes.select("id"))


def graph_diff_edges(old: KG, new: KG) -> DataFrame:
    """(change, a, b, relation): edges added and removed, whatever their direction."""
    key = lambda kg: kg.edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.coalesce("relation", F.lit("")).alias("relation"))
    return _changes(key(old), key(new))


def diff_summary(nodes: DataFrame, edges: DataFrame) -> str:
    count = {**{("node", r[0]): r[1] for r in nodes.groupBy("change").count().collect()}, **{("edge", r[0]): r[1] for r in edges.groupBy("change").count().collect()}}
    said = [f"{count[k]} {k[0]}{'' if count[k] == 1 else 's'} {k[1]}" for k in (("node", "added"), ("edge", "added"), ("node", "removed"), ("edge", "removed")) if count.get(k)]
    return ", ".join(said) or "no changes"


def with_confidence(kg: KG) -> DataFrame:
    return kg.edges.withColumn("confidence_score", score_default(F.col("confidence"), F.col("confidence_score")))
