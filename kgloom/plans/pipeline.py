"""A folder of files to a clustered graph and its reports; and the same again for what changed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract import registry
from ..functions import text as T
from ..operators import analyze, community, export, traverse
from ..operators.build import build_graph, replace_files
from ..runtime import cut, exists
from ..schema import KG
from ..sources import files as S
from ..sources import web
from ..streaming import watch


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, text) of the code files below root that may be read."""
    f = S.scan(spark, root).where(~T.is_sensitive(F.col("path")))
    return f.where(T.suffix(F.col("path")).isin(*registry.EXTRACTORS)).select("path", "mtime", F.decode("content", "utf-8").alias("text"))


def build(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> KG:
    """Graph of extracted rows with communities, materialised between its steps."""
    kg = build_graph(nodes, edges, hyperedges)
    kg = KG(cut(kg.nodes), cut(kg.edges), kg.hyperedges)
    return community.with_communities(kg, community.cluster(kg))


def _cached(spark: SparkSession, out: str) -> DataFrame | None:
    return spark.read.schema(registry.SCHEMA).parquet(f"{out}/cache") if exists(spark, f"{out}/cache") else None


def run(spark: SparkSession, root: str, out: str) -> KG:
    """Scan, extract, build, cluster; graph, report and notes below `out`, extracted rows as a cache for the next run."""
    files, cache = code_files(spark, root), _cached(spark, out)
    Path(out).mkdir(parents=True, exist_ok=True)
    parsed = cut(registry.parse(files) if cache is None else registry.with_cache(files, cache)[0])
    parsed.write.mode("overwrite").parquet(f"{out}/cache")
    S.save_manifest(files, f"{out}/manifest")
    kg = build(registry.nodes_of(parsed), registry.edges_of(parsed).unionByName(registry.cross_file_uses(parsed)))
    write(kg, out, f"{files.count()} code files")
    return kg


def write(kg: KG, out: str, corpus: str = "") -> None:
    """graph.json, the report and, for small graphs, the page. Graphs too large for exact betweenness have a report without bridges."""
    export.to_json(kg, f"{out}/graph.json")
    middle = traverse.betweenness(kg)[0] if kg.edges.count() <= traverse.MOST_EDGES else None
    about = export.report(kg, middle, corpus, datetime.now(timezone.utc).date().isoformat())
    Path(f"{out}/GRAPH_REPORT.md").write_text(about, encoding="utf-8")
    if kg.nodes.limit(export.MOST_DRAWN + 1).count() <= export.MOST_DRAWN:
        export.to_html(kg, f"{out}/graph.html")


def update(spark: SparkSession, root: str, out: str, old_nodes: DataFrame, old_edges: DataFrame) -> tuple[KG, KG, str]:
    """(old, new, what changed): rows of changed and deleted files are replaced, the rest kept. Rows need a `source_file` and the `ord` that extraction gives them.

    Only new and changed files, and those that the cache below `out` lacks, are read. Uses across files depend on both of their ends,
    so all of them are resolved anew, from the cached imports of unchanged files too: the result is that of a full run.
    """
    files, cache = code_files(spark, root), _cached(spark, out)
    status = cut(S.changed(files.select("path", "mtime"), S.load_manifest(spark, f"{out}/manifest")))  # the manifest is written anew below
    fresh = registry.parse(files.join(status.where("status in ('new', 'changed')"), "path", "left_semi"))
    if cache is None:
        kept = registry.parse(files.join(status.where("status = 'unchanged'"), "path", "left_semi"))
    else:
        same = status.where("status = 'unchanged'")
        kept = cache.join(same, "path", "left_semi").unionByName(registry.parse(files.join(same, "path", "left_semi").join(cache, "path", "left_anti")))
    fresh, kept = cut(fresh), cut(kept)
    parsed = kept.unionByName(fresh)
    parsed.write.mode("overwrite").parquet(f"{out}/cache")
    gone = status.where("status in ('changed', 'deleted')").select(F.col("path").alias("source_file"))
    resolved = F.col("source_file").endswith(".py") & F.col("relation").eqNullSafe("uses") & F.col("confidence").eqNullSafe("INFERRED") & (F.col("source_location") == "")
    kept_of = lambda rows: rows.join(gone.select(F.col("source_file").alias("_gone")), F.col("ord.path") == F.col("_gone"), "left_anti")  # noqa: E731  (names without a file of their own, too)
    n = replace_files(kept_of(old_nodes), registry.nodes_of(fresh), gone)
    e = replace_files(kept_of(old_edges.where(~F.coalesce(resolved, F.lit(False)))), registry.edges_of(fresh), gone).unionByName(registry.cross_file_uses(parsed))
    old, new = build_graph(old_nodes, old_edges), build_graph(n, e)
    S.save_manifest(files, f"{out}/manifest")
    return old, new, analyze.diff_summary(analyze.graph_diff_nodes(old, new), analyze.graph_diff_edges(old, new))


def watch_folder(spark: SparkSession, root: str, out: str, every: str = "3 seconds", quiet: float = 3.0, rebuilt: Callable[[list[str]], None] | None = None) -> StreamingQuery:
    """Rebuilds `out` when code below root is edited, added or removed, and marks it (file needs_update) when other files are.

    The folder is listed anew every `every`, since file streams name a file only once; changes count when none is younger than `quiet`
    seconds. What was seen last is kept below `out`, so a restart goes on from there; the first look only takes note.
    """
    Path(out).mkdir(parents=True, exist_ok=True)
    seen = f"{out}/watched"

    def look(_: DataFrame, __: int) -> None:
        files = S.scan(spark, root).select("path", "mtime").where(watch.counts(F.col("path")))
        before = S.load_manifest(spark, seen)
        if before is None:
            return S.save_manifest(files, seen)
        files = cut(files)  # the table that it is compared with is written anew below
        youngest = F.max(F.unix_micros("mtime")) > F.lit(int((time.time() - quiet) * 1e6))
        changes = cut(S.changed(files, before).where("status <> 'unchanged'"))
        if changes.isEmpty() or files.join(changes, "path", "left_semi").agg(youngest).first()[0]:
            return
        S.save_manifest(files, seen)
        code = changes.where(T.suffix(F.col("path")).isin(T.CODE))
        if not code.isEmpty():
            run(spark, root, out)
        if not changes.join(code, "path", "left_anti").isEmpty():
            Path(f"{out}/needs_update").write_text("1")
        if rebuilt is not None:
            rebuilt([r["path"] for r in changes.orderBy("path").toLocalIterator()])

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).option("checkpointLocation", f"{out}/polls").foreachBatch(look).start()


def ingest(spark: SparkSession, pages: DataFrame, folder: str, captured_at: str) -> list[Path]:
    """Captured pages (url, html) as notes below `folder`, each by the kind of its URL; a name that is taken gets a counter.

    Abstract pages keep authors and abstract, posts (html: the oEmbed answer) their author; every other kind is kept as a web page. URLs of
    other schemes than http and https raise ValueError before anything is written.
    """
    if bad := pages.where(~web.scheme_allowed(F.col("url"))).select("url").first():
        web.validate_url(bad["url"])
    kind = web.url_type(F.col("url"))
    papers, posts = web.arxiv_records(pages.where(kind == "arxiv")), web.tweet_records(pages.where(kind == "tweet").withColumnRenamed("html", "body"))
    head = lambda what, *more: F.concat_ws("\n", F.lit("---"), F.concat(F.lit("source_url: "), F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2)), F.lit(f"type: {what}"), F.lit(f"captured_at: {captured_at}"), *more, F.lit("---"), F.lit(""))
    notes = web.webpage_records(pages.where(kind != "tweet").join(papers.select("url"), "url", "left_anti"), captured_at)
    notes = notes.unionByName(papers.select("url", F.concat(F.lit("arxiv_"), F.replace("arxiv_id", F.lit("."), F.lit("_")), F.lit(".md")).alias("file_name"), F.concat(head("paper", F.concat(F.lit("arxiv_id: "), "arxiv_id")), F.lit("# "), "title", F.lit("\n\n"), "authors", F.lit("\n\n"), "abstract", F.lit("\n")).alias("markdown")))
    notes = notes.unionByName(posts.select("url", F.concat(F.substring(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"(?U)[^\w.-]+", "_"), 1, 80), F.lit(".md")).alias("file_name"), F.concat(head("tweet", F.concat(F.lit("author: "), "author")), "text", F.lit("\n")).alias("markdown")))
    base, written = Path(folder), []
    base.mkdir(parents=True, exist_ok=True)
    for r in notes.orderBy("url").toLocalIterator():
        path, k = base / r["file_name"], 0
        while path.exists():
            k += 1
            path = base / f"{r['file_name'].removesuffix('.md')}_{k}.md"
        path.write_text(r["markdown"], encoding="utf-8")
        written.append(path)
    return written


def save_answer(folder: str, question: str, answer: str, nodes: list[str], kind: str = "query") -> Path:
    """A question and its answer as a note that later scans read; ten nodes at most in its head, all in its body."""
    import re

    now = datetime.now(timezone.utc)
    one = " ".join(question.split()).replace('"', "'")
    short = re.sub(r"\W", "_", one).lower()
    short = short[:50].strip("_")
    path = Path(folder) / f"query_{now:%Y%m%d_%H%M%S}_{short}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    about = {"type": kind, "date": now.isoformat(), "question": one, "source_nodes": nodes[:10]}
    head = ["---", *[f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in about.items()], "---"]
    path.write_text("\n".join([*head, "", f"# {one}", "", answer, "", "## Source nodes", *[f"- {n}" for n in nodes], ""]), encoding="utf-8")
    return path
