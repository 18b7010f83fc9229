"""Every operator as a named query over the test tables, with the DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from ..operators import build as B
from ..operators import export as X
from ..operators import toc, traverse
from ..schema import score_default
from ..sources import files as S
from ..sources import web
from ..streaming import watch
from . import views as V
from .views import duck, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rel(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    V._register(spark, sf, *tables)
    return spark.sql(sql)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- files and texts
FILES = """SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN concat('src/node_modules/pkg/a', doc_id, '.js') WHEN 1 THEN concat('app/my_venv/lib/x', doc_id, '.py') WHEN 2 THEN concat('keys/id_rsa', CASE WHEN doc_id % 3 = 0 THEN '.pub' ELSE '' END)
  WHEN 3 THEN concat('conf/.env.', doc_id) WHEN 4 THEN concat('notes/API_Token_', doc_id, '.md') WHEN 5 THEN concat('pkg.egg-info/r', doc_id, '.txt') WHEN 6 THEN concat('certs/site', doc_id, '.PEM') WHEN 7 THEN concat('a/.hidden/b', doc_id, '.go')
  ELSE concat(source, '/', lang, '/d', doc_id, CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.PNG' WHEN 4 THEN '.txt' WHEN 5 THEN '.rs' WHEN 6 THEN '.bin' WHEN 7 THEN '' ELSE '.tsx' END) END AS path,
  CASE WHEN doc_id % 6 = 1 THEN concat('Abstract: we propose a method, see arXiv 1706.03762 and [12]. doi: 10.1', text) ELSE text END AS text FROM documents"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    return rel(spark, sf, FILES, "documents")


_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]+)$', 1))"


def _re(p: str, i: bool) -> str:
    return "'" + (("(?i)" if i else "") + p).replace("'", "''") + "'"


_PAPER = " + ".join(f"CAST(regexp_matches(substring(coalesce(text, ''), 1, 3000), {_re(p, i)}) AS INT)" for p, i in T.PAPER_MARKS)
_CLASS = f"CASE WHEN {_EXT} IN ({quoted(T.CODE)}) THEN 'code' WHEN {_EXT} IN ({quoted(T.PAPER)}) THEN 'paper' WHEN {_EXT} IN ({quoted(T.IMAGE)}) THEN 'image' WHEN {_EXT} IN ({quoted(T.DOCUMENT)}) THEN CASE WHEN {_PAPER} >= 3 THEN 'paper' ELSE 'document' END END"
_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query("noise_dir_filter", f"SELECT doc_id, path, len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ({quoted(T.SKIPPED_DIRS)}) OR regexp_matches(x, '{T.NOISE_SUFFIX}') OR x LIKE '.%')) > 0 AS noise FROM ({FILES})")
def _(spark, sf):
    return files(spark, sf).select("doc_id", "path", T.in_noise_dir(F.col("path")).alias("noise"))


@query("sensitive_filter", f"SELECT doc_id, path FROM ({FILES}) WHERE " + " OR ".join(f"regexp_matches({_NAME}, {_re(p, i)}) OR regexp_matches(path, {_re(p, i)})" for p, i in T.SENSITIVE))
def _(spark, sf):
    return files(spark, sf).where(T.is_sensitive(F.col("path"))).select("doc_id", "path")


@query("classify_documents", f"SELECT doc_id, path, {_CLASS} AS file_type FROM ({FILES})")
def _(spark, sf):
    return files(spark, sf).select("doc_id", "path", T.classify(F.col("path"), F.col("text")).alias("file_type"))


@query("paper_signal_score", f"SELECT doc_id, CAST({_PAPER} AS INT) AS score FROM ({FILES})")
def _(spark, sf):
    return files(spark, sf).select("doc_id", T.paper_score(F.col("text")).cast("int").alias("score"))


@query("word_count", f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS words FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


def _detected(spark, sf):
    f = files(spark, sf)
    return f.select("path", T.classify(F.col("path"), F.col("text")).alias("file_type"), T.word_count(F.col("text")).alias("words")).where("file_type is not null")


_DETECTED = f"SELECT path, {_CLASS} AS file_type, CAST({_WORDS} AS BIGINT) AS words FROM ({FILES}) WHERE {_CLASS} IS NOT NULL"


@query(
    "corpus_health",
    f"""WITH d AS (SELECT count(*) AS n, CAST(sum(words) AS BIGINT) AS w FROM ({_DETECTED})) SELECT n AS total_files, w AS total_words, w >= 50000 AS needs_graph,
    CASE WHEN w < 50000 THEN 'Corpus is ~' || format('{{:,}}', w) || ' words - it fits in a context window; a graph may not be needed.'
    WHEN w >= 500000 OR n >= 200 THEN 'Large corpus: ' || format('{{:,}}', n) || ' files, ~' || format('{{:,}}', w) || ' words. Extraction will be expensive.' END AS warning FROM d""",
)
def _(spark, sf):
    return S.corpus_health(_detected(spark, sf))


@query("files_by_type", f"SELECT file_type, count(*) AS n_files, CAST(sum(words) AS BIGINT) AS n_words, list_sort(list(path)) AS paths FROM ({_DETECTED}) GROUP BY 1")
def _(spark, sf):
    return S.files_by_type(_detected(spark, sf))


URLS = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://X.com/u/status/1' WHEN 1 THEN 'https://arxiv.org/abs/1706.03762' WHEN 2 THEN 'https://github.com/a/b' WHEN 3 THEN 'https://youtu.be/z' WHEN 4 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '/a.PDF?x=1') WHEN 5 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '/i.webp') ELSE url END AS url, html FROM pages"


@query(
    "url_type",
    f"""WITH p AS (SELECT page_id, url, lower(url) AS u, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM ({URLS}))
    SELECT page_id, url, CASE WHEN contains(u, 'twitter.com') OR contains(u, 'x.com') THEN 'tweet' WHEN contains(u, 'arxiv.org') THEN 'arxiv' WHEN contains(u, 'github.com') THEN 'github'
    WHEN contains(u, 'youtube.com') OR contains(u, 'youtu.be') THEN 'youtube' WHEN path LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(path, '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind FROM p""",
)
def _(spark, sf):
    return rel(spark, sf, URLS, "pages").select("page_id", "url", web.url_type(F.col("url")).alias("kind"))


_TEXT = "html"
for _tag in ("script", "style"):
    _TEXT = f"regexp_replace({_TEXT}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_TEXT = f"substring(trim(regexp_replace(regexp_replace({_TEXT}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000)"
_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]{0,}>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@query("html_to_text", f"SELECT page_id, {_TEXT} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.html_to_text(F.col("html")).alias("text"))


@query("page_title", f"SELECT page_id, CASE WHEN {_TITLE} = '' THEN url ELSE {_TITLE} END AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.page_title(F.col("html"), F.col("url")).alias("title"))


_SCHEMES = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('ftp', substring(url, 5)) WHEN 1 THEN upper(url) WHEN 2 THEN 'javascript:x' WHEN 3 THEN 'nothing' ELSE url END AS url FROM pages"


@query("url_scheme_check", f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('http', 'https') AS allowed FROM ({_SCHEMES})")
def _(spark, sf):
    return rel(spark, sf, _SCHEMES, "pages").select("page_id", web.scheme_allowed(F.col("url")).alias("allowed"))


_YAML = "replace(replace(regexp_replace({x}, '[\\r\\n]+', ' ', 'g'), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
_WHOLE_TITLE = f"CASE WHEN {_TITLE} = '' THEN url ELSE {_TITLE} END"


@query(
    "webpage_records",
    f"""SELECT url, substring(regexp_replace(regexp_replace(url, '^https?://', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_.-]+', '_', 'g'), 1, 80) || '.md' AS file_name,
    '---' || chr(10) || 'source_url: "' || {_YAML.format(x="url")} || '"' || chr(10) || 'type: webpage' || chr(10) || 'title: "' || {_YAML.format(x="t")} || '"' || chr(10) || 'captured_at: 2024-01-01T00:00:00+00:00' || chr(10) || '---' || chr(10) || chr(10) || '# ' || t || chr(10) || chr(10) || {_TEXT} || chr(10) AS markdown
    FROM (SELECT url, html, {_WHOLE_TITLE} AS t FROM pages)""",
)
def _(spark, sf):
    return web.webpage_records(table(spark, sf, "pages"), "2024-01-01T00:00:00+00:00")


_STRIP = "regexp_replace(regexp_replace({x}, '^[_.]+', ''), '[_.]+$', '')"


@query(
    "make_id",
    f"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter([{_STRIP.format(x="source")}, {_STRIP.format(x="'__init__'")}, {_STRIP.format(x="substring(text, 1, 30)")}], lambda x: x <> ''), '_'), '[^a-zA-Z0-9]+', '_', 'g'), '^[_]+', ''), '[_]+$', '')) AS id FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.make_id(F.col("source"), F.lit("__init__"), F.substring("text", 1, 30)).alias("id"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.file_hash(F.col("text")).alias("sha256"))


_CLEAN = "substring(regexp_replace({x}, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256)"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"


@query("sanitize_label", f"SELECT page_id, {_CLEAN.format(x='html')} AS label FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitize_label(F.col("html")).alias("label"))


@query("query_slug", "SELECT conv_id, turn, regexp_replace(regexp_replace(substring(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '_', 'g'), 1, 50), '^[_]+', ''), '[_]+$', '') AS slug FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.query_slug(F.col("text")).alias("slug"))


@query("safe_filename", "SELECT page_id, replace(replace(replace(url, '/', '-'), ' ', '_'), ':', '-') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


_CAT = "CASE WHEN contains({p}, '.') THEN lower(list_extract(string_split({p}, '.'), -1)) ELSE '' END"
_CATS = f"CASE WHEN {_CAT} IN ('py','ts','tsx','js','go','rs','java','rb','cpp','c','h','cs','kt','scala','php') THEN 'code' WHEN {_CAT} IN ('pdf') THEN 'paper' WHEN {_CAT} IN ('png','jpg','jpeg','webp','gif','svg') THEN 'image' ELSE 'doc' END"


@query("file_category", f"SELECT doc_id, {_CATS.format(p='path')} AS category, split_part(path, '/', 1) AS top FROM ({FILES})")
def _(spark, sf):
    return files(spark, sf).select("doc_id", T.file_category(F.col("path")).alias("category"), T.top_dir(F.col("path")).alias("top"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


# --- cache, manifest, merge
_CACHED = "SELECT doc_id, text, sha256(text) AS h FROM documents"


def _cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    return d.select("doc_id", "sha256"), d.where("lang = 'en'").groupBy("sha256").agg(F.min("lang").alias("lang"))


_HC = "c AS (SELECT sha256(text) AS sha256, min(lang) AS lang FROM documents WHERE lang = 'en' GROUP BY 1), d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)"


@query("cache_lookup", f"WITH {_HC} SELECT sha256, doc_id, lang FROM d JOIN c USING (sha256)")
def _(spark, sf):
    return B.cache_split(*_cache(spark, sf))[0]


@query("cache_miss_anti_join", f"WITH {_HC} SELECT sha256, doc_id FROM d ANTI JOIN c USING (sha256)")
def _(spark, sf):
    return B.cache_split(*_cache(spark, sf))[1]


@query("cache_hit_semi_join", f"WITH {_HC} SELECT sha256, doc_id FROM d SEMI JOIN c USING (sha256)")
def _(spark, sf):
    f, c = _cache(spark, sf)
    return f.join(c, "sha256", "left_semi")


@query(
    "incremental_diff",
    """WITH o AS (SELECT concat(o_custkey, '/', o_orderpriority) AS path, o_orderdate AS d FROM orders), a AS (SELECT path, max(d) AS t FROM o WHERE d < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT path, max(d) AS t FROM o WHERE d >= TIMESTAMP '1993-06-01' GROUP BY 1)
    SELECT path, CASE WHEN a.t IS NULL THEN 'new' WHEN b.t IS NULL THEN 'deleted' WHEN b.t > a.t THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (path)""",
)
def _(spark, sf):
    """Files, and their state as of an earlier day; those without change since another day are gone."""
    o = table(spark, sf, "orders").select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("path"), F.col("o_orderdate").alias("t"))
    old = o.where("t < timestamp_ntz'1996-01-01'").groupBy("path").agg(F.max("t").alias("mtime"))
    return S.changed(o.where("t >= timestamp_ntz'1993-06-01'").groupBy("path").agg(F.max("t").alias("mtime")), old)


_XA, _XB = "SELECT concat('n', c_custkey) AS id, c_name AS label, CAST(c_custkey AS BIGINT) AS ord FROM customer", "SELECT concat('n', s_suppkey * 20) AS id, upper(s_name) AS label, CAST(s_suppkey AS BIGINT) AS ord FROM supplier"
_XE = "SELECT concat('n', o_custkey) AS source, concat('n', o_orderkey % {k}) AS target, CAST(o_orderkey AS BIGINT) AS ord FROM orders"


@query("merge_extractions", f"WITH u AS (SELECT *, 0 AS r FROM ({_XA}) UNION ALL SELECT *, 1 FROM ({_XB})) SELECT id, label FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, ord) = 1")
def _(spark, sf):
    e = rel(spark, sf, _XE.format(k=89), "orders")
    return B.merge((rel(spark, sf, _XA, "customer"), e), (rel(spark, sf, _XB, "supplier"), e))[0].select("id", "label")


@query("build_merge", f"WITH u AS (SELECT source, target FROM ({_XE.format(k=89)}) UNION ALL SELECT source, target FROM ({_XE.format(k=97)})) SELECT source, target, count(*) AS n FROM u GROUP BY ALL")
def _(spark, sf):
    n = rel(spark, sf, _XA, "customer")
    return B.merge((n, rel(spark, sf, _XE.format(k=89), "orders")), (n, rel(spark, sf, _XE.format(k=97), "orders")))[1].groupBy("source", "target").agg(F.count("*").alias("n"))


@query(
    "graph_upsert",
    f"""WITH {V.duck_raw(V.OLD, "o")}, {V.duck_raw(V.NEW, "n")}, re AS (SELECT * FROM ore UNION ALL SELECT * REPLACE (ord + 4000000000000000000 AS ord) FROM nre)
    SELECT CASE WHEN source LIKE 'c%' THEN source ELSE target END AS u, CASE WHEN source LIKE 'c%' THEN target ELSE source END AS v, arg_max(source, ord) AS src, arg_max(relation, ord) AS relation, arg_max(confidence_score, ord) FILTER (confidence_score IS NOT NULL) AS confidence_score, arg_max(weight, ord) AS weight FROM re GROUP BY ALL""",
)
def _(spark, sf):
    n = V.raw_nodes(spark, sf)
    return B.upsert((n, V.raw_edges(spark, sf, V.OLD)), (n, V.raw_edges(spark, sf, V.NEW))).edges.select("u", "v", "src", "relation", "confidence_score", "weight")


@query(
    "group_by_source_file",
    f"""WITH {V.KN}, {V.duck_raw()}, n AS (SELECT source_file, count(*) AS c, list_sort(list(id)) AS l FROM kn WHERE source_file <> '' GROUP BY 1), e AS (SELECT source_file, count(*) AS c, list_sort(list(source || '->' || target)) AS l FROM re WHERE source_file <> '' GROUP BY 1)
    SELECT source_file, coalesce(n.c, 0) AS n_nodes, coalesce(e.c, 0) AS n_edges, coalesce(n.l, []) AS nodes, coalesce(e.l, []) AS edges FROM n FULL JOIN e USING (source_file)""",
)
def _(spark, sf):
    return B.by_source_file(V.raw_nodes(spark, sf), V.raw_edges(spark, sf))


_COST = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(0 AS BIGINT) AS ord, count(*) AS input_tokens, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS output_tokens FROM orders GROUP BY 1"


@query("running_cost", f"SELECT *, CAST(sum(input_tokens) OVER w AS BIGINT) AS total_input, CAST(sum(output_tokens) OVER w AS BIGINT) AS total_output FROM ({_COST.replace('CAST(o_totalprice AS BIGINT)', 'CAST(floor(o_totalprice) AS BIGINT)')}) WINDOW w AS (ORDER BY date, ord)")
def _(spark, sf):
    return B.running_cost(rel(spark, sf, _COST, "orders"))


_ENT = "SELECT concat('p', p_partkey) AS id, concat('f', CAST(floor(p_partkey / 5) AS BIGINT)) AS file, concat('f', CAST(floor(p_partkey / 5) AS BIGINT)) AS stem, CASE p_partkey % 11 WHEN 0 THEN concat('m', p_partkey, '.py') WHEN 1 THEN '_x' WHEN 2 THEN 'run()' ELSE replace(p_name, ' ', '') END AS label, CAST(p_partkey AS BIGINT) AS ord FROM part"
_IMP = "SELECT DISTINCT concat('f', l_suppkey) AS file, concat('f', CAST(floor(l_partkey / 5) AS BIGINT)) AS target_stem, replace(p_name, ' ', '') AS name FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    "resolve_imports",
    f"""WITH r AS (SELECT * FROM ({_ENT}) WHERE label NOT LIKE '%)' AND label NOT LIKE '%.py' AND label NOT LIKE '\\_%' ESCAPE '\\'), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stem, label ORDER BY ord DESC) = 1)
    SELECT DISTINCT r.id AS source, l.id AS target, 'uses' AS relation, 'INFERRED' AS confidence, CAST(0.8 AS DOUBLE) AS weight FROM ({_IMP}) i JOIN l ON i.target_stem = l.stem AND i.name = l.label JOIN r ON r.file = i.file WHERE r.id <> l.id""",
)
def _(spark, sf):
    return B.resolve_imports(rel(spark, sf, _IMP, "lineitem", "part"), rel(spark, sf, _ENT, "part"))


_SITES = "SELECT concat('p', l_partkey) AS caller, CASE l_linenumber % 3 WHEN 0 THEN upper(concat('fn', l_suppkey)) ELSE concat('fn', l_suppkey) END AS callee, l_orderkey * 8 + l_linenumber AS ord FROM lineitem"
_FUNCS = "SELECT concat('p', p_partkey) AS id, CASE p_partkey % 2 WHEN 0 THEN concat('.fn', p_partkey % 150, '()') ELSE concat('Fn', p_partkey % 150, '()') END AS label, CAST(p_partkey AS BIGINT) AS ord FROM part"


@query(
    "call_resolution",
    f"""WITH l AS (SELECT id, lower(ltrim(rtrim(label, '()'), '.')) AS name FROM ({_FUNCS}) QUALIFY row_number() OVER (PARTITION BY lower(ltrim(rtrim(label, '()'), '.')) ORDER BY ord DESC) = 1)
    SELECT caller AS source, id AS target, 'calls' AS relation, 'INFERRED' AS confidence, CAST(0.8 AS DOUBLE) AS weight, min(ord) AS ord FROM ({_SITES}) s JOIN l ON lower(callee) = name WHERE caller <> id GROUP BY ALL""",
)
def _(spark, sf):
    return B.resolve_calls(rel(spark, sf, _SITES, "lineitem"), rel(spark, sf, _FUNCS, "part"))


# --- validation and building
_BADN = "SELECT CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('c', c_custkey) END AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS label, CASE WHEN c_custkey % 19 = 0 THEN 'movie' WHEN c_custkey % 23 = 0 THEN NULL ELSE 'code' END AS file_type, 'a.py' AS source_file, CAST(c_custkey AS BIGINT) AS ord FROM customer"
_BADE = "SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('c', o_custkey) END AS source, concat('c', o_orderkey % 2000) AS target, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'calls' END AS relation, CASE o_orderstatus WHEN 'P' THEN 'MAYBE' ELSE 'EXTRACTED' END AS confidence, 'a.py' AS source_file, CAST(o_orderkey AS BIGINT) AS ord FROM orders"


def _checks(keys, kind, item, enum, what, values):
    parts = [f"SELECT '{kind}' AS kind, {item} AS item, 'missing {k}' AS error FROM b WHERE {k} IS NULL" for k in keys]
    return " UNION ALL ".join([*parts, f"SELECT '{kind}', {item}, 'unknown {what} ' || {enum} FROM b WHERE {enum} NOT IN ({quoted(values)})"])


@query("validate_nodes", f"WITH b AS ({_BADN}) " + _checks(B.NODE_KEYS, "node", "coalesce(id, '?')", "file_type", "file_type", B.FILE_TYPES))
def _(spark, sf):
    return B.validate_nodes(rel(spark, sf, _BADN, "customer"))


@query("validate_edges", f"WITH b AS ({_BADE}) " + _checks(B.EDGE_KEYS, "edge", "coalesce(source, '?') || '->' || coalesce(target, '?')", "confidence", "confidence", B.CONFIDENCES))
def _(spark, sf):
    return B.validate_edges(rel(spark, sf, _BADE, "orders"))


@query("dangling_edges", f"WITH n AS (SELECT DISTINCT id FROM ({_BADN}) WHERE id IS NOT NULL), e AS ({_BADE}) SELECT DISTINCT source, target, 'source' AS missing FROM e WHERE source IS NOT NULL AND source NOT IN (FROM n) UNION SELECT source, target, 'target' FROM e WHERE target IS NOT NULL AND target NOT IN (FROM n)")
def _(spark, sf):
    return B.dangling_edges(rel(spark, sf, _BADN, "customer"), rel(spark, sf, _BADE, "orders"))


_DUPN = "SELECT concat('n', o_custkey) AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS file_type, CAST(NULL AS {string}) AS source_file, CAST(o_orderkey AS BIGINT) AS ord FROM orders"


@query("build_nodes", f"SELECT id, arg_max(label, ord) FILTER (label IS NOT NULL) AS label, arg_max(file_type, ord) FILTER (file_type IS NOT NULL) AS file_type, min(ord) AS ord FROM ({_DUPN.format(string='VARCHAR')}) GROUP BY id")
def _(spark, sf):
    return B.build_nodes(rel(spark, sf, _DUPN.format(string="STRING"), "orders")).select("id", "label", "file_type", "ord")


_KE = "u, v, src, tgt, relation, confidence, confidence_score, weight, source_file"


@query("build_edges", duck(f"SELECT {_KE} FROM ke", facts=False))
def _(spark, sf):
    return V.graph(spark, sf).edges.select(*_KE.split(", "))


@query(
    "build_edges_lenient",
    f"WITH b AS ({_BADE}) SELECT least(source, target) AS u, greatest(source, target) AS v, arg_max(source, ord) AS src, arg_max(relation, ord) FILTER (relation IS NOT NULL) AS relation, arg_max(confidence, ord) AS confidence FROM b WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return B.build_edges_lenient(rel(spark, sf, _BADE, "orders")).select("u", "v", "src", "relation", "confidence")


_HYP = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('h', o_orderkey % {k}) END AS id, o_orderpriority AS label, CAST(o_orderkey AS BIGINT) AS ord FROM orders"


@query("hyperedge_dedup", f"WITH u AS (SELECT *, 0 AS r FROM ({_HYP.format(k=300)}) UNION ALL SELECT *, 1 FROM ({_HYP.format(k=500)})) SELECT id, label FROM u WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, ord) = 1")
def _(spark, sf):
    return B.attach_hyperedges(rel(spark, sf, _HYP.format(k=300), "orders"), rel(spark, sf, _HYP.format(k=500), "orders")).select("id", "label")


@query("confidence_score_default", duck("SELECT u, v, coalesce(confidence_score, CASE confidence WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END) AS score FROM ke", facts=False))
def _(spark, sf):
    return V.graph(spark, sf).edges.select("u", "v", score_default(F.col("confidence"), F.col("confidence_score")).alias("score"))


@query("communities_from_nodes", f"WITH {V.KN} SELECT community, list_sort(list(id)) AS members FROM kn WHERE community IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return V.raw_nodes(spark, sf).where("community is not null").groupBy("community").agg(F.sort_array(F.collect_list("id")).alias("members"))


# --- analysis
@query("node_degree", duck("SELECT id, degree FROM kd"))
def _(spark, sf):
    return B.degrees(V.graph(spark, sf))


@query("file_node_flags", duck("SELECT id, is_file FROM nf"))
def _(spark, sf):
    return A.node_facts(V.built(spark, sf)).select("id", "is_file")


@query("concept_node_flags", duck("SELECT id, is_concept FROM nf"))
def _(spark, sf):
    return V.raw_nodes(spark, sf).select("id", A.is_concept_node(F.col("source_file")).alias("is_concept"))


_GOD = "SELECT CAST(row_number() OVER (ORDER BY degree DESC, ord) AS INT) AS rank, id, label, degree FROM nf WHERE NOT is_file AND NOT is_concept QUALIFY rank <= {n}"


@query("god_nodes", duck(_GOD.format(n=10)))
def god_nodes(spark, sf):
    return A.god_nodes(V.built(spark, sf))


_UC, _VC = _CATS.format(p="u_source_file"), _CATS.format(p="v_source_file")
_SC = f"""sc AS (SELECT *, {_UC} AS cu, {_VC} AS cv, split_part(u_source_file, '/', 1) <> split_part(v_source_file, '/', 1) AS far, coalesce(u_community <> v_community, false) AS apart, coalesce(relation = 'semantically_similar_to', false) AS alike, least(u_degree, v_degree) <= 2 AND greatest(u_degree, v_degree) >= 5 AS hub FROM ef),
s1 AS (SELECT *, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN cu <> cv THEN 2 ELSE 0 END + CASE WHEN far THEN 2 ELSE 0 END + CASE WHEN apart THEN 1 ELSE 0 END AS base FROM sc),
s2 AS (SELECT *, CAST(CASE WHEN alike THEN floor(base * 1.5) ELSE base END + CASE WHEN hub THEN 1 ELSE 0 END AS BIGINT) AS score, array_to_string(list_filter([
  CASE WHEN confidence IN ('AMBIGUOUS', 'INFERRED') THEN lower(confidence) || ' connection, not stated outright in the source' END, CASE WHEN cu <> cv THEN 'joins file types ' || cu || ' and ' || cv END, CASE WHEN far THEN 'joins top-level folders' END, CASE WHEN apart THEN 'joins communities' END,
  CASE WHEN alike THEN 'alike in meaning without a structural link' END, CASE WHEN hub THEN 'peripheral `' || CASE WHEN u_degree <= 2 THEN u_label ELSE v_label END || '` reaches hub `' || CASE WHEN u_degree <= 2 THEN v_label ELSE u_label END || '`' END], lambda x: x IS NOT NULL), '; ') AS w FROM s1),
sx AS (SELECT * EXCLUDE (w), CASE WHEN w = '' THEN 'cross-file connection' ELSE w END AS why FROM s2 WHERE u_source_file <> '' AND v_source_file <> '' AND u_source_file <> v_source_file)"""
_OR = "CASE WHEN src = u THEN u_label ELSE v_label END AS source, CASE WHEN src = u THEN v_label ELSE u_label END AS target, CASE WHEN src = u THEN u_source_file ELSE v_source_file END AS source_file, CASE WHEN src = u THEN v_source_file ELSE u_source_file END AS target_file, confidence, relation"
_REAL = "relation NOT IN ('imports','imports_from','contains','method') AND NOT u_is_file AND NOT v_is_file"


@query("surprise_scores", duck("SELECT u, v, score, why FROM sx", more=_SC))
def _(spark, sf):
    return A.surprise_scores(V.built(spark, sf, "relation", "confidence"))


_CF = f"cf AS (SELECT {_OR}, score, why, CAST(row_number() OVER (ORDER BY score DESC, u_ord, ord) AS INT) AS rank FROM sx WHERE {_REAL} AND NOT u_is_concept AND NOT v_is_concept)"


@query("cross_file_surprises", duck("SELECT * FROM cf WHERE rank <= 5", more=f"{_SC}, {_CF}"))
def _(spark, sf):
    return A.cross_file_surprises(V.built(spark, sf, *V.SHOWN))


_SURE = "CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END"
_CC = f"""cc AS (SELECT *, {_SURE} AS sure FROM ef WHERE {_REAL} AND u_community <> v_community QUALIFY row_number() OVER (PARTITION BY least(u_community, v_community), greatest(u_community, v_community) ORDER BY {_SURE}, u_ord, ord) = 1),
co AS (SELECT {_OR}, 'joins community ' || u_community || ' to ' || v_community AS note, CAST(row_number() OVER (ORDER BY sure, u_ord, ord) AS INT) AS rank FROM cc)"""


@query("cross_community_surprises", duck("SELECT * FROM co WHERE rank <= 5", more=_CC))
def _(spark, sf):
    return A.cross_community_surprises(V.built(spark, sf, *V.SHOWN))


@query("surprising_connections", duck("SELECT rank, source, target, confidence, relation, why AS reason FROM cf WHERE rank <= 5", more=f"{_SC}, {_CF}"))
def _(spark, sf):
    return A.surprising_connections(V.built(spark, sf, *V.SHOWN))


@query("surprising_connections_one_file", duck("SELECT rank, source, target, confidence, relation, note AS reason FROM co WHERE rank <= 5", more=_CC))
def _(spark, sf):
    kg = V.built(spark, sf, *V.SHOWN)
    return A.surprising_connections(A.KG(kg.nodes.withColumn("source_file", F.lit("one.md")), kg.edges))


_COH = "ch AS (SELECT k.community, count(*) AS n_nodes, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round_even(coalesce(max(m), 0) / (count(*) * (count(*) - 1) / 2), 2) END AS cohesion FROM kn k LEFT JOIN (SELECT u_community AS community, count(*) AS m FROM ef WHERE u_community = v_community GROUP BY 1) i ON k.community = i.community GROUP BY 1)"


@query("cohesion_scores", duck("SELECT community, n_nodes, CAST(cohesion AS DOUBLE) AS cohesion FROM ch", more=_COH))
def _(spark, sf):
    return A.cohesion(V.graph(spark, sf))


@query("community_rank", f"WITH {V.KN}, s AS (SELECT community, count(*) AS size, min(ord) AS f FROM kn GROUP BY 1) SELECT community, size, CAST(row_number() OVER (ORDER BY size DESC, f) - 1 AS INT) AS cid FROM s")
def _(spark, sf):
    return A.community_rank(V.raw_nodes(spark, sf))


@query("community_reach", duck("SELECT k.id, count(DISTINCT CASE WHEN d.community <> k.community THEN d.community END) AS reach FROM kn k LEFT JOIN adj ON k.id = src LEFT JOIN kn d ON dst = d.id GROUP BY 1", facts=False, more=V.KADJ))
def _(spark, sf):
    return A.community_reach(V.built(spark, sf))


_PCT = "CAST(round_even(100.0 * count(*) FILTER (confidence = '{c}') / greatest(count(*), 1), 0) AS BIGINT)"


@query("graph_stats", duck(f"SELECT (SELECT count(*) FROM kn) AS nodes, (SELECT count(DISTINCT community) FROM kn) AS communities, count(*) AS edges, {_PCT.format(c='EXTRACTED')} AS extracted_pct, {_PCT.format(c='INFERRED')} AS inferred_pct, {_PCT.format(c='AMBIGUOUS')} AS ambiguous_pct FROM ke", facts=False))
def _(spark, sf):
    return A.graph_stats(V.built(spark, sf, "confidence"))


@query("avg_inferred_confidence", duck("SELECT round_even(avg(coalesce(confidence_score, 0.5)), 2) AS avg_inferred, count(*) AS n_inferred FROM ke WHERE confidence = 'INFERRED'", facts=False))
def _(spark, sf):
    return A.inferred_confidence(V.graph(spark, sf))


@query("ambiguous_edges", duck(f"SELECT source, target, relation, source_file, target_file FROM (SELECT {_OR} FROM ef WHERE confidence = 'AMBIGUOUS')"))
def _(spark, sf):
    return A.ambiguous_edges(V.built(spark, sf, "src", "relation", "confidence"))


@query("isolated_nodes", duck("SELECT id, label, degree FROM nf WHERE degree <= 1 AND NOT is_file AND NOT is_concept"))
def _(spark, sf):
    return A.isolated_nodes(V.built(spark, sf)).select("id", "label", "degree")


_THIN = "SELECT concat('c', c_custkey) AS id, c_name AS label, CAST(c_custkey % 701 AS INT) AS community, CAST(c_custkey AS BIGINT) AS ord FROM customer"


@query("thin_communities", f"SELECT community, count(*) AS n_nodes, list_sort(list(id)) AS members FROM ({_THIN}) GROUP BY 1 HAVING count(*) < 3")
def _(spark, sf):
    return A.thin_communities(A.KG(rel(spark, sf, _THIN, "customer"), None))


@query("community_summary", duck("SELECT community, count(*) AS n_real, string_agg(label, ', ' ORDER BY ord) FILTER (k <= 8) AS shown, CAST(greatest(count(*) - 8, 0) AS BIGINT) AS more FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY ord) AS k FROM nf WHERE NOT is_file) GROUP BY 1"))
def _(spark, sf):
    return A.community_summary(V.built(spark, sf))


@query("q_ambiguous", duck("SELECT 'ambiguous_edge' AS type, 'What exactly relates `' || u_label || '` and `' || v_label || '`?' AS question, 'The edge is AMBIGUOUS (relation: ' || relation || ').' AS why FROM ef WHERE confidence = 'AMBIGUOUS'"))
def _(spark, sf):
    return A.q_ambiguous(V.built(spark, sf, "relation", "confidence", "u_ord", "ord")).select("type", "question", "why")


@query(
    "q_verify_inferred",
    duck(
        """SELECT 'verify_inferred' AS type, 'Are the ' || count(*) || ' inferred relations of `' || any_value(name) || '` (such as those with `' || list(o.label ORDER BY adj.ord)[1] || '` and `' || list(o.label ORDER BY adj.ord)[2] || '`) right?' AS question, '`' || any_value(name) || '` has ' || count(*) || ' INFERRED edges.' AS why, rank
        FROM t JOIN adj ON t.id = src AND confidence = 'INFERRED' JOIN kn o ON o.id = dst GROUP BY t.id, rank HAVING count(*) >= 2""",
        more=f"t AS (SELECT id, label AS name, CAST(row_number() OVER (ORDER BY degree DESC, ord) AS INT) AS rank FROM nf WHERE NOT is_file QUALIFY rank <= 5), {V.KADJ}",
    ),
)
def _(spark, sf):
    return A.q_verify_inferred(V.built(spark, sf, "confidence", "ord"))


@query("q_isolated", duck("SELECT 'isolated_nodes' AS type, 'What connects ' || array_to_string(list('`' || label || '`' ORDER BY ord)[:3], ', ') || ' to the rest?' AS question, count(*) || ' nodes have one edge or none.' AS why FROM nf WHERE degree <= 1 AND NOT is_file AND NOT is_concept HAVING count(*) > 0"))
def _(spark, sf):
    return A.q_isolated(V.built(spark, sf))


@query("q_low_cohesion", duck("SELECT 'low_cohesion' AS type, 'Should community ' || community || ' be split?' AS question, 'Its cohesion is ' || printf('%.2f', cohesion) AS why, community FROM ch WHERE cohesion < 0.15 AND n_nodes >= 5", more=_COH))
def _(spark, sf):
    return A.q_low_cohesion(V.graph(spark, sf))


def _built_key(where: str, p: str) -> str:
    return f"{V.duck_built(where, p)}, {p}k AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b, relation FROM {p}ke), {p}n AS (SELECT DISTINCT u AS id FROM {p}ke UNION SELECT v FROM {p}ke)"


_DIFF = f"WITH {_built_key(V.OLD, 'o')}, {_built_key(V.NEW, 'n')}"


def _two(spark, sf):
    """Raw nodes that an edge leads to, and raw edges, of both states."""
    for w in (V.OLD, V.NEW):
        e = V.raw_edges(spark, sf, w)
        ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        yield V.raw_nodes(spark, sf).join(ends, "id", "left_semi"), e


@query("graph_diff_nodes", f"{_DIFF} SELECT 'added' AS change, id FROM (FROM nn EXCEPT FROM ok_n) UNION ALL SELECT 'removed', id FROM (FROM ok_n EXCEPT FROM nn)".replace("ok_n", "\"on\"").replace(", on AS", ', "on" AS'))
def _(spark, sf):
    return A.graph_diff_nodes(*[A.KG(B.build_nodes(n), None) for n, _ in _two(spark, sf)])


@query("graph_diff_edges", f"{_DIFF} SELECT 'added' AS change, * FROM (FROM nk EXCEPT FROM ok) UNION ALL SELECT 'removed', * FROM (FROM ok EXCEPT FROM nk)".replace(", on AS", ', "on" AS'))
def _(spark, sf):
    n = V.raw_nodes(spark, sf)  # those without edges change nothing
    return A.graph_diff_edges(*[B.build_graph(n, e) for _, e in _two(spark, sf)])


# --- traversal
_TERMS = ["customer#00000001", "mod", "asia", "asia"]
_SCORE = " + ".join(f"CASE WHEN contains(lower(label), '{t}') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(source_file), '{t}') THEN 0.5 ELSE 0 END" for t in _TERMS)


@query("score_nodes", f"WITH {V.KN} SELECT id, CAST({_SCORE} AS DOUBLE) AS score FROM kn WHERE {_SCORE} > 0")
def _(spark, sf):
    return traverse.score_nodes(V.raw_nodes(spark, sf), _TERMS)


@query("best_nodes", f"WITH {V.KN} SELECT CAST(row_number() OVER (ORDER BY CAST({_SCORE} AS DOUBLE) DESC, id DESC) AS INT) AS rank, id, CAST({_SCORE} AS DOUBLE) AS score FROM kn WHERE {_SCORE} > 0 QUALIFY rank <= 3")
def _(spark, sf):
    return traverse.best_nodes(V.raw_nodes(spark, sf), _TERMS, 3)


_BFS = "ad AS (SELECT u AS src, v AS dst FROM ke UNION ALL SELECT v, u FROM ke), w AS (SELECT 's1' AS id, 0 AS dist UNION SELECT dst, dist + 1 FROM w JOIN ad ON w.id = src WHERE dist < {d}), bd AS (SELECT id, min(dist) AS dist FROM w GROUP BY 1)"


def _start(spark, node="s1"):
    return spark.createDataFrame([(node,)], "id string")


@query("bfs_nodes", duck("SELECT id, CAST(dist AS INT) AS dist FROM bd", facts=False, more=_BFS.format(d=6)))
def _(spark, sf):
    return traverse.bfs(V.built(spark, sf), _start(spark), 6)


@query("bfs_edges", duck("SELECT src, dst, CAST(b.dist AS INT) AS dist FROM ad JOIN bd a ON a.id = src JOIN bd b ON b.id = dst WHERE b.dist = a.dist + 1 AND a.dist < 4", facts=False, more=_BFS.format(d=4)))
def _(spark, sf):
    kg = V.built(spark, sf)
    return traverse.bfs_edges(kg, traverse.bfs(kg, _start(spark), 4), 4)


@query("dfs_nodes")
def _(spark, sf):
    return traverse.dfs(V.built(spark, sf, "ord"), _start(spark), 4)


@query("shortest_path_hops", duck("SELECT id, CAST(dist AS INT) AS hops FROM bd", facts=False, more=_BFS.format(d=8)))
def _(spark, sf):
    return traverse.shortest_paths(V.built(spark, sf), "s1", 8).select("id", "hops")


_LBL = _CLEAN.format(x="label")


@query(
    "subgraph_lines",
    duck(
        f"""SELECT line FROM (SELECT 'NODE ' || {_LBL} || ' [src=' || source_file || ' community=' || community || ']' AS line FROM nf JOIN bd USING (id)
        UNION ALL SELECT 'EDGE ' || {_CLEAN.format(x="CASE WHEN src = u THEN u_label ELSE v_label END")} || ' --' || relation || ' [' || confidence || ']--> ' || {_CLEAN.format(x="CASE WHEN src = u THEN v_label ELSE u_label END")} FROM ef WHERE u IN (SELECT id FROM bd) AND v IN (SELECT id FROM bd))""",
        more=_BFS.format(d=2),
    ),
)
def _(spark, sf):
    kg = V.built(spark, sf, *V.SHOWN, "tgt")
    return traverse.subgraph_lines(kg, traverse.bfs(kg, _start(spark), 2)).select("line")


_CHARS = f"(SELECT length('NODE ' || {_LBL} || ' [src=' || source_file || ' community=' || community || ']') AS n FROM nf JOIN bd USING (id) UNION ALL SELECT length('EDGE ' || {_CLEAN.format(x='u_label')} || ' --' || relation || ' [' || confidence || ']--> ' || {_CLEAN.format(x='v_label')}) FROM ef WHERE u IN (SELECT id FROM bd) AND v IN (SELECT id FROM bd))"
_QUESTION = "what about supplier#000000001"


def _bfs_of(question: str, depth: int, tag: str = "") -> str:
    terms = traverse.terms_of(question)
    score = " + ".join(f"CASE WHEN contains(lower(label), '{t}') THEN 1.0 ELSE 0 END" for t in terms)
    return f"st{tag} AS (SELECT id FROM kn WHERE {score} > 0 ORDER BY {score} DESC, id DESC LIMIT 3), ad{tag} AS (SELECT u AS src, v AS dst FROM ke UNION ALL SELECT v, u FROM ke), w{tag} AS (SELECT id, 0 AS dist FROM st{tag} UNION SELECT dst, dist + 1 FROM w{tag} JOIN ad{tag} ON w{tag}.id = src WHERE dist < {depth}), bd{tag} AS (SELECT id, min(dist) AS dist FROM w{tag} GROUP BY 1)"


@query("query_tokens", duck(f"SELECT count(*) AS n_lines, CASE WHEN count(*) = 0 THEN 0 ELSE CAST(greatest(1, (sum(n) + count(*) - 1) // 4) AS BIGINT) END AS tokens FROM {_CHARS}", more=_bfs_of(_QUESTION, 3)))
def _(spark, sf):
    return traverse.query_tokens(V.built(spark, sf, *V.SHOWN, "tgt"), _QUESTION, 3)


_QS = [_QUESTION, "customer#000000007 and mod10.py", "zzz nothing"]
_PER = " UNION ALL ".join(f"SELECT CASE WHEN count(*) = 0 THEN 0 ELSE greatest(1, (sum(n) + count(*) - 1) // 4) END AS t FROM {_CHARS.replace('bd', f'bd{i}')}" for i in range(len(_QS)))


@query(
    "token_reduction",
    duck(
        f"SELECT count(*) AS questions, any_value(c) AS corpus_tokens, CAST(floor(avg(t)) AS BIGINT) AS avg_query_tokens, round_even(any_value(c) / CAST(floor(avg(t)) AS BIGINT), 1) AS reduction FROM ({_PER}), (SELECT CAST(count(*) * 50 * 100 // 75 AS BIGINT) AS c FROM kn) WHERE t > 0",
        more=", ".join(_bfs_of(q, 2, str(i)) for i, q in enumerate(_QS)),
    ),
)
def _(spark, sf):
    return traverse.token_reduction(V.built(spark, sf, *V.SHOWN, "tgt"), _QS, depth=2)


_ONE = "f AS (SELECT id FROM kn WHERE contains(lower(label), 'supplier#00000000') OR lower(id) = 'supplier#00000000' ORDER BY ord LIMIT 1)"


@query("get_node", duck("SELECT id, label, source_file, file_type, community, degree FROM nf JOIN f USING (id)", more=_ONE))
def _(spark, sf):
    return traverse.get_node(V.built(spark, sf), "Supplier#00000000")


@query("get_neighbors", duck("SELECT src AS id, dst AS neighbour, k.label, relation, confidence FROM adj JOIN f ON src = f.id JOIN kn k ON k.id = dst WHERE contains(lower(relation), 'al')", facts=False, more=f"{V.KADJ}, {_ONE}"))
def _(spark, sf):
    return traverse.get_neighbors(V.graph(spark, sf), "Supplier#00000000", "AL")


@query("get_community", f"WITH {V.KN} SELECT id, label, source_file FROM kn WHERE community = 7")
def _(spark, sf):
    return traverse.get_community(A.KG(V.raw_nodes(spark, sf), None), 7)


@query("explain_node", duck("SELECT src AS id, dst AS neighbour, k.label, k.source_file, relation, confidence FROM adj JOIN f ON src = f.id JOIN kn k ON k.id = dst", facts=False, more=f"{V.KADJ}, f AS (SELECT id FROM kn WHERE contains(lower(label), 'supplier#000000003') OR contains(lower(source_file), 'supplier#000000003') ORDER BY CASE WHEN contains(lower(label), 'supplier#000000003') THEN 1 ELSE 0 END DESC, id DESC LIMIT 1)"))
def _(spark, sf):
    return traverse.explain_node(V.graph(spark, sf), "Supplier#000000003")


@query("node_betweenness")
def _(spark, sf):
    return traverse.betweenness(V.built(spark, sf))[0].select("id", F.round("betweenness", 6).alias("betweenness"))


@query("edge_betweenness")
def _(spark, sf):
    return traverse.betweenness(V.built(spark, sf))[1].select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.round("betweenness", 6).alias("betweenness"))


@query("q_bridges")
def _(spark, sf):
    kg = V.built(spark, sf)
    return A.q_bridges(kg, traverse.betweenness(kg)[0])


@query("suggest_questions")
def _(spark, sf):
    kg = V.built(spark, sf, "relation", "confidence", "u_ord", "ord")
    return A.suggest_questions(kg, traverse.betweenness(kg)[0])


# --- communities
@query("connected_components", duck("SELECT id, component FROM cc", facts=False, more="ad AS (SELECT u AS src, v AS dst FROM ke UNION ALL SELECT v, u FROM ke), cc(id, component) USING KEY (id) AS (SELECT id, id FROM kn UNION SELECT ad.src, min(f.component) FROM cc f JOIN ad ON ad.dst = f.id JOIN recurring.cc t ON t.id = ad.src WHERE f.component < t.component GROUP BY ad.src)"))
def _(spark, sf):
    from ..operators.community import connected_components

    kg = V.built(spark, sf)
    return connected_components(kg.nodes.select("id"), kg.edges)


@query("cluster")
def _(spark, sf):
    from ..operators.community import cluster

    return cluster(V.built(spark, sf, "weight"))


@query("cluster_covers_all_nodes", f"WITH {V.KN} SELECT id, CAST(1 AS BIGINT) AS n_communities FROM kn")
def _(spark, sf):
    from ..operators.community import cluster

    return cluster(V.built(spark, sf, "weight")).groupBy("id").agg(F.count("*").alias("n_communities"))


@query("modularity", duck("SELECT round(sum(coalesce(i, 0) / m - pow(vol / (2 * m), 2)), 6) AS modularity FROM (SELECT c, sum(w) AS vol FROM (SELECT u_community AS c, weight AS w FROM ef UNION ALL SELECT v_community, weight FROM ef) GROUP BY 1) LEFT JOIN (SELECT u_community AS c, sum(weight) AS i FROM ef WHERE u_community = v_community GROUP BY 1) USING (c), (SELECT sum(weight) AS m FROM ke)"))
def _(spark, sf):
    from ..operators.community import modularity

    return modularity(V.built(spark, sf, "weight"))


# --- exports
@query("cypher_nodes", f"WITH {V.KN} SELECT 'MERGE (n:' || upper(substring(file_type, 1, 1)) || substring(file_type, 2) || ' {{id: ''' || id || ''', label: ''' || label || '''}});' AS line FROM kn".replace("{{", "{").replace("}}", "}"))
def _(spark, sf):
    return X.cypher_nodes(A.KG(V.raw_nodes(spark, sf), None))


@query("cypher_edges", duck("SELECT 'MATCH (a {id: ''' || u || '''}), (b {id: ''' || v || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' AS line FROM ke", facts=False))
def _(spark, sf):
    return X.cypher_edges(V.graph(spark, sf))


@query("viz_node_attrs", duck(f"SELECT id, {_LBL} AS label, round_even(10 + 30 * degree / m, 1) AS size, CASE WHEN degree >= m * 0.15 THEN 12 ELSE 0 END AS font_size, list_extract([{quoted(X.COLORS)}], CAST(community % 10 + 1 AS INT)) AS color, degree, community FROM nf, (SELECT greatest(max(degree), 1) AS m FROM kd)"))
def _(spark, sf):
    return X.viz_nodes(V.built(spark, sf))


_NAMES = "SELECT concat('p', p_partkey) AS id, CASE WHEN p_partkey % 50 = 0 THEN '?*' ELSE concat(p_name, '/') END AS label, CAST(p_partkey AS BIGINT) AS ord FROM part"
_BASE = "trim(regexp_replace(label, '[\\\\/*?:\"<>|#^\\[\\]]', '', 'g'))"


@query("note_filenames", f"WITH b AS (SELECT id, ord, CASE WHEN {_BASE} = '' THEN 'unnamed' ELSE {_BASE} END AS base FROM ({_NAMES})), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS k FROM b) SELECT id, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS filename FROM k")
def _(spark, sf):
    return X.note_filenames(rel(spark, sf, _NAMES, "part"))


@query("dominant_confidence", duck("SELECT kn.id, coalesce(c, 'EXTRACTED') AS confidence FROM kn LEFT JOIN d USING (id)", facts=False, more=f"{V.KADJ}, d AS (SELECT src AS id, confidence AS c FROM (SELECT src, confidence, count(*) AS n, min(ord) AS o FROM adj GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, o) = 1)"))
def _(spark, sf):
    return X.dominant_confidence(V.graph(spark, sf))


_ICE = "ic AS (SELECT community, other, count(*) AS n_edges FROM (SELECT u_community AS community, v_community AS other FROM ef WHERE u_community <> v_community UNION ALL SELECT v_community, u_community FROM ef WHERE u_community <> v_community) GROUP BY 1, 2)"


@query("inter_community_edges", duck("SELECT * FROM ic", more=_ICE))
def _(spark, sf):
    return X.inter_community_edges(V.built(spark, sf))


@query("bridge_nodes", duck("SELECT community, CAST(row_number() OVER (PARTITION BY community ORDER BY reach DESC, degree DESC, ord) AS INT) AS rank, id, reach, degree FROM r WHERE reach > 0 QUALIFY rank <= 5", more=f"{V.KADJ}, r AS (SELECT k.id, any_value(k.community) AS community, any_value(k.ord) AS ord, any_value(k.degree) AS degree, count(DISTINCT CASE WHEN d.community <> k.community THEN d.community END) AS reach FROM nf k JOIN adj ON k.id = src JOIN kn d ON dst = d.id GROUP BY 1)"))
def _(spark, sf):
    return X.bridge_nodes(V.built(spark, sf))


@query(
    "canvas_layout",
    f"""WITH {V.KN}, s AS (SELECT community, count(*) AS n FROM kn GROUP BY 1), g AS (SELECT community, CAST(greatest(600, 220 * ceil(sqrt(n))) AS BIGINT) AS width, CAST(greatest(400, 100 * ceil(n / 3) + 120) AS BIGINT) AS height, row_number() OVER (ORDER BY community) - 1 AS i, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS cols FROM s),
    xs AS (SELECT i % cols AS c, max(width) AS m FROM g GROUP BY 1), ys AS (SELECT i // cols AS r, max(height) AS m FROM g GROUP BY 1)
    SELECT community, CAST((SELECT coalesce(sum(m), 0) FROM xs WHERE c < i % cols) + 80 * (i % cols) AS BIGINT) AS x, CAST((SELECT coalesce(sum(m), 0) FROM ys WHERE r < i // cols) + 80 * (i // cols) AS BIGINT) AS y, width, height FROM g""",
)
def _(spark, sf):
    return X.canvas_layout(A.KG(V.raw_nodes(spark, sf), None))


@query("canvas_top_edges", duck("SELECT CAST(row_number() OVER (ORDER BY weight DESC, u_ord, ord) AS INT) AS rank, u, v, relation || ' [' || confidence || ']' AS label, weight FROM ef QUALIFY rank <= 200"))
def _(spark, sf):
    return X.canvas_top_edges(V.built(spark, sf, "relation", "confidence", "weight", "u_ord", "ord"))


@query("wiki_cross_links", duck("SELECT community, CAST(row_number() OVER (PARTITION BY community ORDER BY n_edges DESC, other) AS INT) AS rank, other, n_edges AS n_links FROM ic QUALIFY rank <= 12", more=_ICE))
def _(spark, sf):
    return X.wiki_cross_links(V.built(spark, sf))


@query("wiki_top_nodes", duck("SELECT community, CAST(row_number() OVER (PARTITION BY community ORDER BY degree DESC, ord) AS INT) AS rank, id, label, degree FROM nf QUALIFY rank <= 25"))
def _(spark, sf):
    return X.wiki_top_nodes(V.built(spark, sf))


@query("wiki_audit", duck("SELECT community, confidence, count(*) AS n, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY community), 0) AS BIGINT) AS pct FROM adj JOIN kn ON src = kn.id GROUP BY 1, 2", facts=False, more=V.KADJ))
def _(spark, sf):
    return X.wiki_audit(V.graph(spark, sf))


@query("note_rows")
def _(spark, sf):
    kg = V.built(spark, sf, "relation", "confidence", "ord")
    return X.note_rows(kg).union(X.community_notes(kg))


@query("wiki_rows")
def _(spark, sf):
    return X.wiki_rows(V.built(spark, sf, "relation", "confidence"))


_J = "'\"{k}\":' || coalesce(to_json({c})::VARCHAR, 'null')"
_NUM = "'\"{k}\":' || coalesce(CAST({c} AS VARCHAR), 'null')"


def _object(*fields: tuple[str, str, bool]) -> str:
    return "'{' || " + " || ',' || ".join((_NUM if number else _J).format(k=k, c=c) for k, c, number in fields) + " || '}'"


_NODE_JSON = _object(("id", "id", False), ("label", "label", False), ("file_type", "file_type", False), ("source_file", "source_file", False), ("community", "community", True))
_SCORED = "coalesce(confidence_score, CASE confidence WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END)"
_LINK_JSON = _object(("source", "u", False), ("target", "v", False), ("_src", "src", False), ("_tgt", "tgt", False), ("relation", "relation", False), ("confidence", "confidence", False), ("confidence_score", f"CAST({_SCORED} AS DOUBLE)", True), ("weight", "weight", True), ("source_file", "source_file", False))


@query("node_links", duck(f"SELECT 'nodes' AS part, {_NODE_JSON} AS json FROM kn UNION ALL SELECT 'links', {_LINK_JSON} FROM ke", facts=False))
def _(spark, sf):
    kg = V.graph(spark, sf)
    return X.node_json(kg).select(F.lit("nodes").alias("part"), "json").union(X.link_json(kg).select(F.lit("links"), "json"))


_XML = lambda x: _CLEAN.format(x=x).replace("1, 256)", "1, 100000)")


@query("graphml_rows", duck(f"SELECT '<node id=\"' || {_XML('id')} || '\"><data key=\"label\">' || {_XML('label')} || '</data><data key=\"community\">' || coalesce(community, -1) || '</data></node>' AS line FROM kn UNION ALL SELECT '<edge source=\"' || {_XML('u')} || '\" target=\"' || {_XML('v')} || '\"><data key=\"relation\">' || {_XML('relation')} || '</data></edge>' FROM ke", facts=False))
def _(spark, sf):
    return X.graphml_rows(V.graph(spark, sf)).select("line")


# --- events
@query("event_filter", f"SELECT doc_id, path FROM ({FILES}) WHERE {_EXT} IN ({quoted(watch.WATCHED)}) AND NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '(^|/)kgloom-out(/|$)')")
def _(spark, sf):
    return files(spark, sf).where(watch.counts(F.col("path"))).select("doc_id", "path")


_SESS = "f AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM f)"


@query("debounce_sessions", f"WITH {_SESS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2")
def _(spark, sf):
    return watch.sessions(table(spark, sf, "events").select("user_id", "ts"), 180, "user_id")


@query("session_route", f"WITH {_SESS} SELECT user_id, min(ts) AS start, count(*) AS n_events, CASE WHEN bool_and(event_type IN ('click', 'view')) THEN 'rebuild' ELSE 'flag_update' END AS action FROM s GROUP BY user_id, session")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.concat("event_type", F.when(F.col("event_type").isin("click", "view"), ".py").otherwise(".md")).alias("path"))
    return watch.route(watch.bursts(e, "3 minutes", "user_id")).select("user_id", "start", "n_events", "action")


# --- line-ordered work
@query("carry_forward", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_error FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("last_error"))
    return toc.carry_forward(e, "last_error", ["event_id"], ["user_id"])


@query("run_groups", "WITH l AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l) SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, sf):
    e = toc.run_groups(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_type", ["event_id"], ["user_id"])
    return e.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("dedup_first", "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(spark, sf):
    return toc.dedup_first(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("range_lookup", "WITH w AS (SELECT doc_id AS key, doc_id AS page, substring(text, 1, 12) AS needle FROM documents) SELECT key, min(doc_id) AS page FROM w JOIN documents ON doc_id >= page - 50 AND doc_id < page AND contains(text, needle) GROUP BY key")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return toc.range_lookup(d.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("page"), F.substring("text", 1, 12).alias("needle")), d.select(F.col("doc_id").alias("page"), "text"), 50, 0)


@query("offset_join", "SELECT p_partkey AS page, p_name AS name, doc_id AS physical, lang FROM part JOIN documents ON p_partkey + 12 = doc_id")
def _(spark, sf):
    return toc.offset_join(table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("name")), table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "lang")).select("page", "name", "physical", "lang")


_IMG = "SELECT p_partkey % 200 AS page, concat('img', p_partkey) AS name, CAST(p_retailprice * 20 AS BIGINT) AS size FROM part"


@query("largest_per_group", f"WITH i AS (SELECT unnest([page, page - 1]) AS page, name, size FROM ({_IMG.replace('CAST(p_retailprice * 20 AS BIGINT)', 'CAST(floor(p_retailprice * 20) AS BIGINT)')}) WHERE size > 19000) SELECT page, name, size FROM i QUALIFY row_number() OVER (PARTITION BY page ORDER BY size DESC, name DESC) = 1")
def _(spark, sf):
    return toc.largest_per_page(rel(spark, sf, _IMG, "part"), above=19_000)


@query("group_assets", "WITH g AS (SELECT CAST(regexp_extract(url, '([0-9]+)', 1) AS BIGINT) AS page, list_sort(list(url)) AS assets FROM pages WHERE regexp_extract(url, '([0-9]+)', 1) <> '' GROUP BY 1) SELECT p_partkey AS page, p_name AS title, coalesce(assets, []) AS assets FROM part LEFT JOIN g ON p_partkey = page")
def _(spark, sf):
    return toc.group_assets(table(spark, sf, "pages").select(F.col("url").alias("name")), table(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("title")))


@query("unused_assets", "SELECT c_name AS name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def _(spark, sf):
    c = table(spark, sf, "customer")
    used = c.join(table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.upper("c_name").alias("name"))
    return toc.unused_assets(c.select(F.col("c_name").alias("name")), used)


@query("rename", "SELECT p_partkey, replace(p_name, 'red', 'crimson') AS p_name FROM part")
def _(spark, sf):
    return toc.rename(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "red", "crimson")


@query("nested_counts", "SELECT count(DISTINCT p_brand) AS n_outer, count(DISTINCT (p_brand, p_type)) AS n_middle, count(DISTINCT (p_brand, p_type, p_name)) AS n_inner FROM part")
def _(spark, sf):
    return toc.nested_counts(table(spark, sf, "part"), "p_brand", "p_type", "p_name")


__all__ = ["ORACLES", "QUERIES", "Window", "god_nodes"]
