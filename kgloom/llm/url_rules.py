"""URL filter by association rules.

Spark's FP-growth mines frequent combinations of URL tokens and of the verdict of labelled URLs. Rules "tokens => bad" are
pruned by support and confidence, and where a part of their tokens does as well. An inverted index posts each rule under
its rarest token; a URL meets the rules of its own tokens and checks the rest of their tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_SUPPORT = 0.002  # share of the labelled URLs that hold the tokens and are bad
MIN_PAGES = 8  # and at least so many pages
MIN_CONFIDENCE = 0.5
BAD = "!bad"
SMALL_INDEX = 50_000  # an index of more rules is joined by shuffle instead of broadcast


def url_tokens(url: F.Column) -> F.Column:
    """Distinct tokens of a URL: words of the subdomain, registered domain and its words, path words, file type, query parameters, fragment.

    Numbers are dropped. A null URL has no tokens.
    """
    u = F.lower(url)
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query, fragment = F.regexp_extract(u, r"\?([^#]*)", 1), F.regexp_extract(u, r"#(.*)$", 1)

    def words(text: F.Column, cut: str, tag: str) -> F.Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit(tag), x))

    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    kind = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    parts = [words(F.regexp_replace(host, r"[^.]+\.[^.]+$", ""), r"[.\-]", "h:"), words(F.regexp_extract(host, r"([^.]+)\.[^.]+$", 1), "-", "n:"), F.filter(F.array(F.concat(F.lit("d:"), domain)), lambda x: x != "d:"), words(F.regexp_replace(path, r"\.[a-z0-9]+$", ""), r"[^\p{L}\p{N}]+", "p:"), F.filter(F.array(F.concat(F.lit("x:"), kind)), lambda x: x != "x:"), words(query, "&", "q:"), words(fragment, r"[^\p{L}\p{N}]+", "f:")]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(rule array<string>, confidence, support) from (tokens array<string>, bad boolean); none from an empty table.

    Repeated rows count each; rows without tokens or verdict count for nothing; other columns don't matter.

    A rule needs `min_support` of all labelled rows, and `min_pages` of them at least, to hold its tokens and be bad.

    A rule is dropped where a proper part of its tokens is a rule of at least the same confidence.
    """
    items = labelled.where("bad is not null").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    items = items.where(F.size("items") > 0)
    schema = "rule array<string>, confidence double, support double"
    items = C.cut(items)
    if not (n := items.count()):
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, (min_pages - 0.5) / n)), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = C.cut(rules.select(F.sort_array("antecedent").alias("rule"), "confidence", "support"))
    # Parts are looked up token by token: a rule's own tokens, then rules that are contained in it.
    few = rules.select(F.col("rule").alias("part"), F.col("confidence").alias("c"), F.col("rule")[0].alias("t"))
    more = rules.select("*", F.explode("rule").alias("t"))
    worse = more.join(few, "t").where((F.size("part") < F.size("rule")) & (F.size(F.array_except("part", "rule")) == 0) & (F.col("c") >= F.col("confidence")))
    return rules.join(worse.select("rule").distinct(), "rule", "left_anti").select("rule", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, confidence, rules) of the urls (id, tokens) that any rule matches: the best confidence and all rules' tokens, joined by blanks.

    Rows that share an id count as one; a null id is an id of its own; rows without tokens match nothing; other columns don't matter; without rules there are no rows.
    """
    tokens = rules.select("rule", "confidence", F.explode("rule").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("rule").orderBy("n", "t"))
    index = C.cut(tokens.join(often, "t").withColumn("k", rarest).where("k = 1").select("t", "rule", "confidence"))
    if index.count() <= SMALL_INDEX:
        index = F.broadcast(index)
    met = urls.select("id", "tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.size(F.array_except("rule", "tokens")) == 0)
    return met.groupBy("id").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set(F.concat_ws(" ", "rule"))).alias("rules"))


def filter_urls(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, blocked, confidence, rules) of every row of pages.

    A label belongs to the pages whose path names its document (/<language>/<doc_id>); low quality or toxicity makes a page bad. Pages without a label,
    or with a null one, teach nothing but are filtered like all others. A null or unparsable URL matches no rule. Unmatched pages have
    confidence null and no rules. Rows with a null page_id are not blocked; rows that share a page_id are decided together: a rule matched by
    one blocks all. Other columns don't matter; empty tables give no rows and no rules.
    """
    src = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"))
    rows = src.withColumn("tokens", url_tokens(F.col("url"))).withColumn("doc", F.expr("try_cast(nullif(regexp_extract(url, '://[^/]*/[^/]+/([0-9]+)', 1), '') as bigint)"))
    y = labels.select(F.col("doc_id").cast("long").alias("doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("doc is not null and bad is not null").groupBy("doc").agg(F.max("bad").alias("bad"))
    rules = mine(rows.join(y, "doc").select("tokens", "bad"), min_support, min_confidence, min_pages)
    hits = match(rows.where("id is not null").select("id", "tokens"), rules)
    out = src.join(hits, "id", "left")
    return out.select(F.col("id").alias("page_id"), "url", F.col("confidence").isNotNull().alias("blocked"), "confidence", F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))
