"""Line-ordered work on printed lists: carry-forward, runs, first rows, nearby pages, grouping by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import number


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, numbered from 0 in file order."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_block_start").alias("_block"))
    return number(lines, [F.asc("_block"), F.asc("_at")], "line_no").select(F.col("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, family, name, scientific_name, page) of lines `<name>과` or `<name> <Latin name> ... <page>`."""
    t = F.trim("line")
    family = F.nullif(F.regexp_extract(t, r"^([가-힣]+과)$", 1), F.lit(""))
    entry = r"^([가-힣]+)\s*([A-Z][A-Za-z.×\s\-]*?[a-z]\.?)[\s.·…]*([0-9]+)$"
    pick = lambda i: F.nullif(F.trim(F.regexp_extract(t, entry, i)), F.lit(""))
    return lines.select("line_no", family.alias("family"), pick(1).alias("name"), pick(2).alias("scientific_name"), pick(3).cast("int").alias("page"))


def carry_forward(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with null values replaced by the last one before, in order, within the groups of `by`."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def run_groups(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with `run`: the number of the stretch of equal successive values that a row is in, from 1."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def range_lookup(wanted: DataFrame, pages: DataFrame, before: int, after: int) -> DataFrame:
    """(key, page): for each wanted (key, page, needle) the first page of [page - before, page + after) whose text holds the needle.

    Pages are joined by blocks as wide as the range, so the join stays an equi-join.
    """
    width = before + after
    lo = F.col("page") - before
    w = wanted.select("key", "needle", lo.alias("lo"), (F.col("page") + after).alias("hi"), F.explode(F.array(F.floor(lo / width), F.floor(lo / width) + 1)).alias("block"))
    p = pages.select(F.col("page").alias("at"), "text", F.floor(F.col("page") / width).alias("block"))
    hit = w.join(p, "block").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")) & F.contains("text", "needle"))
    return hit.groupBy("key").agg(F.min("at").alias("page"))


def offset_join(rows: DataFrame, pages: DataFrame, offset: int = 12) -> DataFrame:
    """rows with the physical page that lies `offset` after their logical `page`."""
    return rows.join(pages.withColumnRenamed("page", "physical"), F.col("page") + offset == F.col("physical"))


def largest_per_page(images: DataFrame, spread: int = 2, above: int = 15_000) -> DataFrame:
    """(page, name, size): the largest image above a size on each page or one of the spread - 1 pages after it."""
    i = images.where(F.col("size") > above).select("name", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda k: F.col("page") - k)).alias("page"))
    best = i.groupBy("page").agg(F.max(F.struct("size", "name")).alias("b"))
    return best.select("page", "b.name", "b.size")


def group_assets(names: DataFrame, known: DataFrame) -> DataFrame:
    """(page, title, assets): known pages with the file names whose digits name the page; none gives an empty list."""
    n = names.withColumn("page", F.regexp_extract("name", r"([0-9]+)", 1)).where("page <> ''").select(F.col("page").cast("long").alias("page"), "name")
    g = n.groupBy("page").agg(F.sort_array(F.collect_list("name")).alias("assets"))
    return known.join(g, "page", "left").select("page", "title", F.coalesce("assets", F.array().cast("array<string>")).alias("assets"))


def unused_assets(assets: DataFrame, used: DataFrame) -> DataFrame:
    """Names of assets that no used name equals, regardless of case."""
    return assets.withColumn("k", F.lower("name")).join(used.select(F.lower("name").alias("k")), "k", "left_anti").select("name")


def rename(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.replace(column, F.lit(old), F.lit(new)))


def nested_counts(df: DataFrame, outer: str, middle: str, inner: str) -> DataFrame:
    """One row: distinct outer, (outer, middle) and (outer, middle, inner) values."""
    return df.agg(F.count_distinct(outer).alias("n_outer"), F.count_distinct(outer, middle).alias("n_middle"), F.count_distinct(outer, middle, inner).alias("n_inner"))


def nest(species: DataFrame) -> DataFrame:
    """(family, genera): genera with their species, in line order."""
    g = species.groupBy("family", "genus").agg(F.min("line_no").alias("at"), F.array_sort(F.collect_list(F.struct("line_no", "name", "scientific_name", "page"))).alias("species"))
    return g.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("at", "genus", "species"))).alias("genera"))


def patch_json_in_html(html: Column, marker: str, new_json: Column) -> Column:
    """html with the JSON that follows `marker = ` replaced."""
    head = F.regexp_extract(html, rf"(?s)^(.*?{marker}\s*=\s*)", 1)
    tail = F.regexp_extract(html, rf"(?s){marker}\s*=\s*[\[{{].*?[\]}}](;.*)$", 1)
    return F.when((head == "") | (tail == ""), html).otherwise(F.concat(head, new_json, tail))


def patch_records(records: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """records with the rows of patches in place of those with their key, and the new ones added."""
    return records.join(patches.select(key), key, "left_anti").unionByName(patches)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "Window", "F", "T")]
