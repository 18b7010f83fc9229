"""File scans: listing, classification, manifest and content cache."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, exists, qualified

NEEDS_GRAPH, TOO_MANY_WORDS, TOO_MANY_FILES = 50_000, 500_000, 200


STEP = 512  # folders that a task lists before the rest is spread anew
PIECE = 32 << 20  # bytes of content held at once, about


def store(uri: str):
    """(file system, path in it) of a qualified URI, for Python workers."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, path = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"{base.rstrip('/')}/{path}" if base.strip("/") else f"/{path}"


def _pruned(rel: str, name: str) -> bool:
    """Whether a folder is not entered: noise and hidden ones, and of our own output all but its memory."""
    here = f"{rel}/{name}" if rel else name
    if here == "kgloom-out" or here.startswith("kgloom-out/"):
        return here != "kgloom-out" and here != "kgloom-out/memory" and not here.startswith("kgloom-out/memory/")
    return name.startswith(".") or name in T.SKIPPED_DIRS or re.search(T.NOISE_SUFFIX, name) is not None


_LISTED = "path string, mtime timestamp, length long, folder boolean"


def _walk(uri: str):
    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("folder", pa.bool_())])
        system, base = store(uri)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            todo, found, listed = [r for r in batch.column(0).to_pylist()], [], 0
            while todo and listed < STEP:
                rel, listed = todo.pop(), listed + 1
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base, allow_not_found=True))
                except OSError:  # a folder that may not be read
                    continue
                for e in entries:
                    name = e.base_name
                    here = f"{rel}/{name}" if rel else name
                    if e.type == fs.FileType.File:
                        found.append((here, (e.mtime_ns or 0) // 1000, e.size, False))
                    elif e.type == fs.FileType.Directory and not _pruned(rel, name) and not (local and os.path.islink(e.path)):
                        todo.append(here)
            found += [(r, 0, 0, True) for r in todo]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _reader(uri: str):
    @F.pandas_udf("binary")
    def content(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Bytes of each file, null where it is gone or may not be read; passed on in pieces."""
        system, base = store(uri)
        for batch in paths:
            held, size = [], 0
            for rel in batch:
                try:
                    with system.open_input_stream(f"{base}/{rel}") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= PIECE:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    return content


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length, content) of files below root, path relative; noise and hidden folders and hidden files are left out.

    Names may start with `_`, which Spark's own file sources hide. Folders are listed by tasks, those still to be listed after STEP of
    them being spread anew, and noise is never entered; links to folders are not followed. Content is read only where a later step uses it.
    """
    uri = qualified(spark, root)
    todo, parts = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut(todo.select("path").mapInArrow(_walk(uri), _LISTED))
        parts.append(listed.where("not folder"))
        left = listed.where("folder")
        if (n := left.count()) == 0:
            break
        todo = left.repartition(max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    path = F.col("path")
    df = df.where(path.startswith("kgloom-out/memory/") | (~T.in_noise_dir(path) & ~T.file_name(path).startswith(".") & ~path.startswith("kgloom-out/")))
    return df.select("path", "mtime", "length", _reader(uri)(path).alias("content"))


def common_root(files: DataFrame) -> str:
    """The deepest folder that holds all files; '' where there is none or no file."""
    folder = F.concat(F.lit("/"), F.regexp_replace("path", "/?[^/]*$", ""), F.lit("/"))
    lo, hi = files.agg(F.min(folder), F.max(folder)).first()  # what the least and the greatest share, all share
    shared = []
    for a, b in zip((lo or "").split("/")[1:-1], (hi or "").split("/")[1:-1]):
        if a != b:
            break
        shared.append(a)
    return "/".join(shared)


def detect(files: DataFrame) -> DataFrame:
    """(path, file_type, words, sensitive) of files that can be read; text files need `content`."""
    body = F.decode("content", "utf-8")
    textual = T.suffix(F.col("path")).isin(T.CODE + T.DOCUMENT)
    out = files.select("path", T.is_sensitive(F.col("path")).alias("sensitive"), T.classify(F.col("path"), body).alias("file_type"), F.when(textual, T.word_count(body)).otherwise(F.lit(0)).cast("long").alias("words"))
    return out.where("file_type is not null")


def corpus_health(files: DataFrame) -> DataFrame:
    """One row: total_files, total_words, needs_graph, warning. files: (words) of readable files."""
    n, w = F.count("*"), F.coalesce(F.sum("words"), F.lit(0)).cast("long")
    out = files.agg(n.alias("total_files"), w.alias("total_words"))
    words, count = F.format_number("total_words", 0), F.format_number("total_files", 0)
    small = F.concat(F.lit("Corpus is ~"), words, F.lit(" words - it fits in a context window; a graph may not be needed."))
    large = F.concat(F.lit("Large corpus: "), count, F.lit(" files, ~"), words, F.lit(" words. Extraction will be expensive."))
    return out.select("*", (F.col("total_words") >= NEEDS_GRAPH).alias("needs_graph"), F.when(F.col("total_words") < NEEDS_GRAPH, small).when((F.col("total_words") >= TOO_MANY_WORDS) | (F.col("total_files") >= TOO_MANY_FILES), large).alias("warning"))


def files_by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n_files"), F.sum("words").cast("long").alias("n_words"), F.sort_array(F.collect_list("path")).alias("paths"))


def collect_code(files: DataFrame) -> DataFrame:
    """Paths of code files, sorted; nothing below a hidden folder."""
    p = F.col("path")
    return files.where(T.suffix(p).isin([x for x in T.CODE if x != "swift"]) & ~p.rlike(r"(^|/)\.")).select("path").orderBy("path")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def changed(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(path, status) by modification time: new (not in the manifest), changed (strictly later), unchanged, deleted."""
    if manifest is None:
        return files.select("path", F.lit("new").alias("status"))
    both = files.select("path", F.col("mtime").alias("now")).join(manifest.select("path", F.col("mtime").alias("then")), "path", "full")
    return both.select("path", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("then"), "changed").otherwise("unchanged").alias("status"))


def save_manifest(files: DataFrame, path: str) -> None:
    files.select("path", "mtime").write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    return spark.read.schema("path string, mtime timestamp").parquet(path)


def pdf_text(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files, '' where one can't be read; needs pypdf on the executors."""

    def read(batches):
        import io

        import pyarrow as pa
        from pypdf import PdfReader

        for batch in batches:
            out = []
            for data in batch.column(1):
                try:
                    out.append("\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data.as_py())).pages))
                except Exception:
                    out.append("")
            yield pa.record_batch([batch.column(0), pa.array(out)], names=["path", "text"])

    return files.where(T.suffix(F.col("path")) == "pdf").select("path", "content").mapInArrow(read, "path string, text string")

