"""Reactive rebuilds: which file events count, bursts of them, and what each burst calls for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

WATCHED = sorted(set(T.CODE + T.DOCUMENT + T.PAPER + T.IMAGE))
QUIET = "3 seconds"


def counts(path: Column, output_dir: str = "kgloom-out") -> Column:
    """Whether a changed path matters: a known file type, no hidden part, not our own output."""
    return T.suffix(path).isin(WATCHED) & ~path.rlike(r"(^|/)\.") & ~path.rlike(f"(^|/){output_dir}(/|$)")


def bursts(events: DataFrame, quiet: str = QUIET, key: str | None = None) -> DataFrame:
    """(start, end, n_events, paths, code_only): events (ts, path) with less than `quiet` between them. Batch or stream.

    On a stream give events a watermark; a burst closes when the watermark passes its end.
    """
    one = F.substring("path", 1, 0).alias("_all")  # streams need a key besides the window
    by = [F.session_window("ts", quiet).alias("w"), F.col(key) if key else one]
    g = events.groupBy(*by).agg(F.count("*").alias("n_events"), F.sort_array(F.collect_set("path")).alias("paths"), F.every(T.suffix(F.col("path")).isin(T.CODE)).alias("code_only"))
    return g.select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "paths", "code_only")


def sessions(events: DataFrame, quiet_seconds: int, key: str) -> DataFrame:
    """Batch twin by gaps and islands: (key, session, n_events, first, last)."""
    w = Window.partitionBy(key).orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = events.withColumn("_new", F.when(gap < quiet_seconds * 1_000_000, 0).otherwise(1))
    e = e.withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def route(burst: DataFrame) -> DataFrame:
    """Code alone is rebuilt at once; anything else needs an update by hand."""
    return burst.withColumn("action", F.when(F.col("code_only"), "rebuild").otherwise("flag_update"))


def watch(events: DataFrame, rebuild: Callable[[list[str]], None], flag: Callable[[list[str]], None], checkpoint: str, quiet: str = QUIET, watermark: str = "3 seconds") -> StreamingQuery:
    """Runs rebuild or flag for each burst of a stream of events (ts, path). Restarts go on from the checkpoint folder."""
    b = route(bursts(events.where(counts(F.col("path"))).withWatermark("ts", watermark), quiet))

    def act(df: DataFrame, _: int) -> None:
        for r in df.select("paths", "action").toLocalIterator():
            (rebuild if r["action"] == "rebuild" else flag)(list(r["paths"]))

    return b.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(act).start()


def file_events(spark, folder: str) -> DataFrame:
    """A stream of (ts, path) of files that appear in a folder; each is named once (for edits, plans.pipeline.watch_folder)."""
    df = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return df.select(F.col("modificationTime").alias("ts"), "path")
