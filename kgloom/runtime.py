"""Shared storage for iterative programs."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder of the session, without its lineage.

    A temporary folder is used only where none is set and the session runs on one machine; on a cluster that is an error.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="kgloom-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing names any more; it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme and host, absolute."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 0 in a total order, without bringing them together: sorted by ranges, counted by part."""
    s = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = sorted(tuple(r) for r in s.groupBy(part.alias("p")).agg(F.count("*")).collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    at = df.sparkSession.createDataFrame(offsets, "_p long, _before long")
    return s.join(F.broadcast(at), part == F.col("_p")).withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")
