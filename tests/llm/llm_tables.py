"""Shared by the tests of this folder."""

from pyspark.sql import functions as F

#: Names that operators use inside, as columns of the input.
CLASH = ["doc", "line", "i", "t", "p", "id", "row", "same", "sig", "bands", "rank", "score", "lines_dropped", "part", "n", "u", "v", "a.b", "__gone", "keep", "slot", "shard"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])
