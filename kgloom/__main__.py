"""python -m kgloom build FOLDER | watch FOLDER | query|path|explain|stats GRAPH.json ... | benchmark GRAPH.json"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators import analyze, traverse
from .plans import pipeline
from .sources import graphjson

QUESTIONS = ["where does the program start", "which parts read or write data", "how are failures reported", "what do most modules depend on", "which classes are extended"]


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("kgloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    what, where, rest = args[0], args[1], args[2:]
    if what == "build":
        pipeline.run(spark, where, f"{where}/kgloom-out")
        return 0
    if what == "watch":
        pipeline.watch_folder(spark, where, f"{where}/kgloom-out").awaitTermination()
        return 0
    kg = graphjson.load(spark, where)
    if what == "query":
        print(traverse.query_graph(kg, " ".join(rest)))
    elif what == "path" and len(rest) == 2:
        print(traverse.shortest_path(kg, *rest))
    elif what == "explain":
        traverse.explain_node(kg, " ".join(rest)).show(100, False)
    elif what == "stats":
        analyze.graph_stats(kg).show(truncate=False)
        analyze.god_nodes(kg).show(truncate=False)
    elif what == "benchmark":
        traverse.token_reduction(kg, QUESTIONS).show(truncate=False)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
