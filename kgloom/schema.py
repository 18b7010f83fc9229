"""Table schemas, vocabularies and defaults of the knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id string, label string, file_type string, source_file string, source_location string, source_url string, captured_at string, author string, contributor string, community int, ord long"
EDGES = "source string, target string, relation string, confidence string, confidence_score double, weight double, source_file string, source_location string, ord long"
HYPEREDGES = "id string, label string, nodes array<string>, relation string, confidence string, confidence_score double, source_file string"

FILE_TYPES = ("code", "document", "paper", "image")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_KEYS = tuple("id label file_type source_file".split())
EDGE_KEYS = tuple("source target relation confidence source_file".split())
STRUCTURAL = tuple("contains imports imports_from method".split())


@dataclass
class KG:
    """A built graph: unique nodes, one edge a pair (u is the endpoint that comes first), hyperedges."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None


def score_default(confidence, score):
    """Confidence score of an edge, or what its confidence stands for; no confidence counts as EXTRACTED."""
    c = F.coalesce(confidence, F.lit("EXTRACTED"))
    return F.coalesce(score, F.when(c == "INFERRED", 0.5).when(c == "AMBIGUOUS", 0.2).otherwise(1.0))
