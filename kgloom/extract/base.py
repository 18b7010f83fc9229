"""What every extractor shares: ids, the rows of one file, and the pass that joins calls to functions."""

from __future__ import annotations

import re
from pathlib import PurePosixPath


def make_id(*parts: str) -> str:
    kept = [p for p in (str(x).strip("_.") for x in parts) if p]
    return re.sub("[^0-9A-Za-z]+", "_", "_".join(kept)).strip("_").lower()


class Rows:
    """Nodes and edges found in one file. Ids are made of the file's stem, or of its whole path."""

    def __init__(self, path: str, by_path: bool = False):
        p = PurePosixPath(path)
        self.path, self.scope = path, (str(p.with_suffix("")) if by_path else p.stem)
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []
        self.file = self.node(make_id(self.scope), p.name, 1)

    def node(self, id_: str, label: str, line: int, source: str | None = None) -> str:
        if id_ not in self.nodes:
            where = f"L{line}" if line else ""
            self.nodes[id_] = dict(id=id_, label=label, file_type="code", source_file=self.path if source is None else source, source_location=where)
        return id_

    def edge(self, source: str, target: str, relation: str, line: int, sure: bool = True) -> None:
        confidence, weight = ("EXTRACTED", 1.0) if sure else ("INFERRED", 0.8)
        self.edges.append(dict(source=source, target=target, relation=relation, confidence=confidence, source_file=self.path, source_location=f"L{line}", weight=weight))

    def type(self, name: str, line: int, contained: bool = True) -> str:
        id_ = make_id(self.scope, name)
        new = id_ not in self.nodes
        self.node(id_, name, line)
        if contained and (new or not any(e["target"] == id_ and e["relation"] == "contains" for e in self.edges)):
            self.edge(self.file, id_, "contains", line)
        return id_

    def function(self, name: str, line: int, parent: str | None) -> str:
        if parent:
            id_ = self.node(make_id(parent, name), f".{name}()", line)
            self.edge(parent, id_, "method", line)
        else:
            id_ = self.node(make_id(self.scope, name), f"{name}()", line)
            self.edge(self.file, id_, "contains", line)
        return id_

    def imported(self, name: str, relation: str, line: int) -> None:
        if target := make_id(name):
            self.edge(self.file, target, relation, line)

    def calls(self, sites: list[tuple[str, str, int]]) -> None:
        """sites: (calling node, called name, line). Names are compared without case; the last node of a name counts."""
        names = {n["label"].strip("()").lstrip(".").lower(): i for i, n in self.nodes.items()}
        seen = set()
        for caller, name, line in sites:
            target = names.get(name.lower())
            if target and target != caller and (caller, target) not in seen:
                seen.add((caller, target))
                self.edge(caller, target, "calls", line, sure=False)

    def result(self) -> dict:
        """Edges that leave the file remain only where they are imports."""
        keep = [e for e in self.edges if e["source"] in self.nodes and (e["target"] in self.nodes or e["relation"].startswith("imports"))]
        return {"nodes": list(self.nodes.values()), "edges": keep}
