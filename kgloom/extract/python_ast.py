"""Python files, by the standard library's parser."""

from __future__ import annotations

import ast

from .base import Rows, make_id


def extract_python(path: str, text: str, by_path: bool = False) -> dict:
    """Classes, functions, methods, imports, inheritance and calls; `error` where the file can't be parsed.

    Functions nested in functions are no nodes, and calls in them are not their outer function's.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return dict(nodes=[], edges=[], error=str(e))
    rows, bodies = Rows(path, by_path), []

    def walk(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                for a in n.names:
                    rows.imported(a.name, "imports", n.lineno)
            elif isinstance(n, ast.ImportFrom):
                if n.module:
                    rows.imported(n.module, "imports_from", n.lineno)
            elif isinstance(n, ast.ClassDef):
                c = rows.type(n.name, n.lineno)
                for b in n.bases:
                    if isinstance(b, ast.Name):
                        base = make_id(rows.scope, b.id)
                        if base not in rows.nodes:
                            base = rows.node(make_id(b.id), b.id, 0, source="")
                        rows.edge(c, base, "inherits", n.lineno)
                walk(n, c)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                bodies.append((rows.function(n.name, n.lineno, parent), n))
            else:
                walk(n, parent)

    walk(tree, None)
    sites: list[tuple[str, str, int]] = []

    def calls(caller: str, node: ast.AST) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            if isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name:
                    sites.append((caller, name, n.lineno))
            calls(caller, n)

    for caller, fn in bodies:
        calls(caller, fn)
    rows.calls(sites)
    return rows.result()


def imported_names(path: str, text: str) -> list[dict]:
    """(file, target_stem, name) of `from module import name`, for joining imports across files."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [{"file": path, "target_stem": n.module.split(".")[-1], "name": a.name} for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module for a in n.names]
