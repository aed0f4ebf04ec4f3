"""Imports, symbols and calls of Python files, by the standard library's syntax trees."""

from __future__ import annotations

import ast


def parse(text: str) -> dict[str, list[tuple]]:
    """Rows by kind: import, dynamic, symbol, call, binding, warning."""
    out: dict[str, list[tuple]] = {k: [] for k in ("import", "dynamic", "symbol", "call", "binding", "warning")}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out["warning"].append((f"syntax error: {e}"[:300],))
        return out
    _imports(tree, out)
    _symbols(tree.body, out)
    for node in tree.body:
        _callers(node, out)
    return out


def _imports(tree: ast.AST, out: dict[str, list[tuple]]) -> None:
    """(raw_text, specifier, level, names, line, column, is_wildcard), in order of the text."""
    found = [n for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom | ast.Call)]
    for node in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Import):
            for a in node.names:
                out["import"].append((f"import {a.name}" + (f" as {a.asname}" if a.asname else ""), a.name, 0, "", node.lineno, node.col_offset, False))
                out["binding"].append((a.asname or a.name.partition(".")[0], a.name if a.asname else a.name.partition(".")[0], 0, "", node.lineno))
        elif isinstance(node, ast.ImportFrom):
            names = [a.name for a in node.names]
            dots = "." * node.level
            out["import"].append((f"from {dots}{node.module or ''} import {', '.join(names)}", node.module or "", node.level, ",".join(names), node.lineno, node.col_offset, "*" in names))
            for a in node.names:
                out["binding"].append((a.asname or a.name, node.module or "", node.level, a.name, node.lineno))
        else:
            f = node.func
            dynamic = isinstance(f, ast.Name) and f.id == "__import__" or isinstance(f, ast.Attribute) and f.attr == "import_module" and isinstance(f.value, ast.Name) and f.value.id == "importlib"
            if dynamic:
                out["dynamic"].append((ast.unparse(node), node.lineno, "__import__" if isinstance(f, ast.Name) else "importlib"))


def _symbols(body: list[ast.stmt], out: dict[str, list[tuple]]) -> None:
    """(kind, name, fqn, line): functions, classes and their methods, also below if and try; not what functions hold."""
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out["symbol"].append(("function", node.name, f"function:{node.name}", node.lineno))
        elif isinstance(node, ast.ClassDef):
            out["symbol"].append(("class", node.name, f"class:{node.name}", node.lineno))
            for m in node.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    out["symbol"].append(("method", m.name, f"method:{node.name}.{m.name}", m.lineno))
        else:
            for name in ("body", "orelse", "finalbody", "handlers"):
                inner = getattr(node, name, None)
                if isinstance(inner, list):
                    _symbols([x for h in inner for x in (h.body if isinstance(h, ast.ExceptHandler) else [h])], out)


def _callers(node: ast.AST, out: dict[str, list[tuple]], owner: str = "") -> None:
    if isinstance(node, ast.ClassDef):
        for m in node.body:
            if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                _calls(m.body, f"method:{node.name}.{m.name}", node.name, out)
    elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        _calls(node.body, f"function:{node.name}", "", out)
    elif not isinstance(node, ast.Lambda):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.stmt | ast.ExceptHandler):
                _callers(x, out)


def _calls(body: list[ast.AST], owner: str, cls: str, out: dict[str, list[tuple]]) -> None:
    """(owner, owner's class, receiver, name, line) of the calls in a body, without those of functions and lambdas in it."""
    stack = list(reversed(body))
    while stack:
        node = stack.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda | ast.ClassDef):
            continue
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out["call"].append((owner, cls, "", f.id, node.lineno))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                out["call"].append((owner, cls, f.value.id, f.attr, node.lineno))
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
