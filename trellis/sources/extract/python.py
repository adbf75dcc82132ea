"""Python: definitions, calls and imports from the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from . import Symbol, Unit

CONSTANT = re.compile(r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]*)?=(?!=)")


def _module_files(path: str, module: str | None, level: int) -> tuple[str, ...]:
    """Files that a module name may stand for, seen from path."""
    parts = path.split("/")[:-1]
    base = parts[: len(parts) - level + 1] if level else parts[:1]
    tail = module.split(".") if module else []
    found = []
    for root in {tuple(base), ()} if not level else {tuple(base)}:
        full = "/".join([*root, *tail])
        found += [f"{full}.py", f"{full}/__init__.py"]
    return tuple(sorted(found))


def extract(path: str, source: str) -> Unit:
    unit = Unit()
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return unit
    lines = source.split("\n")
    hints: dict[str, tuple[str, tuple[str, ...]]] = {}

    def place(node: ast.AST, name: str) -> tuple[int, int]:
        text = lines[node.lineno - 1].encode()
        at = text.find(name.encode(), node.col_offset)
        return node.lineno, (at if at >= 0 else node.col_offset) + 1

    def add(node: ast.AST, name: str, kind: str, container: str | None, signature: str | None) -> None:
        line, column = place(node, name)
        unit.symbols.add(Symbol(line, column, name, kind, container, node.end_lineno, node.end_col_offset + 1, signature))

    def visit(node: ast.AST, owner: str | None, klass: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                add(child, child.name, "class", klass, lines[child.lineno - 1].strip())
                for b in child.bases:
                    if isinstance(b, ast.Name):
                        unit.edges.add((child.name, b.id, "implements", hints.get(b.id, ("", ()))[1]))
                visit(child, child.name, child.name)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                add(child, child.name, "method" if klass else "function", klass, lines[child.lineno - 1].strip())
                if klass:
                    unit.edges.add((klass, child.name, "contains", (path,)))
                visit(child, child.name, klass)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                level = getattr(child, "level", 0)
                for alias in child.names:
                    if alias.name == "*":
                        continue
                    local = alias.asname or alias.name.split(".")[-1]
                    if isinstance(child, ast.ImportFrom):
                        where, target = _module_files(path, child.module, level), alias.name
                        if not child.module:
                            where += _module_files(path, alias.name, level)
                    else:
                        where, target = _module_files(path, alias.name, 0), local
                    hints[local] = target, where
                    add(child, local, "import", None, None)
                    line, column = place(child, local)
                    unit.references.add((line, column, target))
                    unit.edges.add((local, target, "imports", where))
            else:
                if isinstance(child, ast.Call):
                    call(child, owner)
                visit(child, owner, klass)

    def call(node: ast.Call, owner: str | None) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            unit.references.add((f.lineno, f.col_offset + 1, f.id))
            if owner:
                target, where = hints.get(f.id, (f.id, ()))
                unit.edges.add((owner, target, "calls", where))
        elif isinstance(f, ast.Attribute):
            unit.references.add((f.end_lineno, f.end_col_offset - len(f.attr.encode()) + 1, f.attr))
            if owner:
                root = f.value.id if isinstance(f.value, ast.Name) else None
                unit.edges.add((owner, f.attr, "calls", hints[root][1] if root in hints else (path,) if root in ("self", "cls") else ()))

    visit(module, None, None)
    for n, line in enumerate(lines, 1):
        if m := CONSTANT.match(line):
            unit.symbols.add(Symbol(n, 1, m[1], "const", None, n, len(line.encode()) + 1, None))
    return unit
