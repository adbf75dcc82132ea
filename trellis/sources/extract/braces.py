"""Rust, TypeScript and Go by one lexer of brace languages and a table of rules for each.

Comments and literals are blanked first, so that positions stay and braces
match. A gap against a full parser: code made by macros is not seen.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

from . import Symbol, Unit

BLANK = re.compile(
    r"//[^\n]*|/\*.*?\*/|r#*\"(?:[^\"])*?\"#*|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'", re.S
)
CALL = re.compile(r"((?:[A-Za-z_]\w*\s*(?:::|\.)\s*)*)([A-Za-z_]\w*)\s*(?:::<[^>()]*>)?\(")
#: Words that a bracket may follow without being called.
NOT_CALLED = {"if", "for", "while", "match", "switch", "return", "fn", "func", "function", "catch", "in", "loop", "else", "move", "async", "await", "new", "typeof", "super", "import", "constructor", "where", "as", "mut", "let", "struct", "interface", "map", "make"}


def blank(text: str, pattern: re.Pattern = BLANK) -> str:
    """text with comments and literals replaced by spaces; line feeds and byte counts stay."""

    def spaces(m: re.Match) -> str:
        return "".join(c if c == "\n" else " " * len(c.encode()) for c in m[0])

    return pattern.sub(spaces, text)


class Source:
    """Blanked text with line lookup and brace matching."""

    def __init__(self, text: str):
        self.text, self.code = text, blank(text)
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.code.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.close: dict[int, int] = {}
        stack = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def at(self, offset: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, offset)
        return line, len(self.code[self.starts[line - 1] : offset].encode()) + 1

    def body(self, offset: int) -> tuple[int, int] | None:
        """The braces that open before the statement at offset ends."""
        m = re.compile(r"[{;]").search(self.code, offset)
        return (m.start(), self.close.get(m.start(), len(self.code) - 1)) if m and m[0] == "{" else None


Rule = tuple[str, re.Pattern]


def scan(s: Source, rules: list[Rule], signed: Callable[[str, str], str | None], container: Callable[[int], str | None], unit: Unit) -> list[tuple[str, str, int, int]]:
    """Adds the definitions that rules find; returns (name, kind, begin, end) of those with a body."""
    bodies = []
    for kind, rule in rules:
        for m in rule.finditer(s.code):
            name = m["name"]
            line, column = s.at(m.start("name"))
            body = s.body(m.end("name")) if kind not in ("const", "type_alias", "import", "variable") or "=>" in m[0] else None
            stop = body[1] if body else (s.code.find("\n", m.end()) if s.code.find("\n", m.end()) >= 0 else len(s.code)) - 1
            end_line, end_column = s.at(stop)
            unit.symbols.add(Symbol(line, column, name, kind, container(m.start()), max(line, end_line), end_column + 1, signed(kind, s.lines[line - 1])))
            if body is None and kind == "variable":
                body = m.end() - 1, stop  # an arrow function of one expression
            if body:
                bodies.append((name, kind, *body))
    return bodies


def calls(s: Source, bodies: list[tuple[str, str, int, int]], where: Callable[[str], tuple[str, ...]], unit: Unit, rename: dict[str, str], all_parts: bool = False, receiver_only: bool = False) -> None:
    """Calls in the code: references, and edges from the innermost function around."""
    functions = [b for b in bodies if b[1] in ("function", "method", "variable")]
    defined = {m.end() for m in re.finditer(r"\b(?:fn|func|function)\s+(?:\([^)]*\)\s*)?[A-Za-z_]\w*", s.code)}
    for m in CALL.finditer(s.code):
        name, prefix = m[2], re.sub(r"\s", "", m[1])
        if name in NOT_CALLED or m.end(2) in defined or re.search(r"\b(fn|func|function)\s*$", s.code[: m.start()][-12:]):
            continue
        if receiver_only and prefix.endswith("."):
            root = prefix.split(".")[0]
            unit.references.add((*s.at(m.start()), root))
        else:
            unit.references.add((*s.at(m.start(2)), name))
            if all_parts and prefix:
                at = m.start()
                for part in re.split(r"(::|\.)", m[1]):
                    if re.fullmatch(r"\s*[A-Za-z_]\w*\s*", part):
                        unit.references.add((*s.at(at + len(part) - len(part.lstrip())), part.strip()))
                    at += len(part)
        around = [f for f in functions if f[2] < m.start() <= f[3]]
        if around:
            owner = max(around, key=lambda f: f[2])[0]
            unit.edges.add((owner, rename.get(name, name) if not prefix else name, "calls", where(prefix or name)))


def _rules(**patterns: str) -> list[Rule]:
    return [(k, re.compile(p, re.M)) for k, p in patterns.items()]


RUST = _rules(
    function=r"\bfn\s+(?P<name>\w+)", struct=r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", enum=r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", trait=r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)",
    module=r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)", type_alias=r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", const=r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<name>[A-Z_]\w*)\s*:",
)
TYPESCRIPT = _rules(
    function=r"\bfunction\s*\*?\s+(?P<name>[A-Za-z_$]\w*)", **{"class": r"\bclass\s+(?P<name>[A-Za-z_$]\w*)"}, interface=r"\binterface\s+(?P<name>[A-Za-z_$]\w*)", enum=r"\benum\s+(?P<name>[A-Za-z_$]\w*)",
    type_alias=r"\btype\s+(?P<name>[A-Za-z_$]\w*)\s*(?:<[^=]*>)?\s*=", variable=r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$]\w*)\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=\n]*)?=>",
)
GO = _rules(
    function=r"^func\s+(?P<name>\w+)", method=r"^func\s*\([^)]*\)\s*(?P<name>\w+)", struct=r"^\s*(?:type\s+)?(?P<name>\w+)\s+struct\b", interface=r"^\s*(?:type\s+)?(?P<name>\w+)\s+interface\b",
    type_alias=r"^type\s+(?P<name>\w+)\s*=", type=r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b|=)", const=r"^const\s+(?P<name>\w+)", variable=r"^var\s+(?P<name>\w+)",
)


def _rust_files(path: str, parts: list[str]) -> tuple[str, ...]:
    """Files of a module path: crate, self and super are resolved from path."""
    here = path.split("/")
    root = here[: here.index("src") + 1] if "src" in here else here[:-1]
    folder = here[:-1] if here[-1] in ("mod.rs", "lib.rs", "main.rs") else [*here[:-1], here[-1][:-3]]
    base = root
    while parts and parts[0] in ("crate", "self", "super"):
        head, parts = parts[0], parts[1:]
        base = root if head == "crate" else folder if head == "self" else folder[:-1]
        folder = base
    if not parts:
        return ("/".join(base) + ".rs", "/".join([*base, "mod.rs"]))
    full = "/".join([*base, *parts])
    return (f"{full}.rs", f"{full}/mod.rs")


def rust(path: str, source: str) -> Unit:
    unit, s = Unit(), Source(source)
    impls = []
    for m in re.finditer(r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<type>\w+)", s.code, re.M):
        if body := s.body(m.end()):
            impls.append((m["type"], *body))
            if m["trait"]:
                unit.edges.add((m["type"], m["trait"].split("::")[-1], "implements", ()))
    owner = lambda at: next((t for t, a, b in impls if a < at < b), None)
    signature = lambda kind, line: line.split("{")[0].strip() if kind == "function" else None
    bodies = scan(s, RUST, signature, owner, unit)
    for name, kind, a, _ in bodies:
        if kind == "function" and (t := owner(a)):
            unit.edges.add((t, name, "contains", (path,)))
    rename, where_of = {}, {}
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[\w:]+?)(?:::\{(?P<many>[^}]*)\})?(?:\s+as\s+(?P<alias>\w+))?\s*;", s.code, re.M):
        base = m["path"].split("::")
        items = [x.strip() for x in m["many"].split(",")] if m["many"] else [base[-1] + (f" as {m['alias']}" if m["alias"] else "")]
        for item in filter(None, items):
            target, _, alias = item.partition(" as ")
            target, local = target.split("::")[-1].strip(), (alias or target.split("::")[-1]).strip()
            files = _rust_files(path, base if m["many"] else base[:-1])
            line, column = s.at(m.start("path"))
            unit.symbols.add(Symbol(line, column, local, "import", None, line, column + len(local), None))
            rename[local], where_of[local] = target, files
            if alias:
                unit.edges.add((local, target, "imports", files))

    def where(prefix: str) -> tuple[str, ...]:
        parts = [p for p in prefix.split("::") if p]
        if "::" in prefix:
            return where_of[parts[0]] if parts[0] in where_of and len(parts) == 1 else _rust_files(path, parts)
        return where_of.get(prefix, ())

    calls(s, bodies, where, unit, rename, all_parts=True, receiver_only=True)
    return unit


def typescript(path: str, source: str) -> Unit:
    unit, s = Unit(), Source(source)
    classes = []
    for m in re.finditer(r"\bclass\s+(?P<name>\w+)(?P<rest>[^{]*)", s.code):
        if body := s.body(m.end()):
            classes.append((m["name"], *body))
        if i := re.search(r"implements\s+([\w\s,]+)", m["rest"]):
            for t in i[1].split(","):
                unit.edges.add((m["name"], t.strip(), "implements", ()))
    owner = lambda at: next((t for t, a, b in classes if a < at < b), None)
    first = lambda kind, line: line.strip()
    bodies = scan(s, TYPESCRIPT, first, owner, unit)
    for name, a, b in classes:
        for m in re.finditer(r"^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<name>[A-Za-z_$]\w*)\s*(?:<[^>()]*>)?\([^()]*\)\s*(?::[^{;=\n]*)?\{", s.code[a:b], re.M):
            if m["name"] in NOT_CALLED or s.code[a : a + m.start()].count("{") - s.code[a : a + m.start()].count("}") != 1:
                continue
            at = a + m.start("name")
            body = s.body(at)
            line, column = s.at(at)
            unit.symbols.add(Symbol(line, column, m["name"], "method", name, s.at(body[1])[0], s.at(body[1])[1] + 1, s.lines[line - 1].strip()))
            unit.edges.add((name, m["name"], "contains", (path,)))
            bodies.append((m["name"], "method", *body))
    rename, where_of = {}, {}
    for m in re.finditer(r"import\s+(?:type\s+)?(?:(?P<all>\*\s+as\s+\w+)|(?P<default>\w+)?\s*,?\s*(?:\{(?P<many>[^}]*)\})?)\s*from\s*['\"](?P<from>[^'\"]+)['\"]", source):
        files: tuple[str, ...] = ()
        if m["from"].startswith("."):
            full = posixpath.normpath(posixpath.join(posixpath.dirname(path), m["from"]))
            files = tuple(f"{full}{x}" for x in (".ts", ".tsx", "/index.ts", "/index.tsx"))
        if m["all"]:
            where_of[m["all"].split()[-1]] = files
        for item in filter(None, [*(x.strip() for x in (m["many"] or "").split(",")), m["default"]]):
            target, _, alias = item.partition(" as ")
            target, local = target.removeprefix("type ").strip(), (alias or target.removeprefix("type ")).strip()
            line = source[: m.start()].count("\n") + 1
            column = m.start() - source.rfind("\n", 0, m.start())
            unit.symbols.add(Symbol(line, column, local, "import", None, line, column + len(m[0]), None))
            rename[local], where_of[local] = target, files
            unit.edges.add((local, target, "imports", files))
    calls(s, bodies, lambda p: where_of.get(p.split(".")[0], (path,) if p.startswith("this.") else ()), unit, rename)
    return unit


def go(path: str, source: str) -> Unit:
    unit, s = Unit(), Source(source)
    receiver = {m.start(): m["type"] for m in re.finditer(r"^func\s*\(\s*\w*\s*\*?(?P<type>\w+)[^)]*\)\s*\w+", s.code, re.M)}
    bodies = scan(s, GO, lambda kind, line: None, lambda at: receiver.get(at), unit)
    for m in re.finditer(r"^func\s*\(\s*\w*\s*\*?(?P<type>\w+)[^)]*\)\s*(?P<name>\w+)", s.code, re.M):
        unit.edges.add((m["type"], m["name"], "contains", (path,)))
    where_of = {}
    for block in re.finditer(r"^import\s+(?:\((?P<many>.*?)\)|(?P<one>[^\n]+))", source, re.M | re.S):
        for m in re.finditer(r"(?:(?P<alias>[\w.]+)\s+)?\"(?P<path>[^\"]+)\"", block["many"] or block["one"]):
            if m["alias"] in ("_", "."):
                continue
            stem = m["path"].split("/")[-1]
            local = m["alias"] or stem
            base = posixpath.normpath(posixpath.join(posixpath.dirname(path), m["path"])) if m["path"].startswith(".") else m["path"]
            files = (f"{base}.go", f"{base}/{stem}.go", f"{base}/main.go")
            at = block.start() + block[0].find(m[0])
            line, column = source[:at].count("\n") + 1, at - source.rfind("\n", 0, at)
            unit.symbols.add(Symbol(line, column, local, "import", None, line, column + len(m[0]), None))
            where_of[local] = files
            unit.edges.add((local, stem, "imports", files))
    for m in re.finditer(r"^(?P<word>const|var)[ \t]*(?P<open>\()?", s.code, re.M):
        end = s.code.find("\n)", m.end()) if m["open"] else s.code.find("\n", m.end())
        for spec in re.finditer(r"^[ \t]*(?P<names>[A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)[^\n]*", s.code[m.end() : end if end > 0 else len(s.code)], re.M):
            for name in re.finditer(r"[A-Za-z_]\w*", spec["names"]):
                at = m.end() + spec.start("names") + name.start()
                line, column = s.at(at)
                if name[0] != "_" and not any(x.symbol == name[0] and x.start_line == line for x in unit.symbols):
                    last = s.at(m.end() + spec.end())
                    unit.symbols.add(Symbol(line, column, name[0], "const" if m["word"] == "const" else "variable", None, last[0], last[1], None))
    # an imported package's files are tried first, then, as for plain names, this file and the language's only one
    calls(s, bodies, lambda p: where_of.get(p.split(".")[0], ()), unit, {})
    return unit
