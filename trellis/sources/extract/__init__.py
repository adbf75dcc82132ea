"""Definitions, references and edges of source files, one adapter for each language.

An adapter takes (file_path, source) and returns a Unit; `extract` runs them
over a files table, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Symbol:
    start_line: int
    start_column: int
    symbol: str
    kind: str
    container: str | None
    end_line: int
    end_column: int
    signature: str | None


@dataclass
class Unit:
    """symbols; references (line, column, name); edges (from name, to name, kind, file candidates)."""

    symbols: set[Symbol] = field(default_factory=set)
    references: set[tuple[int, int, str]] = field(default_factory=set)
    edges: set[tuple[str, str, str, tuple[str, ...]]] = field(default_factory=set)


#: Confidence and provenance of extracted edges.
EDGE = {"contains": (1.0, "ast_definition"), "calls": (0.95, "call_resolution"), "imports": (0.9, "import_resolution"), "implements": (0.95, "ast_reference")}
Adapter = Callable[[str, str], Unit]


def adapters() -> dict[str, tuple[str, Adapter]]:
    """By file extension: language and adapter."""
    from . import braces, python

    return {".py": ("python", python.extract), ".rs": ("rust", braces.rust), ".ts": ("typescript", braces.typescript), ".tsx": ("typescript", braces.typescript), ".go": ("go", braces.go)}


SCHEMA = (
    "row string, file_path string, symbol string, kind string, language string, container string, start_line int, start_column int, end_line int, end_column int, signature string, "
    "from_symbol string, edge_kind string, candidates array<string>"
)


def extract(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA (row: symbol, reference or edge) of files (file_path, text). Files that do not parse give no rows."""

    def run(batches):
        known = adapters()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int32()] * 4 + [pa.string()] * 3 + [pa.list_(pa.string())]
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext = "." + path.rsplit(".", 1)[-1]
                if ext not in known or text is None:
                    continue
                language, adapter = known[ext]
                unit = adapter(path, text)
                for s in sorted(unit.symbols, key=lambda s: (s.start_line, s.start_column, s.symbol, s.kind)):
                    out.append(("symbol", path, s.symbol, s.kind, language, s.container, s.start_line, s.start_column, s.end_line, s.end_column, s.signature, None, None, None))
                for line, column, name in sorted(unit.references):
                    out.append(("reference", path, name, None, language, None, line, column, None, None, None, None, None, None))
                for a, z, kind, where in sorted(unit.edges):
                    out.append(("edge", path, z, None, language, None, None, None, None, None, None, a, kind, list(where)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    return files.select("file_path", F.col("text").cast("string")).mapInArrow(run, SCHEMA)
