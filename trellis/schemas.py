"""Schemas of the canonical tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "file_path string, content_hash string, line_count int, text string"
TOKENS = "file_path string, symbol string, line int, column int"
SYMBOLS = (
    "symbol_id long, file_path string, symbol string, kind string, language string, qualified_symbol string, container string, "
    "start_line int, start_column int, end_line int, end_column int, signature string, line_count int"
)
REFERENCES = TOKENS
KEY = "struct<symbol:string,qualified_symbol:string,file_path:string,language:string>"
EDGE_CANDIDATES = f"`from` {KEY}, `to` {KEY}, edge_kind string, confidence double, provenance string"
EDGES = "from_symbol_id long, to_symbol_id long, edge_kind string, confidence double, provenance string"

#: So many values (a bounded number) are looked up as literals, which the scan can push down; more by a join.
MOST_LITERALS = 1000


@dataclass
class Index:
    """One snapshot of a corpus: files, tokens, symbols, references, edges.

    A stored snapshot also has its edges sorted by source (outgoing), its
    distinct token names (names) and its symbols sorted by id and by file.
    texts gives the text of files (file_path), where files has none.
    """

    files: DataFrame
    tokens: DataFrame
    symbols: DataFrame
    references: DataFrame
    edges: DataFrame
    outgoing: DataFrame | None = None
    names: DataFrame | None = None
    by_id: DataFrame | None = None
    by_file: DataFrame | None = None
    texts: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.outgoing = self.edges if self.outgoing is None else self.outgoing
        self.names = self.tokens.select("symbol").distinct() if self.names is None else self.names
        self.by_id = self.symbols if self.by_id is None else self.by_id
        self.by_file = self.symbols if self.by_file is None else self.by_file
        self.texts = self.texts or (lambda wanted: picked(self.files, "file_path", wanted).select("file_path", "text"))


def picked(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of df whose column is one of values (one column): few values, counted first, are pushed to the scan as literals."""
    known = values.distinct()
    some = [r[0] for r in known.limit(MOST_LITERALS + 1).collect()]
    if len(some) <= MOST_LITERALS:
        return df.where(F.col(column).isin(some)) if some else df.where(F.lit(False))
    return df.join(known.toDF(column), column, "left_semi").select(*df.columns)
