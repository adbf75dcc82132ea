"""Tokens and keywords of text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"
#: Words that say nothing about a task.
STOP_WORDS = ["about", "after", "and", "for", "from", "into", "that", "the", "then", "this", "when", "with"]
#: Changed symbols too generic to plan tests by.
GENERIC = ["args", "common", "error", "file", "files", "json", "main", "mod", "output", "path", "query", "repo", "result", "run", "symbol", "test", "tests", "value"]


def lines(text: Column) -> Column:
    """Lines without line ends; a last empty line does not count."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def tokens(files: DataFrame) -> DataFrame:
    """Every identifier of files (file_path, text, ...): symbol, line, byte column, all counted from 1.

    Columns come from a running sum over the line's pieces; a query that does
    not use them is planned without that window and its shuffle.
    """
    each = files.select("*", F.posexplode(F.split("text", "\n")).alias("l", "line_text")).drop("text")
    pieces = each.select("*", F.posexplode(F.regexp_extract_all("line_text", F.lit(f"[^A-Za-z0-9_]*{TOKEN}"), F.lit(0))).alias("i", "piece")).drop("line_text")
    symbol = F.regexp_extract("piece", f"{TOKEN}$", 0)
    end = F.sum(F.octet_length("piece")).over(Window.partitionBy("file_path", "l").orderBy("i"))
    out = pieces.withColumn("symbol", symbol).withColumn("column", (end - F.length("symbol") + 1).cast("int")).withColumn("line", (F.col("l") + 1).cast("int"))
    return out.where(~F.col("symbol").rlike("^[0-9]")).drop("l", "i", "piece")


def task_keywords(task: Column) -> Column:
    words = F.transform(F.regexp_extract_all(task, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))


def symbol_keywords(symbol: Column) -> Column:
    parts = F.split(F.regexp_replace(symbol, "([a-z])([A-Z])", "$1_$2"), r"[_\W]")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.lower), lambda w: F.length(w) >= 3)))


def matched_keywords(task_words: Column, symbol_words: Column) -> Column:
    """Task keywords that equal, begin or continue one of the symbol's."""
    return F.filter(task_words, lambda k: F.exists(symbol_words, lambda s: (s == k) | s.startswith(k) | k.startswith(s)))


def sub_tokens(symbol: Column) -> Column:
    return F.array_distinct(F.filter(F.split(symbol, "_"), lambda w: F.length(w) >= 3))


def snippet(text: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines start - context to end + context, trimmed; null if nothing is there."""
    first = F.greatest(start - context, F.lit(1))
    part = F.slice(lines(text), first, F.greatest(end + context - first + 1, F.lit(0)))
    return F.nullif(F.trim(F.array_join(part, "\n")), F.lit(""))
