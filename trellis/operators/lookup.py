"""Symbol lookup: find, refs, resolve, batches, explain, snippet, outline, status."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import workdir
from ..functions import paths, scoring
from ..functions import text as tx
from ..schemas import MOST_LITERALS, Index, picked

RANKED = ["path_rank", "file_path", "line", "column", "symbol", "why_matched"]
MATCH = ["file_path", "line", "column", "symbol", "why_matched", "confidence", "score"]


def _match(df: DataFrame, why: str, confidence: str, score: float, line: str = "line", column: str = "column") -> DataFrame:
    return df.select("file_path", F.col(line).alias("line"), F.col(column).alias("column"), "symbol", F.lit(why).alias("why_matched"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"))


def definitions(ix: Index, symbol: str) -> DataFrame:
    return _match(ix.symbols.where(F.col("symbol") == symbol), "exact_symbol_name", "ast_exact", 1.0, "start_line", "start_column")


def references(ix: Index, symbol: str) -> DataFrame:
    return _match(ix.references.where(F.col("symbol") == symbol).dropDuplicates(["file_path", "symbol", "line", "column"]), "ast_reference", "ast_likely", 0.95)


def text_matches(ix: Index, symbol: str, code_only: bool = False, exclude_tests: bool = False) -> DataFrame:
    """Tokens equal to symbol, then those that contain it (ASCII case-insensitive; _ and % are wildcards).

    The pattern is tried on distinct names; tokens of the names found are then looked up.
    """
    like = ix.names.where((F.col("symbol") == symbol) | F.col("symbol").ilike(f"%{symbol}%")).select("symbol")
    tokens = picked(ix.tokens, "symbol", like).where(paths.query_scope(F.col("file_path"), code_only, exclude_tests))
    exact = F.col("symbol") == symbol
    return tokens.select(
        "file_path", "line", "column", "symbol", F.when(exact, "exact_symbol_name").otherwise("text_substring_match").alias("why_matched"), F.lit("text_fallback").alias("confidence"), F.when(exact, 0.8).otherwise(0.4).alias("score"),
    )


def in_order(matches: DataFrame) -> DataFrame:
    """Best score first, then code, tests and other files, then by place."""
    out = matches.withColumn("path_rank", paths.class_rank(F.col("file_path")))
    return out.orderBy(F.desc("score"), *RANKED).drop("path_rank")


def find(ix: Index, symbol: str, code_only: bool = False, exclude_tests: bool = False) -> DataFrame:
    """Definitions of a name, or text matches where there are none (one row is probed)."""
    found = definitions(ix, symbol)
    return in_order(text_matches(ix, symbol, code_only, exclude_tests) if found.isEmpty() else found)


def refs(ix: Index, symbol: str, code_only: bool = False, exclude_tests: bool = False) -> DataFrame:
    """References of a name, or text matches where there are none (one row is probed)."""
    found = references(ix, symbol)
    return in_order(text_matches(ix, symbol, code_only, exclude_tests) if found.isEmpty() else found)


def path_filter(p: Column, scope: str = "all", file: str | None = None, lang: str | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """The caller's filters of paths: scope, one file, a language by extension, excluded globs."""
    ok = paths.in_scope(p, scope) & ~paths.excluded(p, list(exclude))
    if file:
        ok = ok & (paths.normalized(p) == paths.normalized(F.lit(file)))
    if lang:
        ok = ok & (paths.language(p) == lang.lower())
    return ok


def rank(matches: DataFrame, limit: int | None = None, scope: str = "all", file: str | None = None, language: str | None = None, exclude: tuple[str, ...] = (), include_fixtures: bool = False, prefer_file: str | None = None, prefer_language: str | None = None) -> DataFrame:
    """The caller's filters, preferences and limit, after the fallback was decided."""
    p = F.col("file_path")
    out = matches.where(path_filter(p, scope, file, language, exclude)).withColumn("score", scoring.preference(F.col("score"), p, include_fixtures, prefer_file, prefer_language))
    out = in_order(out)
    return out if limit is None else out.limit(limit)


def grouped(matches: DataFrame) -> DataFrame:
    """Counts of matches as definitions, tests, documentation, source, other."""
    p = F.col("file_path")
    bucket = F.when(F.col("confidence") == "ast_exact", "Definitions").when(paths.is_test_group(p), "Test").when(p.rlike(r"\.(md|rst|txt)$"), "Documentation").when(paths.is_code(p), "Source").otherwise("Other")
    return matches.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("matches"), F.count_distinct("file_path").alias("files"))


def did_you_mean(ix: Index, symbol: str, limit: int = 5) -> DataFrame:
    return ix.symbols.where(F.col("symbol").ilike(f"%{symbol}%")).select("symbol").distinct().orderBy(F.length("symbol"), "symbol").limit(limit)


def resolve_candidates(ix: Index, symbol: str, limit: int = 50, kind: str | None = None, language: str | None = None, **filters) -> DataFrame:
    """Candidates of a name, exact first; the limit comes before the filters (kind, language, and those of rank by path).

    ambiguous: whether more than one is left; recommended: the first of them.
    """
    exact = (F.col("symbol") == symbol).cast("int")
    order = [F.col("exact").desc(), "symbol", "file_path", "start_line", "symbol_id"]
    some = ix.symbols.where(F.col("symbol").ilike(f"%{symbol}%")).withColumn("exact", exact).orderBy(*order).limit(limit)
    if kind:
        some = some.where(F.col("kind") == kind)
    if language:
        some = some.where(F.col("language") == language)
    some = some.where(path_filter(F.col("file_path"), **filters))
    # at most limit rows
    whole = Window.partitionBy(F.lit(0))
    some = some.withColumns({"ambiguous": F.count("*").over(whole) > 1, "recommended": F.row_number().over(whole.orderBy(*order)) == 1})
    return some.orderBy(*order).select("symbol_id", "symbol", "qualified_symbol", "kind", "language", "file_path", F.col("start_line").alias("line"), "signature", "ambiguous", "recommended")


def parse_query(query: str) -> dict[str, str | None]:
    """lang:path::name and path::name are taken apart; anything else is the name."""
    import re

    m = re.match(r"^(?:(rust|typescript|python|go|unknown):)?(.+)::([^:]+)$", query)
    if m and ("/" in m[2] or re.search(paths.CODE, m[2])):
        return {"symbol": m[3], "file": m[2], "language": m[1]}
    return {"symbol": query, "file": None, "language": None}


def find_qualified(ix: Index, query: str, **filters) -> DataFrame:
    """find of a name that may carry its language and file, which are then preferred."""
    asked = parse_query(query)
    return rank(find(ix, asked["symbol"]), prefer_file=asked["file"], prefer_language=asked["language"], **filters)


def batch(ix: Index, requests: DataFrame, fail_fast: bool = False) -> DataFrame:
    """find and refs for a table of requests (position, id, command, symbol), in their order; other commands give an error row.

    With fail_fast nothing after the first unsupported request is answered.
    Names are looked up by equality; patterns of what is left are tried on the
    distinct names only, as literals, in blocks of MOST_LITERALS requests.
    """
    spark = ix.symbols.sparkSession
    asked = requests.select("position", "id", "command", "symbol")
    wrong = ~F.col("command").isin("find", "refs")
    if fail_fast and (stop := asked.where(wrong).agg(F.min("position")).first()[0]) is not None:
        asked = asked.where(F.col("position") <= stop)
    mine = asked.select("position", "id", "command", "symbol")
    finds, uses = mine.where("command = 'find'"), mine.where("command = 'refs'")
    defs = definitions_of(picked(ix.symbols, "symbol", finds.select("symbol"))).join(finds, "symbol")
    found = picked(ix.references, "symbol", uses.select("symbol")).select("file_path", "symbol", "line", "column").distinct()
    semantic = defs.unionByName(_match(found, "ast_reference", "ast_likely", 0.95).join(uses, "symbol"))
    left = mine.where(~wrong).join(semantic.select("position").distinct(), "position", "left_anti").orderBy("position")
    out = semantic
    for block in _blocks(left):
        literal = F.array(*[F.struct(F.lit(r.position).alias("position"), F.lit(r.id).alias("id"), F.lit(r.command).alias("command"), F.lit(r.symbol).alias("wanted")) for r in block])
        hit = ix.names.select("symbol", F.explode(F.filter(literal, lambda r: F.ilike(F.col("symbol"), F.concat(F.lit("%"), r["wanted"], F.lit("%"))))).alias("r")).select("symbol", "r.*")
        hit = workdir.stage(hit, "batch-names")
        tokens = picked(ix.tokens, "symbol", hit.select("symbol")).join(hit, "symbol")
        exact = F.col("symbol") == F.col("wanted")
        out = out.unionByName(tokens.select(
            "position", "id", "command", "file_path", "line", "column", "symbol", F.when(exact, "exact_symbol_name").otherwise("text_substring_match").alias("why_matched"), F.lit("text_fallback").alias("confidence"), F.when(exact, 0.8).otherwise(0.4).alias("score"),
        ))
    errors = asked.where(wrong).select("position", "id", "command", F.concat(F.lit("unsupported command '"), "command", F.lit("'")).alias("error"))
    out = out.unionByName(errors, allowMissingColumns=True).withColumn("path_rank", paths.class_rank(F.col("file_path")))
    return out.orderBy("position", F.desc("score"), *RANKED).drop("path_rank")


def _blocks(requests: DataFrame):
    """The rows of a stated query set, MOST_LITERALS at a time."""
    rows = requests.toLocalIterator()
    while block := list(itertools.islice(rows, MOST_LITERALS)):
        yield block


def definitions_of(symbols: DataFrame) -> DataFrame:
    return _match(symbols, "exact_symbol_name", "ast_exact", 1.0, "start_line", "start_column")


def edge_counts(ix: Index, symbol: str, with_snippet: bool = False) -> DataFrame:
    """explain: each definition with its inbound and outbound edges by kind (unknown kinds are not counted) and, if asked, its lines."""
    mine = ix.symbols.where(F.col("symbol") == symbol)
    ids = mine.select("symbol_id")

    def side(edges: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
        e = picked(edges, end, ids)
        return e.groupBy(F.col(end).alias("symbol_id")).agg(*[F.count_if(F.col("edge_kind") == k).alias(v) for k, v in names.items()])

    inbound = side(ix.edges, "to_symbol_id", {k: f"in_{v}" for k, v in scoring.INBOUND.items()})
    outbound = side(ix.outgoing, "from_symbol_id", {k: f"out_{k}" for k in scoring.INBOUND})
    counts = [c for df in (inbound, outbound) for c in df.columns if c != "symbol_id"]
    out = mine.join(inbound, "symbol_id", "left").join(outbound, "symbol_id", "left")
    more = []
    if with_snippet:
        out = out.join(ix.texts(mine.select("file_path")), "file_path", "left")
        more = [tx.snippet(F.col("text"), F.col("start_line"), F.col("end_line")).alias("snippet")]
    out = out.select(
        "symbol", qualified().alias("qualified_symbol"), "kind", "language", "file_path", "start_line", "start_column", "end_line", "end_column", "signature", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.lit("exact symbol definition match").alias("why_included"), F.lit("graph_exact").alias("confidence"), F.lit("ast_definition").alias("provenance"), F.lit(1.0).alias("score"), *more,
    )
    return out.orderBy("file_path", "start_line", "start_column", "qualified_symbol", "kind")


def qualified() -> Column:
    """A symbol's qualified name, made up where the index has none."""
    return F.coalesce("qualified_symbol", F.concat("language", F.lit(":"), "file_path", F.lit("::"), "symbol"))


def snippets(ix: Index, symbol: str, context: int = 0) -> DataFrame:
    named = ix.symbols.where(F.col("symbol") == symbol)
    found = named.join(ix.texts(named.select("file_path")), "file_path")
    part = tx.snippet(F.col("text"), F.col("start_line"), F.col("end_line"), context)
    return found.select("symbol", "kind", "file_path", "start_line", "end_line", part.alias("snippet"), "signature").where("snippet is not null").orderBy("file_path", "start_line", "kind", "end_line")


def outline(ix: Index, file: str) -> DataFrame:
    public = F.coalesce(F.col("signature").startswith("pub"), F.lit(False))
    out = ix.by_file.where(F.col("file_path") == file).select("symbol", "kind", F.col("start_line").alias("line"), "signature", F.when(public, "public").otherwise("private").alias("visibility"))
    return out.orderBy("line", "symbol", "kind")


def status(ix: Index) -> DataFrame:
    """Row counts of the snapshot's tables."""
    out = None
    for name, df in (("source_files", ix.files), ("definitions", ix.symbols), ("references", ix.references), ("text_occurrences", ix.tokens), ("edges", ix.edges)):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def languages(ix: Index) -> DataFrame:
    return ix.symbols.groupBy("language").agg(F.count_distinct("file_path").alias("files")).orderBy("language")


def entry_points(ix: Index, name: str = "main") -> DataFrame:
    return ix.symbols.where((F.col("symbol") == name) & (F.col("kind") == "function")).select("file_path").distinct().orderBy("file_path")


def summary(ix: Index, entry: str = "main") -> DataFrame:
    """status, languages and entry points as one table: section, name, value."""
    counts = status(ix).select(F.lit("status").alias("section"), F.col("table").alias("name"), F.col("rows").alias("value"))
    spoken = languages(ix).select(F.lit("language").alias("section"), F.col("language").alias("name"), F.col("files").alias("value"))
    entries = entry_points(ix, entry).select(F.lit("entry_point").alias("section"), F.col("file_path").alias("name"), F.lit(1).cast("long").alias("value"))
    return counts.unionByName(spoken).unionByName(entries).orderBy("section", "name")


def envelope(result: DataFrame, command: str, version: int = 2) -> DataFrame:
    """One JSON document for each row, in the agent's envelope."""
    meta = F.struct(F.lit(version).alias("version"))
    body = F.struct(F.lit(f"{command}@v{version}").alias("schema"), F.lit(command).alias("command"), F.lit(True).alias("ok"), meta.alias("meta"), F.struct(*result.columns).alias("data"))
    return result.select(F.to_json(body).alias("json"))


def compact(matches: DataFrame) -> DataFrame:
    return matches.select(F.format_string("%s:%d %s", "file_path", "line", "symbol").alias("text"))


#: Documents that the registry lists, in its order.
REGISTERED = ("status", "find", "refs", "resolve", "query", "refactor-plan", "error")


def schema_registry(spark: SparkSession) -> DataFrame:
    """The registered documents; their ids are under this engine's own name."""
    return spark.createDataFrame([(i, c, f"trellis/{c}@v1") for i, c in enumerate(REGISTERED, 1)], "position int, command string, schema string").orderBy("position")


def first_by(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
