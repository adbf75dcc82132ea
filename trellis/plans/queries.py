"""Named queries: every operator on the canonical tables, with the parameters that the oracle uses too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, graph, lookup, orient, resolve, testing
from .. import workdir
from ..sources import adapters, repo, snapshot

Query = Callable[[SparkSession, str], DataFrame]
NAME, PART, TASK = "The", "Then", "fix the then andthe order of thation in Erthe"
CALLED = "ai"
ORDER, PART_FN, SUPPLIER, FILE, REGION = "order_7", "part_12", "supplier_3", "src/n3.rs", "region_1"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def star(f: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _rounded(f(adapters.star(spark, sf_dir)))


def corpus(f: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _rounded(f(adapters.corpus(spark, sf_dir)))


ASKED = [(1, "1", "find", NAME), (2, "2", "refs", NAME), (3, "3", "find", "nosuchname"), (4, "4", "find", "thatin"), (5, "5", "drop", "x"), (6, "6", "refs", "ononst")]


def _batch(ix, fail_fast: bool = False) -> DataFrame:
    return lookup.batch(ix, ix.symbols.sparkSession.createDataFrame(ASKED, "position int, id string, command string, symbol string"), fail_fast)


def _changed(ix) -> DataFrame:
    lines = ix.symbols.sparkSession.createDataFrame([(FILE, 100, 160)], "file_path string, start_line int, end_line int")
    return graph.changed_symbols(ix, [FILE], lines)


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = adapters.corpus_files(spark, sf_dir)
    old = files.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return old.select("file_path", "content_hash"), files.where("doc_id % 11 <> 0").select("file_path", "content_hash")


def _tokens_summary(ix) -> DataFrame:
    t = ix.tokens.join(ix.files.select("file_path", "language"), "file_path")
    return t.groupBy("language").agg(F.count("*").alias("tokens"), F.sum("line").alias("lines"), F.sum("column").alias("columns"), F.count_distinct("symbol").alias("names"))


def _edge_summary(ix) -> DataFrame:
    return ix.edges.groupBy("edge_kind", "provenance").agg(F.count("*").alias("edges"), F.sum("from_symbol_id").alias("sources"), F.sum("to_symbol_id").alias("targets"), F.max("confidence").alias("confidence"))


def _symbol_summary(ix) -> DataFrame:
    return ix.symbols.groupBy("language", "kind").agg(F.count("*").alias("symbols"), F.sum("start_column").alias("columns"), F.sum("line_count").alias("lines"), F.count_distinct("symbol").alias("names"))


def _index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction, ids and resolution of the source files in four languages that spell out the supplier table."""
    ix = repo.build(workdir.stage(adapters.code_files(spark, sf_dir), "code"))
    target = ix.symbols.select(F.col("symbol_id").alias("to_symbol_id"), F.col("symbol").alias("calls"), F.col("file_path").alias("calls_in"))
    calls = ix.edges.where("edge_kind = 'calls'").join(target, "to_symbol_id").select(F.col("from_symbol_id").alias("symbol_id"), "calls", "calls_in", "confidence", "provenance")
    return ix.symbols.join(calls, "symbol_id", "left").select("symbol_id", "file_path", "symbol", "kind", "language", "start_line", "end_line", "calls", "calls_in", "confidence", "provenance")


def _built(name: str, tables: tuple[str, ...], make) -> Query:
    """Builds a snapshot anew, whatever is stored, and counts its tables."""
    return lambda spark, sf_dir: snapshot.summary(snapshot.build(spark, sf_dir, name, tables, make, workdir.fresh_path(spark, f"built-{name}")))


def _prune_edges(ix) -> DataFrame:
    """Edges that are left, by kind, when the symbols of two nations' files are gone."""
    left = resolve.prune_edges(ix.edges, ix.symbols.where(~F.col("file_path").isin("src/n3.rs", "src/n4.rs")))
    return left.groupBy("edge_kind").agg(F.count("*").alias("edges"), F.sum("from_symbol_id").alias("sources"))


def queries() -> dict[str, Query]:
    return {
        "hotspots": star(lambda ix: graph.hotspots(ix, 10)),
        "status_counts": corpus(lookup.status),
        "language_files": corpus(lookup.languages),
        "entry_points": corpus(lambda ix: lookup.entry_points(ix, NAME)),
        "health_files": corpus(lambda ix: diagnostics.health_files(ix, 20)),
        "health_functions": star(lambda ix: diagnostics.health_functions(ix, 20)),
        "anatomy": star(lambda ix: diagnostics.anatomy(ix, FILE)),
        "outline": corpus(lambda ix: lookup.outline(ix, "src/src3/d3.ts")),
        "tokens_summary": corpus(_tokens_summary),
        "symbols_summary": corpus(_symbol_summary),
        "find_ast": corpus(lambda ix: lookup.find(ix, NAME)),
        "find_text_fallback": corpus(lambda ix: lookup.find(ix, "thatin")),
        "refs_ast": corpus(lambda ix: lookup.refs(ix, PART)),
        "refs_text_fallback": corpus(lambda ix: lookup.refs(ix, "ononst")),
        "find_scoped": corpus(lambda ix: lookup.find(ix, "wh_he", code_only=True, exclude_tests=True)),
        "find_filtered": corpus(lambda ix: lookup.rank(lookup.find(ix, NAME), scope="tests", language="Rust")),
        "find_in_file": corpus(lambda ix: lookup.rank(lookup.find(ix, NAME), file="./src/src3/d43.rs")),
        "find_qualified": corpus(lambda ix: lookup.find_qualified(ix, f"rust:src/src3/d43.rs::{NAME}", limit=40)),
        "find_compact": corpus(lambda ix: lookup.compact(lookup.find(ix, PART))),
        "find_ranked": corpus(lambda ix: lookup.rank(lookup.find(ix, NAME), 25, exclude=("src/src1/**", "tests/*/d2*_test.rs"), prefer_language="rust", prefer_file="src/src3/d43.rs")),
        "refs_grouped": corpus(lambda ix: lookup.grouped(lookup.refs(ix, PART))),
        "did_you_mean": corpus(lambda ix: lookup.did_you_mean(ix, "ther", 5)),
        "resolve_candidates": corpus(lambda ix: lookup.resolve_candidates(ix, NAME, 50, kind="function")),
        "resolve_filtered": corpus(lambda ix: lookup.resolve_candidates(ix, NAME, scope="production", lang="rust")),
        "batch_query": corpus(_batch),
        "batch_fail_fast": corpus(lambda ix: _batch(ix, fail_fast=True)),
        "snippet": corpus(lambda ix: lookup.snippets(ix, PART, 1)),
        "callers": star(lambda ix: graph.callers(ix, PART_FN)),
        "callees": star(lambda ix: graph.callees(ix, ORDER)),
        "impact": star(lambda ix: graph.impact(ix, SUPPLIER)),
        "impact_ranked": corpus(lambda ix: graph.impact(ix, CALLED, include_fixtures=False)),
        "impact_filtered": corpus(lambda ix: graph.impact(ix, CALLED, include_fixtures=True, scope="production", exclude=("./src/src1/**",))),
        "explain_counts": star(lambda ix: lookup.edge_counts(ix, SUPPLIER)),
        "explain_snippet": corpus(lambda ix: lookup.edge_counts(ix, PART, with_snippet=True).select("symbol", "file_path", "start_line", "qualified_symbol", "in_called_by", "out_calls", "snippet")),
        "related": star(lambda ix: graph.related(ix, PART_FN)),
        "deps": star(lambda ix: graph.dependencies(ix, FILE)),
        "file_graph": star(graph.file_edges),
        "coupling": star(lambda ix: diagnostics.coupling(ix, 20)),
        "coupling_production": corpus(lambda ix: diagnostics.coupling(ix, 40, scope="production")),
        "boundary": star(lambda ix: diagnostics.boundary(ix, FILE)),
        "boundary_public": star(lambda ix: diagnostics.boundary(ix, FILE, public_only=True)),
        "dead_conservative": corpus(diagnostics.dead),
        "dead_aggressive": corpus(lambda ix: diagnostics.dead(ix, aggressive=True)),
        "tests_for": corpus(lambda ix: testing.tests_for(ix, "the_then", include_support=True)),
        "test_gaps": corpus(lambda ix: diagnostics.test_gaps(ix, "src/src5/d25.rs")),
        "test_gaps_risk": corpus(lambda ix: diagnostics.test_gaps(ix, NAME, min_risk="low")),
        "suggest": star(lambda ix: diagnostics.suggest(ix, 10)),
        "rename_check": corpus(lambda ix: diagnostics.rename_check(ix, PART)),
        "rename_check_tests": corpus(lambda ix: diagnostics.rename_check(ix, "ononst", include_tests=True)),
        "move_check": corpus(lambda ix: diagnostics.move_check(ix, PART)),
        "split_check": star(lambda ix: diagnostics.split_check(ix, FILE)),
        "extract_check": star(lambda ix: diagnostics.extract_check(ix, ORDER, 22, 29)),
        "test_scaffold": corpus(lambda ix: diagnostics.test_scaffold(ix, PART)),
        "refactor_plan": corpus(lambda ix: diagnostics.refactor_plan(ix, "src/src5/d25.rs")),
        "refactor_plan_unknown": star(lambda ix: diagnostics.refactor_plan(ix, "src/none.rs")),
        "safe_steps": lambda spark, sf_dir: diagnostics.safe_steps(spark, ORDER, "move"),
        "verify_plan": corpus(lambda ix: testing.verify_plan(ix, ["src/src5/d25.rs", "tests/src1/d1.rs"], runners=testing.Runners(pytest=True, node="jest"))),
        "context_direct": corpus(lambda ix: orient.context(ix, TASK, 6000, neighbours=False)),
        "context_full": corpus(lambda ix: orient.context(ix, TASK, 12000, exclude_tests=True)),
        "diff_impact": star(lambda ix: graph.diff_impact(ix, ix.symbols.where(F.col("symbol").isin(SUPPLIER, PART_FN)), 3, None)),
        "diff_impact_lines": star(lambda ix: graph.diff_impact(ix, _changed(ix), 2, 30)),
        "diff_impact_tests": corpus(lambda ix: graph.diff_impact(ix, graph.changed_symbols(ix, ["src/src5/d25.rs"]), 2, None, exclude_changed=True, with_tests=True)),
        "call_path": corpus(lambda ix: graph.call_path(ix, NAME, "Of", 6)),
        "diff_impact_names": star(lambda ix: graph.diff_impact(ix, graph.changed_symbols(ix, [FILE], names=[SUPPLIER, "nation_3"]), 2, 40)),
        "circular": star(graph.circular),
        "circular_wide": star(lambda ix: graph.circular(ix, 1000)),
        "circular_corpus": corpus(lambda ix: graph.circular(ix, 1_000_000)),
        "cycle_edges": corpus(lambda ix: graph.cycle_edges(ix, 1_000_000)),
        "tree": corpus(lambda ix: orient.tree(ix, 3)),
        "tree_shallow": corpus(lambda ix: orient.tree(ix, 2, deps=False)),
        "tree_focus": star(lambda ix: orient.tree(ix, 3, "src/brand")),
        "tree_symbols": star(lambda ix: orient.tree(ix, 3, "src/brand", deps=False, symbols=True).select("path", "kind", F.transform("symbols", lambda x: x["symbol"]).alias("names")).select("path", "kind", F.array_join("names", ",").alias("names"))),
        "orient": star(orient.orient),
        "orient_recommendations": star(orient.recommendations),
        "edge_resolution": corpus(_edge_summary),
        "incremental_diff": lambda spark, sf_dir: resolve.changes(*_old_and_new(spark, sf_dir)),
        "to_index": lambda spark, sf_dir: resolve.to_index(*_old_and_new(spark, sf_dir)).select("file_path"),
        "stale_prune": lambda spark, sf_dir: resolve.prune(*_old_and_new(spark, sf_dir)).select("file_path"),
        "prune_edges": star(_prune_edges),
        "index_sources": _index_sources,
        "index_corpus": _built("corpus", adapters.CORPUS_TABLES, adapters.corpus_index),
        "index_star": _built("star", adapters.STAR_TABLES, adapters.star_index),
        "summary": corpus(lambda ix: lookup.summary(ix, NAME)),
        "schema_registry": lambda spark, sf_dir: lookup.schema_registry(spark),
        "json_envelope": star(lambda ix: lookup.envelope(graph.callees(ix, ORDER).select("symbol"), "callees")),
    }
