"""Diagnostics: health, anatomy, coupling, dead symbols, test gaps, suggestions, boundaries and refactoring checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import workdir
from ..functions import paths, scoring
from ..schemas import Index, picked
from . import graph, lookup


def health_files(ix: Index, top: int = 20, threshold: int = 0) -> DataFrame:
    count = ix.symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"))
    out = ix.files.where(F.coalesce("line_count", F.lit(0)) >= threshold).select("file_path", F.coalesce("line_count", F.lit(0)).alias("line_count"))
    return out.join(count, "file_path", "left").select("file_path", "line_count", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count")).orderBy(F.desc("line_count"), "file_path").limit(top)


def health_functions(ix: Index, top: int = 20, threshold: int = 0) -> DataFrame:
    size = F.coalesce("line_count", F.col("end_line") - F.col("start_line") + 1)
    out = ix.symbols.where(F.col("kind") == "function").select("file_path", "symbol", size.alias("line_count"), "start_line").where(F.col("line_count") >= threshold)
    return out.orderBy(F.desc("line_count"), "file_path", "symbol", "start_line").limit(top)


def save_baseline(report: DataFrame, path: str) -> None:
    """Keep a health report (health_files or health_functions) as the baseline of later ones."""
    report.coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The report kept at path; None where there is none."""
    p, fs = workdir.file_system(spark, path)
    return spark.read.schema("file_path string, symbol string, line_count int, symbol_count long, start_line int").json(path) if fs.exists(p) else None


def health_diff(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of the largest line count between two health reports (line_count)."""
    both = now.select(F.lit(1).alias("new"), "line_count").unionByName(baseline.select(F.lit(0).alias("new"), "line_count"))
    most = lambda new: F.coalesce(F.max(F.when(F.col("new") == new, F.col("line_count"))), F.lit(0))
    return both.agg(most(0).alias("before"), most(1).alias("current")).withColumn("delta", F.col("current") - F.col("before"))


def anatomy(ix: Index, file: str) -> DataFrame:
    """A file's symbols by place, each row with the number of all and of functions."""
    rows = ix.by_file.where(F.col("file_path") == file).select("symbol", "kind", "start_line", "line_count", "file_path")
    whole = Window.partitionBy("file_path")
    rows = rows.withColumns({"total_symbols": F.count("*").over(whole), "function_count": F.count_if(F.col("kind") == "function").over(whole)})
    return rows.orderBy("start_line", "symbol", "kind").drop("file_path")


def coupling(ix: Index, limit: int = 20, scope: str = "all") -> DataFrame:
    """File pairs by edges both ways; the limit comes before the scope, and only pairs with an edge from the smaller name count."""
    e = graph.file_edges(ix)
    back = e.select(F.col("from_file").alias("b_from"), F.col("to_file").alias("b_to"), F.col("edge_count").alias("reverse"))
    both = e.where("from_file < to_file").join(back, (F.col("from_file") == F.col("b_to")) & (F.col("to_file") == F.col("b_from")), "left")
    rows = both.select(F.col("from_file").alias("file_a"), F.col("to_file").alias("file_b"), F.col("edge_count").alias("a_to_b_edges"), F.coalesce("reverse", F.lit(0)).alias("b_to_a_edges"))
    rows = rows.withColumn("total_edges", F.col("a_to_b_edges") + F.col("b_to_a_edges")).orderBy(F.desc("total_edges"), "file_a", "file_b").limit(limit)
    a, b = F.col("file_a"), F.col("file_b")
    if scope == "production":
        rows = rows.where(~paths.is_test_coupling(a) & ~paths.is_test_coupling(b) & ~paths.is_fixture(a) & ~paths.is_fixture(b))
    return rows


def degrees(ix: Index) -> DataFrame:
    return ix.symbols.join(ix.edges.groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.count("*").alias("inbound")), "symbol_id", "left").join(
        ix.edges.groupBy(F.col("from_symbol_id").alias("symbol_id")).agg(F.count("*").alias("outbound")), "symbol_id", "left"
    ).fillna(0, ["inbound", "outbound"])


def _public(df: DataFrame):
    return scoring.is_public(F.col("visibility") if "visibility" in df.columns else F.lit(None).cast("string"), F.col("signature"))


def dead(ix: Index, aggressive: bool = False) -> DataFrame:
    """Symbols that nothing refers to. The conservative mode reports private functions without any edge."""
    kinds = ix.symbols.where(F.col("kind").isin("function", "struct", "enum", "trait"))
    unused = kinds.join(ix.edges.select(F.col("to_symbol_id").alias("symbol_id")), "symbol_id", "left_anti")
    calls_out = ix.edges.select(F.col("from_symbol_id").alias("symbol_id"), F.lit(True).alias("leads_on")).distinct()
    public = _public(ix.symbols)
    leaf = ~public & (F.col("kind") == "function") & F.col("leads_on").isNull()
    rows = unused.join(calls_out, "symbol_id", "left")
    if not aggressive:
        rows = rows.where(leaf)
    label = F.when(leaf, "high").when(~public, "medium").otherwise("low")
    reason = F.when(leaf, "private leaf function has no inbound or outbound symbol edges").when(~public, "private symbol has no inbound symbol edges").otherwise("public/exported symbol has no inbound symbol edges in indexed scope")
    return rows.select("file_path", "symbol", "kind", F.col("start_line").alias("line"), label.alias("confidence"), reason.alias("reason")).orderBy("file_path", "line", "symbol", "kind")


def _mentions(ix: Index, names: DataFrame | None = None) -> DataFrame:
    """In how many test-like files each token (of names, if given) stands."""
    return (ix.tokens if names is None else picked(ix.tokens, "symbol", names)).where(paths.is_test_like(F.col("file_path"))).groupBy("symbol").agg(F.count_distinct("file_path").alias("test_files"))


def test_gaps(ix: Index, target: str, min_risk: str | None = None) -> DataFrame:
    """Functions of a file (a target with /) or name, with the test files that mention them and the state of all together.

    analysis_state counts every function; min_risk, which compares the labels as text, then drops rows.
    """
    some = ix.by_file.where((F.col("kind") == "function") & (F.col("file_path") == target)) if "/" in target else ix.symbols.where((F.col("kind") == "function") & (F.col("symbol") == target))
    rows = some.groupBy("symbol", "line_count").agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("span"))
    rows = rows.join(_mentions(ix, rows.select("symbol")), "symbol", "left").select("symbol", F.coalesce("line_count", "span").alias("line_count"), F.coalesce("test_files", F.lit(0)).alias("test_hits"))
    rows = rows.withColumn("risk", scoring.risk(F.col("line_count"))).withColumn("coverage_status", F.when(F.col("test_hits") > 0, "covered").otherwise("uncovered"))
    rows = workdir.stage(rows, "gaps")
    state = test_gap_state(rows).first().analysis_state
    rows = rows.withColumn("analysis_state", F.lit(state))
    return (rows.where(F.col("risk") >= min_risk) if min_risk else rows).orderBy("symbol", "line_count")


def test_gap_state(gaps: DataFrame) -> DataFrame:
    covered, uncovered = F.count_if(F.col("test_hits") > 0), F.count_if(F.col("test_hits") == 0)
    state = F.when((covered == 0) & (uncovered == 0), "unknown").when(uncovered == 0, "covered").when(covered == 0, "uncovered").otherwise("mixed")
    return gaps.agg(covered.alias("covered"), uncovered.alias("uncovered"), state.alias("analysis_state"))


def suggest(ix: Index, top: int = 10, safe_only: bool = False, min_score: float | None = None) -> DataFrame:
    """Functions of at least 10 lines (null: not) by lines + 5 * fan-in + 20 if no test mentions them."""
    fan = ix.edges.groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.count("*").alias("fan_in"))
    rows = ix.symbols.where("kind = 'function' and line_count >= 10").join(fan, "symbol_id", "left").join(_mentions(ix), "symbol", "left")
    rows = rows.select("symbol", "file_path", "line_count", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce(F.col("test_files") > 0, F.lit(False)).alias("has_tests"), "symbol_id")
    value = F.col("line_count").cast("double") + F.col("fan_in") * F.lit(5.0) + F.when(F.col("has_tests"), 0.0).otherwise(20.0)
    rows = rows.withColumn("refactoring_value", value)
    if safe_only:
        rows = rows.where("has_tests")
    if min_score is not None:
        rows = rows.where(F.col("refactoring_value") >= min_score)
    return rows.orderBy(F.desc("refactoring_value"), "file_path", "symbol", "symbol_id").limit(top).drop("symbol_id")


def boundary(ix: Index, file: str, public_only: bool = False) -> DataFrame:
    """Symbols of a file with their references from other files: public ones first, then the most referred to."""
    mine = ix.by_file.where(F.col("file_path") == file)
    into = picked(ix.edges, "to_symbol_id", mine.select("symbol_id"))
    own = mine.select(F.col("symbol_id").alias("from_symbol_id"))
    refs = into.join(own, "from_symbol_id", "left_anti").groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.count("*").alias("external_references"))
    rows = mine.join(refs, "symbol_id", "left").select("symbol", "kind", _public(mine).alias("is_public"), F.coalesce("external_references", F.lit(0)).alias("external_references"))
    return (rows.where("is_public") if public_only else rows).orderBy(F.desc("is_public"), F.desc("external_references"), "symbol", "kind")


class OutOfRange(ValueError):
    """A refactoring request that the index cannot satisfy."""


def parse_line_range(text: str) -> tuple[int, int]:
    a, dash, b = text.partition("-")
    if not dash or not a.strip().isdigit() or not b.strip().isdigit() or int(a) < 1 or int(a) > int(b):
        raise OutOfRange(f"bad line range: {text}")
    return int(a), int(b)


def parse_changed_line(spec: str) -> tuple[str, int, int]:
    """path:start[:end]; the path may itself hold a colon."""
    import re

    m = re.match(r"^(.*?):(\d+)(?::(\d+))?$", spec)
    if not m or int(m[2]) < 1 or (m[3] and int(m[3]) < int(m[2])):
        raise OutOfRange(f"bad changed line: {spec}")
    return m[1], int(m[2]), int(m[3] or m[2])


def extract_check(ix: Index, symbol: str, start: int, end: int) -> DataFrame:
    """Whether lines start-end of a function can be taken out; empty warnings: yes. Raises where the range lies outside."""
    first = ix.symbols.where((F.col("symbol") == symbol) & (F.col("kind") == "function")).orderBy("file_path", "start_line").limit(1)
    inside = (F.lit(start) >= F.col("start_line")) & (F.lit(end) <= F.col("end_line"))
    whole = (F.col("start_line") == start) & (F.col("end_line") == end)
    warn = F.array_compact(F.array(F.when(whole, "requested range covers entire function"), F.when(F.lit(end - start + 1 < 2), "range is very small; extraction may not be worthwhile")))
    message = F.concat(F.lit(f"extract range {start}-{end} is outside function bounds "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    guard = F.when(inside, F.col("symbol")).otherwise(F.raise_error(message).cast("string"))
    return first.select(
        guard.alias("symbol"), "file_path", F.col("start_line").alias("function_start_line"), F.col("end_line").alias("function_end_line"), F.lit(start).alias("extract_start_line"), F.lit(end).alias("extract_end_line"),
        F.lit(end - start + 1).alias("estimated_line_count"), "signature", F.array_join(warn, "; ").alias("warnings"),
    )


def _counted(**frames: DataFrame) -> DataFrame:
    """One row of counts."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
        out = one if out is None else out.join(one, "k")
    return out.drop("k")


def move_check(ix: Index, symbol: str) -> DataFrame:
    from . import testing

    return _counted(references=lookup.refs(ix, symbol), dependents=graph.impact(ix, symbol), tests=testing.tests_for(ix, symbol, include_support=True))


def rename_check(ix: Index, symbol: str, include_tests: bool = False, include_fixtures: bool = False) -> DataFrame:
    """References (or, without any, text matches) and plain mentions of a name: in all files, and in those in scope."""
    p = F.col("file_path")
    ok = paths.in_rename_scope(p, include_tests or include_fixtures, include_fixtures)
    semantic = lookup.refs(ix, symbol).select(F.lit(1).alias("semantic"), ok.alias("ok"), "file_path")
    lexical = ix.tokens.where(F.col("symbol") == symbol).select(F.lit(0).alias("semantic"), ok.alias("ok"), "file_path")
    is_semantic = F.col("semantic") == 1
    return semantic.unionByName(lexical).agg(
        F.count_if(is_semantic).alias("semantic_total"), F.count_if(is_semantic & F.col("ok")).alias("semantic_in_scope"), F.count_if(~is_semantic).alias("lexical_total"), F.count_if(~is_semantic & F.col("ok")).alias("lexical_in_scope"),
    )


def split_check(ix: Index, file: str, auto: bool = False, groups: str | None = None) -> DataFrame:
    """Symbols and functions of a file that may be split, and the mode asked for."""
    mode = "auto" if auto else "manual" if groups is not None else "none"
    rows = ix.by_file.where(F.col("file_path") == file)
    return rows.agg(F.lit(file).alias("file"), F.lit(mode).alias("mode"), F.count("*").alias("symbol_count"), F.count_if(F.col("kind") == "function").alias("function_count"))


#: What a refactoring may do, and the steps that go with it.
ACTIONS = ("extract", "move", "rename", "split")


def safe_steps(spark: SparkSession, symbol: str, action: str) -> DataFrame:
    """The steps of a refactoring of a symbol, known to the index or not."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    steps = (f"Step 1: Stage the {action} change for {symbol}", "Step 2: Run targeted checks", "Step 3: Run full test suite")
    return spark.createDataFrame([(i, symbol, action, s) for i, s in enumerate(steps, 1)], "position int, symbol string, action string, step string").orderBy("position")


def test_scaffold(ix: Index, symbol: str) -> DataFrame:
    """The signature of a name's first definition (<unknown> without one) beside each test that there is already, or one row without any."""
    from . import testing

    first = ix.symbols.where(F.col("symbol") == symbol).agg(F.min_by(F.struct("signature"), F.struct("file_path", "start_line", "start_column", "kind", "symbol_id")).alias("s")).first().s
    signature = first.signature if first and first.signature is not None else "<unknown>"
    head = ix.symbols.sparkSession.createDataFrame([(symbol, signature)], "symbol string, signature string")
    tests = testing.tests_for(ix, symbol, include_support=True).withColumn("symbol", F.lit(symbol))
    return head.join(tests, "symbol", "left").orderBy(F.desc("runnable"), F.desc("hits"), "target")


def refactor_plan(ix: Index, target: str) -> DataFrame:
    """Three actions for a file or name, each with its confidence and risk, what blocks it, and the facts behind."""
    spark = ix.symbols.sparkSession
    sides = boundary(ix, target).agg(F.count_if("is_public").alias("public"), F.count_if(~F.col("is_public")).alias("internal")).first()
    unused = dead(ix).count()
    gaps = test_gap_state(test_gaps(ix, target)).first()
    covered = gaps.uncovered == 0
    blockers = "coverage state unknown" if gaps.analysis_state == "unknown" else ""
    #: Action, confidence and risk in their order.
    actions = (("analyze-boundary", "high", "low"), ("address-test-gaps", "high" if covered else "medium", "low" if covered else "medium"), ("review-dead-symbols", "medium", "low"))
    rows = [(i, *a, blockers, sides.public, sides.internal, unused, gaps.analysis_state) for i, a in enumerate(actions, 1)]
    return spark.createDataFrame(rows, "priority int, action string, confidence string, risk string, blockers string, boundary_public long, boundary_internal long, dead_candidates long, test_gap_state string").orderBy("priority")
