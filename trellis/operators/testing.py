"""Tests of a symbol, and the verification plan of a change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..functions import text as tx
from ..schemas import Index, picked
from .graph import changed_symbols
from .lookup import first_by


@dataclass
class Runners:
    """Test runners that the repository configures."""

    pytest: bool = False
    node: str | None = None  # jest or vitest


def probe_runners(files: DataFrame) -> Runners:
    """Runners by configuration files (file_path, text); both node runners signalled: neither."""
    p, t = F.col("file_path"), F.col("text")
    py = (p == "pytest.ini") | ((p == "pyproject.toml") & t.contains("[tool.pytest")) | ((p == "tox.ini") & t.contains("[pytest]")) | ((p == "setup.cfg") & t.contains("[tool:pytest]"))
    script = F.coalesce(F.get_json_object(t, "$.scripts.test"), F.lit(""))
    uses = lambda name: (p == "package.json") & (script.rlike(rf"\b{name}\b") | F.get_json_object(t, f"$.devDependencies.{name}").isNotNull() | F.get_json_object(t, f"$.dependencies.{name}").isNotNull())
    r = files.where(p.isin("pytest.ini", "pyproject.toml", "tox.ini", "setup.cfg", "package.json")).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for c, n in ((py, "py"), (uses("jest"), "jest"), (uses("vitest"), "vitest"))]).first()
    return Runners(r.py, "jest" if r.jest and not r.vitest else "vitest" if r.vitest and not r.jest else None)


def test_command(p: Column, runners: Runners) -> Column:
    """The command that runs one test file; null where there is none."""
    name = F.substring_index(p, "/", -1)
    out = F.when(p.rlike(r"^tests/[^/]+\.rs$"), F.concat(F.lit("cargo test --test "), F.regexp_extract(p, r"^tests/([^/]+)\.rs$", 1)))
    if runners.pytest:
        out = out.when(name.rlike(r"^(test_.*|.*_tests?)\.py$"), F.concat(F.lit("pytest "), p))
    folder = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    out = out.when(name.endswith("_test.go"), F.concat(F.lit("go test "), F.when(folder == "", F.lit(".")).otherwise(F.concat(F.lit("./"), folder))))
    if runners.node:
        run = "npx jest --runTestsByPath " if runners.node == "jest" else "npx vitest run "
        out = out.when(name.rlike(r"\.(test|spec)\.tsx?$"), F.concat(F.lit(run), p))
    return out


def hits(ix: Index, names: DataFrame) -> DataFrame:
    """Mentions of names (symbol) in test files: symbol, file_path, hits."""
    return picked(ix.tokens, "symbol", names.select("symbol")).where(paths.is_test(F.col("file_path"))).groupBy("symbol", "file_path").agg(F.count("*").alias("hits"))


def tests_for(ix: Index, symbol: str, include_support: bool = False, runners: Runners = Runners()) -> DataFrame:
    """Test files that mention a name or, less, a part of it: runnable ones first, then by hits."""
    parts = [w for w in symbol.split("_") if len(w) >= 3]
    names = ix.symbols.sparkSession.createDataFrame([(symbol, 0)] + [(w, i + 1) for i, w in enumerate(dict.fromkeys(parts)) if w != symbol], "symbol string, turn int")
    found = hits(ix, names).join(names, "symbol")
    found = first_by(found, ["file_path"], ["turn"])
    n = F.when(F.col("turn") == 0, F.col("hits")).otherwise(F.greatest(F.col("hits") - 1, F.lit(1)))
    runnable = test_command(F.col("file_path"), runners).isNotNull()
    rows = found.select(F.col("file_path").alias("target"), n.alias("hits"), runnable.alias("runnable"))
    if not include_support:
        rows = rows.where("runnable")
    label = F.when(F.col("runnable") & (F.col("hits") > 1), "graph_likely").otherwise("context_medium")
    kind = F.when(F.col("runnable"), "integration_test_file").otherwise("support_test_file")
    why = F.concat(F.lit(f"direct symbol match for '{symbol}' in "), F.when(F.col("runnable"), "test file").otherwise("support path"))
    out = rows.select("target", kind.alias("target_kind"), why.alias("why_included"), label.alias("confidence"), scoring.tests_for_score(F.col("runnable"), F.col("hits")).alias("score"), "hits", "runnable")
    return out.orderBy(F.desc("runnable"), F.desc("hits"), "target")


def verify_plan(ix: Index, files: list[str], lines: DataFrame | None = None, names: list[str] = (), max_targeted: int = 8, runners: Runners = Runners()) -> DataFrame:
    """Targeted test commands for changed files, the best reason of each, and the full suite last; changed tests are not capped."""
    spark = ix.symbols.sparkSession
    changed = changed_symbols(ix, files, lines, names, include_imports=True)
    changed = changed.where(~F.lower("symbol").isin(tx.GENERIC)).select("symbol").distinct()
    found = hits(ix, changed).withColumn("step", test_command(F.col("file_path"), runners)).where("step is not null")
    by_symbol = found.select(
        "step", F.lit(1).alias("turn"), F.concat(F.lit("targeted test references changed symbol '"), "symbol", F.lit("'")).alias("why_included"),
        F.when(F.col("hits") > 1, "graph_likely").otherwise("context_medium").alias("confidence"), F.when(F.col("hits") > 1, 0.9).otherwise(0.8).alias("score"),
    )
    own = spark.createDataFrame([(f,) for f in files], "file_path string").withColumn("step", test_command(F.col("file_path"), runners)).where("step is not null")
    by_file = own.select("step", F.lit(0).alias("turn"), F.concat(F.lit("changed file '"), "file_path", F.lit("' is itself a test target")).alias("why_included"), F.lit("context_high").alias("confidence"), F.lit(0.95).alias("score"))
    best = first_by(by_symbol.unionByName(by_file), ["step"], [F.desc("score"), scoring.confidence_rank(F.col("confidence")).desc(), "why_included"])
    rest = best.where("turn = 1").orderBy(F.desc("score"), scoring.confidence_rank(F.col("confidence")).desc(), "step", "why_included").limit(max_targeted)
    targeted = best.where("turn = 0").unionByName(rest)
    has = lambda prefix: F.coalesce(F.bool_or(F.col("step").startswith(prefix)), F.lit(False))
    ends = lambda *ext: F.lit(any(f.endswith(ext) for f in files))
    suite = F.when(has("cargo test") | ends(".rs"), "cargo test")
    if runners.pytest:
        suite = suite.when(has("pytest ") | ends(".py"), "pytest")
    if runners.node:
        suite = suite.when(has("npx ") | ends(".ts", ".tsx"), "npx jest" if runners.node == "jest" else "npx vitest run")
    suite = suite.when(has("go test ") | ends(".go"), "go test ./...").otherwise("cargo test")
    full = targeted.agg(suite.alias("step")).select("step", F.lit("full_suite").alias("scope"), F.lit("required safety gate after refactor").alias("why_included"), F.lit("context_high").alias("confidence"), F.lit(1.0).alias("score"))
    return targeted.select("step", F.lit("targeted").alias("scope"), "why_included", "confidence", "score").unionByName(full).orderBy((F.col("scope") == "full_suite").cast("int"), "step", "why_included")
