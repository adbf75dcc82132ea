"""Predicates and ranks of file paths, as column expressions.

The test-path variants differ on purpose: each command has its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"\.(rs|tsx?|py|go)$"
TEST_NAME = r"(^|/)([^/]*_test\.(rs|go|py)|[^/]*_tests\.py|test_[^/]*\.py|[^/]*\.(test|spec)\.tsx?)$"
TEST_NAME_COUPLING = r"(^|/)([^/]*_test\.(rs|py)|[^/]*_tests\.py|test_[^/]*|[^/]*\.(test|spec)\.ts)$"


def is_code(p: Column) -> Column:
    return p.rlike(CODE)


def is_test(p: Column) -> Column:
    """Variant A: find, refs, impact, tests-for."""
    return p.startswith("tests/") | p.contains("/tests/") | p.rlike(TEST_NAME)


def is_test_coupling(p: Column) -> Column:
    """Variant B: coupling."""
    return p.startswith("tests/") | p.contains("/tests/") | p.rlike(TEST_NAME_COUPLING)


def is_test_like(p: Column) -> Column:
    """Variant C: test-gaps and suggest; case-insensitive, `_` stands for any character."""
    return p.ilike("tests/%") | p.ilike("%_test.%")


def is_test_group(p: Column) -> Column:
    """Variant D: grouped output."""
    return p.startswith("tests/") | p.contains("_test.") | p.contains(".test.")


def is_fixture(p: Column) -> Column:
    return p.startswith("tests/fixtures/") | p.contains("/tests/fixtures/")


def in_scope(p: Column, scope: str) -> Column:
    """all, production (code that is no test) or tests."""
    if scope == "production":
        return is_code(p) & ~is_test(p)
    return is_test(p) if scope == "tests" else F.lit(True)


def in_rename_scope(p: Column, include_tests: bool, include_fixtures: bool) -> Column:
    ok = F.lit(True)
    if not include_fixtures:
        ok = ok & ~is_fixture(p)
    return ok if include_tests else ok & ~is_test(p)


def query_scope(p: Column, code_only: bool = False, exclude_tests: bool = False) -> Column:
    ok = F.lit(True)
    if code_only:
        ok = ok & is_code(p)
    if exclude_tests:
        ok = ok & ~is_test(p)
    return ok


def language(p: Column) -> Column:
    low = F.lower(p)
    return F.when(low.endswith(".rs"), "rust").when(low.rlike(r"\.tsx?$"), "typescript").when(low.endswith(".py"), "python").when(low.endswith(".go"), "go").otherwise("unknown")


def class_rank(p: Column) -> Column:
    """0 code, 1 test, 2 other."""
    return F.when(is_test(p), 1).when(is_code(p), 0).otherwise(2)


def priority_rank(p: Column, include_fixtures: bool = False) -> Column:
    """0 code, 1 test, 2 fixture unless included, 3 other."""
    fixture = F.lit(False) if include_fixtures else is_fixture(p)
    return F.when(is_test(p), F.when(fixture, 2).otherwise(1)).when(is_code(p), 0).otherwise(3)


def normalized(p: Column) -> Column:
    """Forward slashes, trimmed, without leading ./ and then /."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.replace(p, F.lit("\\"), F.lit("/"))), r"^(\./)+", ""), "^/+", "")


def glob_regex(glob: str) -> str:
    """An exclude glob as a regular expression: dir/**, exact, or segments matched leftmost first, without backtracking."""
    if glob.endswith("/**"):
        return f"^{re.escape(glob[:-3].rstrip('/'))}(/.*)?$"
    if "*" not in glob:
        return f"^{re.escape(glob)}$"
    parts = [p for p in glob.split("*") if p]
    if not parts:
        return "^.*$"
    tail = "" if glob.endswith("*") else "$"
    return "^" + re.escape(parts[0]) + "".join(f"(?>.*?{re.escape(p)})" for p in parts[1:]) + tail


def excluded(p: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs, both normalised."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | normalized(p).rlike(glob_regex(re.sub(r"^(\./)+", "", g.replace("\\", "/").strip()).lstrip("/")))
    return hit
