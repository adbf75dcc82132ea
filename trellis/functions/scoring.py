"""Calibrated scores and labels, as column expressions in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of a relationship by where the edge comes from; None: any other relationship.
SCORES = {
    ("call_resolution", "called_by"): 0.97, ("import_resolution", "imported_by"): 0.95, ("ast_reference", "implemented_by"): 0.94, ("ast_definition", "contained_by"): 0.94,
    ("call_resolution", None): 0.95, ("import_resolution", None): 0.94, ("ast_reference", None): 0.93, ("ast_definition", None): 0.93, ("text_fallback", None): 0.72,
}
OTHER = 0.90
PROVENANCES = ("ast_definition", "ast_reference", "import_resolution", "call_resolution", "text_fallback")
INBOUND = {"calls": "called_by", "contains": "contained_by", "imports": "imported_by", "implements": "implemented_by"}


def d(x: float) -> Column:
    return F.lit(float(x))


def relationship(kind: Column, default: Column | None = None) -> Column:
    """called_by and so on; an unknown kind stands for itself, or for default."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in INBOUND.items():
        out = out.when(kind == k, v)
    return out.otherwise(kind if default is None else default)


def normalized_provenance(provenance: Column, kind: Column) -> Column:
    implied = F.when(kind == "calls", "call_resolution").when(kind == "imports", "import_resolution").when(kind == "contains", "ast_definition").otherwise("ast_reference")
    return F.when(provenance.isin(*PROVENANCES), provenance).otherwise(implied)


def semantic_score(provenance: Column, relation: Column, distance: Column) -> Column:
    base = F.when(F.lit(False), d(0))
    for (p, r), s in SCORES.items():
        base = base.when(provenance == p if r is None else (provenance == p) & (relation == r), d(s))
    return F.greatest(d(0), F.least(d(1), base.otherwise(d(OTHER)) - d(0.01) * F.greatest(distance - 1, F.lit(0))))


def semantic_confidence(provenance: Column) -> Column:
    return F.when(provenance == "text_fallback", "context_medium").when(provenance.isin(*PROVENANCES), "graph_likely").otherwise("context_low")


def context_score(overlap: Column, tokens: Column, exact: Column) -> Column:
    return F.least(d(0.98), d(0.62) + d(0.09) * overlap + d(0.04) * F.least(tokens, F.lit(4)) + d(0.04) * exact)


def test_target_score(hits: Column) -> Column:
    return F.when(hits > 1, d(0.84)).otherwise(d(0.70))


def test_target_label(hits: Column) -> Column:
    return F.when(hits > 1, "graph_likely").otherwise("context_medium")


def tests_for_score(runnable: Column, hits: Column) -> Column:
    return F.when(runnable, F.when(hits > 1, d(0.90)).otherwise(d(0.75))).otherwise(F.when(hits > 1, d(0.62)).otherwise(d(0.58)))


def confidence_rank(label: Column) -> Column:
    return F.when(label == "graph_likely", 3).when(label == "context_high", 2).when(label == "context_medium", 1).otherwise(0)


def preference(score: Column, path: Column, include_fixtures: bool = False, prefer_file: str | None = None, prefer_language: str | None = None) -> Column:
    """Score by the caller's preferences, never below 0."""
    from . import paths

    if not include_fixtures:
        score = score - F.when(paths.is_fixture(path), d(0.25)).when(paths.is_test(path), d(0.10)).otherwise(d(0))
    if prefer_file:
        score = score + F.when(path == prefer_file, d(0.30)).otherwise(d(0))
    if prefer_language:
        score = score + F.when(paths.language(path) == prefer_language, d(0.15)).otherwise(d(0))
    return F.greatest(d(0), score)


def risk(lines: Column) -> Column:
    return F.when(lines > 80, "high").when(lines > 30, "medium").otherwise("low")


def is_public(visibility: Column, signature: Column) -> Column:
    return F.coalesce(visibility.isin("public", "pub", "export") | signature.ilike("pub %") | signature.ilike("pub(%"), F.lit(False))
