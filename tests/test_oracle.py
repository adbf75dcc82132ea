"""Every query against its independent SQL, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from trellis.plans import oracle, queries

SF = "/root/testdata/sf0.001"
RANKED = '"score" DESC, CASE WHEN {t} THEN 1 WHEN {c} THEN 0 ELSE 2 END, file_path, line, "column", symbol, why_matched'.format(t=oracle.TEST, c=oracle.CODE)
PRIORITY = f"{oracle.PRIORITY}, file_path, "
BY_SCORE = 'score DESC, file_path, line, "column", symbol, relationship'
DIFF = 'score DESC, result_kind, file_path NULLS FIRST, line, "column", qualified_symbol, target_kind, target, relationship, distance, kind'
#: The order in which a query gives its rows.
SEQUENCES = {
    "find_ast": RANKED, "refs_ast": RANKED, "find_text_fallback": RANKED, "find_scoped": RANKED, "find_filtered": RANKED, "batch_query": f"position, {RANKED}", "impact": BY_SCORE, "impact_filtered": BY_SCORE,
    "impact_ranked": f"score DESC, {PRIORITY} line, \"column\", symbol, relationship", "callers": f'{PRIORITY} line, "column", symbol, kind', "callees": f'{PRIORITY} line, "column", symbol, kind',
    "related": f"{PRIORITY} symbol, relationship, kind", "hotspots": "total DESC, file_path, symbol", "deps": "direction DESC, edge_count DESC, file_path", "health_files": "line_count DESC, file_path",
    "health_functions": "line_count DESC, file_path, symbol", "coupling": "total_edges DESC, file_a, file_b", "dead_conservative": "file_path, line, symbol, kind", "dead_aggressive": "file_path, line, symbol, kind",
    "suggest": "refactoring_value DESC, file_path, symbol", "boundary": "is_public DESC, external_references DESC, symbol, kind", "circular_wide": "n_files, files", "circular_corpus": "n_files, files",
    "cycle_edges": "len(string_split(files, ',')), files, from_file, from_symbol, to_file, to_symbol, edge_kind", "tests_for": "runnable DESC, hits DESC, target", "verify_plan": "scope = 'full_suite', step, why_included",
    "diff_impact": DIFF, "diff_impact_lines": DIFF, "diff_impact_tests": DIFF.replace("file_path NULLS FIRST", "file_path"), "outline": "line, symbol, kind", "anatomy": "start_line, symbol, kind", "snippet": "file_path, start_line, kind, end_line",
    "entry_points": "file_path", "language_files": "language", "resolve_candidates": "recommended DESC, symbol <> 'The', symbol, file_path, line", "context_full": "score DESC, file_path, start_line, symbol, kind, end_line, why_included",
    "explain_counts": "file_path, start_line, start_column, qualified_symbol, kind", "refactor_plan": "priority", "safe_steps": "position", "schema_registry": "position", "call_path": "position", "orient": "section, position",
    "tree": "list_transform(CASE WHEN depth = 0 THEN []::VARCHAR[] ELSE string_split(path, '/') END, lambda x, i: CASE WHEN kind = 'file' AND i = depth THEN '1' ELSE '0' END || x)",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = oracle.oracle_sql()[name]
    if name in SEQUENCES:
        sql = f"SELECT * FROM ({sql}) ORDER BY {SEQUENCES[name]}"
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if name in SEQUENCES:
        assert got == want
