import pytest
from pyspark.sql import functions as F

from trellis.functions import paths, scoring
from trellis.functions import text as tx
from trellis.operators import diagnostics, graph, lookup, orient, resolve, testing
from trellis.schemas import EDGES, SYMBOLS, TOKENS, Index


def index(spark, symbols=(), edges=(), tokens=(), files=()):
    """symbols: (id, file, name, kind, start, end[, signature])."""
    rows = [(s[0], s[1], s[2], s[3], "rust", f"rust:{s[1]}::{s[2]}", None, s[4], 1, s[5], 2, s[6] if len(s) > 6 else None, s[5] - s[4] + 1) for s in symbols]
    t = spark.createDataFrame([(f, n, line, 1) for f, n, line in tokens], TOKENS)
    return Index(spark.createDataFrame([(p, "h", len(x.split("\n")), x) for p, x in files], "file_path string, content_hash string, line_count int, text string"), t, spark.createDataFrame(rows, SYMBOLS), t, spark.createDataFrame(list(edges), EDGES))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def edge(a, b, kind="calls", provenance="call_resolution"):
    return a, b, kind, 0.95, provenance


def test_text_fallback_and_scope(spark):
    files = ["src/lib.rs", "pkg/app.tsx", "svc/main.go", "tests/test_example.py", "docs/readme.md"]
    ix = index(spark, tokens=[(f, "needle", 1) for f in files] + [("src/lib.rs", "needle_suffix", 2)])
    assert lookup.find(ix, "needle").count() == 6 and lookup.refs(ix, "needle").count() == 5 and lookup.text_matches(ix, "needle").count() == 6
    assert lookup.find(ix, "needle", code_only=True, exclude_tests=True).count() == 4


def test_explain_ignores_unknown_kinds(spark):
    kinds = ["calls", "imports", "implements", "contains", "mystery"]
    ix = index(spark, [(1, "src/a.rs", "target", "function", 1, 5), (2, "src/b.rs", "other", "function", 1, 5)], [edge(2, 1, k) for k in kinds] + [edge(1, 2, k) for k in kinds])
    row = lookup.edge_counts(ix, "target").first()
    assert [row[c] for c in row.asDict() if c.startswith(("in_", "out_"))] == [1] * 8


@pytest.mark.parametrize("kind,relation,score", [("implements", "implemented_by", 0.94), ("mystery", "mystery", 0.93)])
def test_impact_of_unknown_kinds(spark, kind, relation, score):
    ix = index(spark, [(1, "src/a.rs", "target", "function", 1, 5), (2, "src/b.rs", "user", "function", 1, 5)], [(2, 1, kind, 1.0, "?")])
    row = graph.impact(ix, "target").first()
    assert (row.relationship, row.score, row.confidence) == (relation, score, "graph_likely")


def test_keywords(spark):
    assert one(spark, tx.task_keywords(F.lit("Fix the HTTPServer and io in parser with parser"))) == ["fix", "httpserver", "parser"]
    assert one(spark, tx.symbol_keywords(F.lit("HTTPServer::do_work + parseJSON"))) == ["httpserver", "json", "parse", "work"]
    ix = index(spark, [(1, "src/a.rs", "needle", "function", 1, 2)])
    assert orient.context(ix, "the and with").count() == 0


def test_tokens(spark):
    files = spark.createDataFrame([("a", "alpha beta_2\n3gamma _delta é x")], "file_path string, text string")
    got = [(r.symbol, r.line, r.column) for r in tx.tokens(files).orderBy("line", "column").collect()]
    assert got == [("alpha", 1, 1), ("beta_2", 1, 7), ("_delta", 2, 8), ("x", 2, 18)]


def test_paths(spark):
    p = lambda f, *a: one(spark, f(F.lit(a[0])))
    assert p(paths.is_test, "pkg/x_test.go") and not p(paths.is_test, "src/latest.rs")
    assert p(paths.is_test_like, "src/latest.rs") and not p(paths.is_test_coupling, "a/x_test.go") and p(paths.is_test_coupling, "a/test_any")
    assert p(paths.normalized, " .\\./a//b ") == "a//b"
    assert [p(paths.language, x) for x in ("a.rs", "b.tsx", "c.py", "d.go", "e.md")] == ["rust", "typescript", "python", "go", "unknown"]
    glob = lambda g, x: one(spark, F.lit(x).rlike(paths.glob_regex(g)))
    assert glob("src/**", "src") and glob("src/**", "src/a/b") and not glob("src/**", "srcs/a")
    assert glob("a*b", "aXXb") and not glob("a*b", "aXbYb") and glob("a*c*", "abcd")


def test_preferences_and_scores(spark):
    assert one(spark, scoring.preference(F.lit(0.2), F.lit("tests/fixtures/a.rs"))) == 0.0
    assert one(spark, F.round(scoring.preference(F.lit(0.8), F.lit("src/a.rs"), prefer_file="src/a.rs", prefer_language="rust"), 6)) == 1.25
    assert one(spark, F.round(scoring.semantic_score(F.lit("call_resolution"), F.lit("called_by"), F.lit(3)), 6)) == 0.95
    assert one(spark, scoring.context_score(F.lit(9), F.lit(9), F.lit(1))) == 0.98


def test_resolution_tiers(spark):
    symbols = index(spark, [(1, "src/a.rs", "run", "function", 1, 2), (2, "src/b.rs", "run", "function", 1, 2), (3, "src/b.rs", "only", "function", 4, 5), (4, "src/c.rs", "imp", "import", 1, 1), (5, "src/c.rs", "go", "function", 3, 4)]).symbols
    schema = "from_symbol_id long, file_path string, symbol string, language string, edge_kind string, confidence double, provenance string, qualified_symbol string"
    rows = [(5, "src/c.rs", "run", "rust", "calls", 0.95, "p", None), (5, "src/c.rs", "run", "rust", "calls", 0.95, "p", "rust:src/b.rs::run"), (5, "src/c.rs", "only", "rust", "calls", 0.95, "p", None), (5, "src/c.rs", "imp", "rust", "imports", 0.9, "p", None), (5, "src/c.rs", "go", "rust", "calls", 0.9, "p", None)]
    got = resolve.resolve(spark.createDataFrame(rows, schema), symbols)
    assert {(r.from_symbol_id, r.to_symbol_id) for r in got.collect()} == {(5, 2), (5, 3)}


def test_ids_stay(spark):
    ix = index(spark, [(7, "a.rs", "x", "function", 5, 6), (9, "a.rs", "x", "function", 8, 9), (4, "b.rs", "y", "function", 1, 2)])
    new = index(spark, [(0, "a.rs", "x", "function", 1, 2), (0, "a.rs", "z", "function", 3, 4), (0, "b.rs", "y", "function", 9, 9), (0, "a.rs", "w", "function", 30, 31)]).symbols.drop("symbol_id")
    got = {(r.symbol, r.start_line): r.symbol_id for r in resolve.stable_ids(ix.symbols, new).collect()}
    assert got == {("x", 1): 7, ("y", 9): 4, ("z", 3): 10, ("w", 30): 11}


def test_diff_impact(spark):
    ix = index(spark, [(i, f"src/{n}.rs", n, "function", 1, 5) for i, n in enumerate("abcde", 1)], [edge(1, 2), edge(2, 3), edge(4, 3), edge(3, 1)], [("tests/a_test.rs", "b", 1), ("tests/a_test.rs", "b", 2)])
    seeds = ix.symbols.where("symbol = 'c'")
    got = {(r.symbol, r.distance) for r in graph.diff_impact(ix, seeds, 2).collect()}
    assert got == {("c", 0), ("b", 1), ("d", 1), ("a", 2)}
    assert graph.diff_impact(ix, seeds, 2, limit=2).count() == 2
    assert {r.symbol for r in graph.diff_impact(ix, seeds, 1, exclude_changed=True).collect()} == {"b", "d"}
    tests = graph.diff_impact(ix, seeds, 1, with_tests=True).where("result_kind = 'test_target'").first()
    assert (tests.target, tests.score) == ("tests/a_test.rs", 0.84)


def test_call_path(spark):
    ix = index(spark, [(i, "src/a.rs", n, "function", i, i) for i, n in enumerate(["s", "b", "a", "t"], 1)], [edge(1, 2), edge(1, 3), edge(2, 4), edge(3, 4), edge(4, 1)])
    assert [r.symbol for r in graph.call_path(ix, "s", "t").orderBy("position").collect()] == ["s", "a", "t"]
    assert graph.call_path(ix, "s", "t", 1).count() == 0 and graph.call_path(ix, "x", "t").count() == 0


def test_cycles_both_ways(spark, tmp_path):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")]
    df = spark.createDataFrame(pairs, "from_file string, to_file string")
    want = {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert {tuple(r) for r in graph.strong_components(df).collect()} == want
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert {frozenset(r.node for r in graph.strong_components(df, 0).collect() if r.component == c) for c in {r.component for r in graph.strong_components(df, 0).collect()}} == {frozenset("abc"), frozenset("de")}


def test_small_cycles_with_their_edges(spark):
    symbols = [(i, f"src/{f}.rs", f, "function", 1, 5) for i, f in enumerate("abcdefg", 1)]
    # a <-> b by two kinds, c -> d -> e -> c, f -> g is none
    ix = index(spark, symbols, [edge(1, 2), edge(2, 1), edge(1, 2, "imports"), edge(3, 4), edge(4, 5), edge(5, 3), edge(2, 3), edge(6, 7)])
    ab, cde = "src/a.rs,src/b.rs", "src/c.rs,src/d.rs,src/e.rs"
    assert {tuple(r) for r in graph.circular(ix).collect()} == {(ab, 2, 3, 2), (cde, 3, 3, 2)}
    row = lambda files, x, y, kind="calls": (files, f"src/{x}.rs", x, f"src/{y}.rs", y, kind)
    want = [row(ab, "a", "b"), row(ab, "a", "b", "imports"), row(ab, "b", "a"), row(cde, "c", "d"), row(cde, "d", "e"), row(cde, "e", "c")]
    assert sorted(tuple(r) for r in graph.cycle_edges(ix).collect()) == want
    assert {r[1] for r in map(tuple, graph.cycle_edges(ix, 2).collect())} == {"src/a.rs", "src/b.rs"} and graph.cycle_edges(ix, 1).count() == 0
    assert [r.files for r in graph.circular(ix).collect()] == [ab, cde]
    assert {r.message for r in orient.recommendations(ix).where("kind = 'cycle_warning'").collect()} == {"2 circular dependency cycles detected"}


def test_dead_coupling_gaps(spark):
    ix = index(spark, [(1, "src/a.rs", "p", "function", 1, 100, "fn p"), (2, "src/a.rs", "q", "function", 1, 40, "pub fn q"), (3, "src/b.rs", "S", "struct", 1, 2), (4, "tests/x.rs", "t", "function", 1, 3, "fn t")], [edge(4, 3), edge(3, 4), edge(3, 4, "imports")], [("tests/x.rs", "q", 1)])
    assert {r.symbol for r in diagnostics.dead(ix).collect()} == {"p"}
    assert {(r.symbol, r.confidence) for r in diagnostics.dead(ix, True).collect()} == {("p", "high"), ("q", "low")}
    pair = diagnostics.coupling(ix).first()
    assert (pair.file_a, pair.a_to_b_edges, pair.b_to_a_edges, pair.total_edges) == ("src/b.rs", 2, 1, 3)
    assert diagnostics.coupling(ix, scope="production").count() == 0
    gaps = diagnostics.test_gaps(ix, "src/a.rs")
    assert {(r.symbol, r.risk, r.coverage_status) for r in gaps.collect()} == {("p", "high", "uncovered"), ("q", "medium", "covered")}
    assert diagnostics.test_gap_state(gaps).first().analysis_state == "mixed"
    assert diagnostics.test_gaps(ix, "src/a.rs", "medium").count() == 1


def test_extract_check(spark):
    ix = index(spark, [(1, "src/a.rs", "f", "function", 10, 20, "fn f")])
    assert diagnostics.extract_check(ix, "f", 10, 20).first().warnings == "requested range covers entire function"
    assert "very small" in diagnostics.extract_check(ix, "f", 12, 12).first().warnings
    with pytest.raises(Exception, match="outside function bounds"):
        diagnostics.extract_check(ix, "f", 1, 12).collect()
    assert diagnostics.parse_line_range("3-9") == (3, 9) and diagnostics.parse_changed_line("c:/a.rs:3:9") == ("c:/a.rs", 3, 9)
    with pytest.raises(diagnostics.OutOfRange):
        diagnostics.parse_line_range("9-3")


def test_commands_and_runners(spark):
    run = testing.Runners(pytest=True, node="vitest")
    cmd = lambda p: one(spark, testing.test_command(F.lit(p), run))
    assert [cmd(x) for x in ("tests/a.rs", "tests/x/a.rs", "pkg/test_a.py", "svc/a_test.go", "web/a.spec.ts", "src/a.rs")] == ["cargo test --test a", None, "pytest pkg/test_a.py", "go test ./svc", "npx vitest run web/a.spec.ts", None]
    files = spark.createDataFrame([("package.json", '{"scripts": {"test": "jest"}}'), ("pyproject.toml", "[tool.pytest.ini_options]")], "file_path string, text string")
    assert testing.probe_runners(files) == testing.Runners(True, "jest")
    both = spark.createDataFrame([("package.json", '{"devDependencies": {"jest": "1", "vitest": "2"}}')], "file_path string, text string")
    assert testing.probe_runners(both).node is None


def test_queries_of_names():
    assert lookup.parse_query("rust:src/a.rs::run") == {"symbol": "run", "file": "src/a.rs", "language": "rust"}
    assert lookup.parse_query("mod::run") == {"symbol": "mod::run", "file": None, "language": None}


def test_diff_impact_keeps_a_row_for_each_least_distance(spark):
    # c calls both seeds' sides: one hop from b, two from a by d
    ix = index(spark, [(i, f"src/{n}.rs", n, "function", 1, 5) for i, n in enumerate("abcd", 1)], [edge(3, 2), edge(4, 1), edge(3, 4)], [("tests/x.rs", "a", 1)])
    seeds = ix.symbols.where("symbol in ('a', 'b')")
    got = graph.diff_impact(ix, seeds, 2, exclude_changed=True, with_tests=True).collect()
    assert [(r.symbol, r.distance, r.why_included) for r in got[:-1]] == [
        ("c", 1, "direct called_by neighbor of changed symbol 'b'"), ("d", 1, "direct called_by neighbor of changed symbol 'a'"), ("c", 2, "direct called_by neighbor of changed symbol 'a'"),
    ]
    assert [(r.qualified_symbol, r.language, r.provenance) for r in got[:1]] == [("rust:src/c.rs::c", "rust", "call_resolution")]
    last = got[-1]  # a changed symbol's test stays though its own row goes
    assert (last.result_kind, last.target, last.target_kind, last.language, last.why_included, last.provenance, last.score) == ("test_target", "tests/x.rs", "integration_test_file", "rust", "references impacted symbol 'a'", "text_fallback", 0.7)
    own = graph.diff_impact(ix, seeds, 0).collect()
    assert {(r.symbol, r.distance, r.why_included, r.score) for r in own} == {("a", 0, "symbol defined in changed file", 1.0), ("b", 0, "symbol defined in changed file", 1.0)}


def test_tests_for_says_what_and_why(spark):
    ix = index(spark, tokens=[("tests/run.rs", "build_index", 1), ("tests/run.rs", "build_index", 2), ("tests/common/mod.rs", "build_index", 1), ("tests/part.rs", "index", 1), ("src/a.rs", "build_index", 1)])
    got = [tuple(r)[:5] for r in testing.tests_for(ix, "build_index", include_support=True).collect()]
    assert got == [
        ("tests/run.rs", "integration_test_file", "direct symbol match for 'build_index' in test file", "graph_likely", 0.9),
        ("tests/part.rs", "integration_test_file", "direct symbol match for 'build_index' in test file", "context_medium", 0.75),
        ("tests/common/mod.rs", "support_test_file", "direct symbol match for 'build_index' in support path", "context_medium", 0.58),
    ]
    assert testing.tests_for(ix, "build_index").count() == 2


def test_refactor_plan_is_the_contract(spark):
    symbols = [(1, "src/a.rs", "run", "function", 1, 9, "pub fn run"), (2, "src/a.rs", "leaf", "function", 20, 24, "fn leaf"), (3, "src/b.rs", "other", "function", 1, 3, "fn other")]
    ix = index(spark, symbols, [edge(3, 1)], [("tests/run.rs", "run", 1)])
    plan = diagnostics.refactor_plan(ix, "src/a.rs").collect()
    assert [(r.priority, r.action, r.confidence, r.risk, r.blockers) for r in plan] == [(1, "analyze-boundary", "high", "low", ""), (2, "address-test-gaps", "medium", "medium", ""), (3, "review-dead-symbols", "medium", "low", "")]
    assert (plan[0].boundary_public, plan[0].boundary_internal, plan[0].dead_candidates, plan[0].test_gap_state) == (1, 1, 1, "mixed")
    none = diagnostics.refactor_plan(ix, "src/none.rs").first()
    assert (none.blockers, none.test_gap_state, none.dead_candidates) == ("coverage state unknown", "unknown", 1)
    assert [r.step for r in diagnostics.safe_steps(spark, "gone", "rename").collect()] == ["Step 1: Stage the rename change for gone", "Step 2: Run targeted checks", "Step 3: Run full test suite"]
    with pytest.raises(ValueError, match="unknown action"):
        diagnostics.safe_steps(spark, "x", "burn")
    scaffold = diagnostics.test_scaffold(ix, "run").collect()
    assert [(r.signature, r.target) for r in scaffold] == [("pub fn run", "tests/run.rs")]
    assert [(r.signature, r.target) for r in diagnostics.test_scaffold(ix, "gone").collect()] == [("<unknown>", None)]


def test_registry_lists_seven_documents(spark):
    assert [(r.command, r.schema) for r in lookup.schema_registry(spark).collect()] == [(c, f"trellis/{c}@v1") for c in ("status", "find", "refs", "resolve", "query", "refactor-plan", "error")]


def test_anatomy_and_tree_of_small_files(spark):
    symbols = [(1, "src/a.rs", "z", "function", 5, 9), (2, "src/a.rs", "A", "struct", 5, 6), (3, "src/sub/b.rs", "q", "function", 1, 2), (4, "z.rs", "r", "function", 1, 1)]
    ix = index(spark, symbols, [edge(1, 3), edge(4, 3)], files=[("src/a.rs", "x\n" * 9), ("src/sub/b.rs", "x"), ("z.rs", "x"), ("src/c.rs", "")])
    assert [(r.symbol, r.kind, r.start_line, r.total_symbols, r.function_count) for r in diagnostics.anatomy(ix, "src/a.rs").collect()] == [("A", "struct", 5, 2, 1), ("z", "function", 5, 2, 1)]
    got = [(r.path, r.kind, r.symbol_count, r.total_files, r.total_symbols, r.imports, r.used_by) for r in orient.tree(ix, 3).collect()]
    assert got == [
        (".", "directory", 0, 4, 4, None, None), ("src", "directory", 0, 3, 3, None, None), ("src/sub", "directory", 0, 1, 1, None, None), ("src/sub/b.rs", "file", 1, 1, 1, None, "src/a.rs,z.rs"),
        ("src/a.rs", "file", 2, 1, 2, "src/sub/b.rs", None), ("src/c.rs", "file", 0, 1, 0, None, None), ("z.rs", "file", 1, 1, 1, "src/sub/b.rs", None),
    ]
    assert [r.path for r in orient.tree(ix, 1, deps=False).collect()] == [".", "src", "z.rs"]


def test_health_baseline(spark, tmp_path):
    ix = index(spark, [(1, "src/a.rs", "f", "function", 1, 30)], files=[("src/a.rs", "x\n" * 40)])
    now, path = diagnostics.health_files(ix), str(tmp_path / "baseline")
    assert diagnostics.load_baseline(spark, path) is None
    diagnostics.save_baseline(now, path)
    later = index(spark, files=[("src/a.rs", "x\n" * 55)])
    assert tuple(diagnostics.health_diff(diagnostics.health_files(later), diagnostics.load_baseline(spark, path)).first()) == (41, 56, 15)


def test_batches_from_files(spark, tmp_path):
    from trellis.sources import requests

    ix = index(spark, [(1, "src/a.rs", "run", "function", 3, 9)], tokens=[("src/a.rs", "run", 3), ("src/b.rs", "runner", 1), ("src/c.rs", "x100%", 1)])
    (tmp_path / "a.json").write_text('[{"id": "q1", "command": "find", "symbol": "run"}, {"command": "drop", "symbol": "x"}, {"id": "q3", "command": "find", "symbol": "unne"}]')
    (tmp_path / "a.jsonl").write_text('{"id": "q1", "command": "refs", "symbol": "nothing"}\n\n{"id": "q2"}\n')
    asked = requests.read_requests(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in asked.orderBy("position").collect()] == [(1, "q1", "find", "run"), (2, "request", "drop", "x"), (3, "q3", "find", "unne")]
    answers = lookup.batch(ix, asked)
    assert [(r.position, r.file_path, r.score, r.error) for r in answers.collect()] == [(1, "src/a.rs", 1.0, None), (2, None, None, "unsupported command 'drop'"), (3, "src/b.rs", 0.4, None)]
    assert [r.position for r in lookup.batch(ix, asked, fail_fast=True).collect()] == [1, 2]
    documents = [r.json for r in requests.responses(answers, asked).collect()]
    assert documents[1] == '{"id":"request","ok":false,"error":{"code":"UNSUPPORTED_BATCH_COMMAND","message":"unsupported command \'drop\'"}}'
    assert documents[2].startswith('{"id":"q3","ok":true,"command":"find","data":{"query":"unne","results":[{"file_path":"src/b.rs","line":1,')
    lines = requests.read_requests(spark, str(tmp_path / "a.jsonl"), "jsonl")
    assert [tuple(r) for r in lines.orderBy("position").collect()] == [(1, "q1", "refs", "nothing"), (2, "q2", "", "")]
    assert requests.responses(lookup.batch(ix, lines), lines).first().json == '{"id":"q1","ok":true,"command":"refs","data":{"query":"nothing","results":[]}}'
    (tmp_path / "bad.json").write_text('{"id": "q1"}, nonsense')
    with pytest.raises(Exception, match="must be an array"):
        requests.read_requests(spark, str(tmp_path / "bad.json")).collect()


def test_errors_are_documents():
    import json

    from trellis import errors

    e = errors.PartialData("lacks rows", "verify-refactor", {"rows": 3})
    assert json.loads(e.document()) == {"schema": "trellis/error@v1", "command": "verify-refactor", "ok": False, "error": {"code": "PARTIAL_DATA", "message": "lacks rows", "details": {"rows": 3}}}
    assert [c.exit_code for c in (errors.UsageError, errors.StaleIndex, errors.TrellisError, errors.PartialData)] == [2, 3, 4, 5]


def test_edges_to_gone_symbols_are_pruned(spark):
    ix = index(spark, [(1, "a.rs", "a", "function", 1, 1), (2, "b.rs", "b", "function", 1, 1)], [edge(1, 2), edge(2, 1), edge(1, 9), edge(9, 2)])
    assert {(r.from_symbol_id, r.to_symbol_id) for r in resolve.prune_edges(ix.edges, ix.symbols).collect()} == {(1, 2), (2, 1)}
    last = spark.createDataFrame([(1, 2, "calls", 0.95, "a", 1), (1, 2, "calls", 0.5, "b", 2)], "from_symbol_id long, to_symbol_id long, edge_kind string, confidence double, provenance string, turn int")
    assert [(r.confidence, r.provenance) for r in resolve.upsert_edges(last).collect()] == [(0.5, "b")]


def test_many_values_are_joined_instead_of_pushed(spark, monkeypatch):
    from trellis import schemas

    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "x int, y int")
    few = df.where("x < 4").select("x")
    got = lambda: sorted(map(tuple, schemas.picked(df, "x", few).collect()))
    pushed = got()
    monkeypatch.setattr(schemas, "MOST_LITERALS", 2)
    assert got() == pushed == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_lookups_push_their_names_to_the_stored_index(spark, sf):
    from trellis.plans import queries

    plan = queries.queries()["find_ast"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(symbol,The)" in plan and "regexp_extract" not in plan
    plan = queries.queries()["impact"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(to_symbol_id" in plan or "PushedFilters: [IsNotNull(to_symbol_id), EqualTo(to_symbol_id" in plan


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_cycle_edges_are_not_sorted_with_their_lists(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "LISTS", most)
    files = ["src/z", "src/a", "src/a+b", "src/m", "src/n", "src/o"]
    ix = index(spark, [(i, f, f"s{i}", "function", 1, 5) for i, f in enumerate(files)], [(0, 1, "calls", 1.0, "x"), (1, 0, "calls", 1.0, "x"), (2, 3, "calls", 1.0, "x"), (3, 2, "imports", 1.0, "x"), (4, 5, "calls", 1.0, "x")])
    out = graph.cycle_edges(ix)
    assert [tuple(r) for r in out.collect()] == [
        ("src/a+b,src/m", "src/a+b", "s2", "src/m", "s3", "calls"), ("src/a+b,src/m", "src/m", "s3", "src/a+b", "s2", "imports"),
        ("src/a,src/z", "src/a", "s1", "src/z", "s0", "calls"), ("src/a,src/z", "src/z", "s0", "src/a", "s1", "calls"),
    ]
    keys = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Sort [" in line and "true" in line]
    assert keys and not any("files#" in line.split("]")[0] for line in keys)
