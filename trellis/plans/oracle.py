"""The same queries for DuckDB, written independently on shared table prefixes."""

from __future__ import annotations

STAR = """
WITH RECURSIVE base AS (
 SELECT r_regionkey::BIGINT + 1 AS symbol_id, 'src/world.rs' AS file_path, 'region_' || r_regionkey AS symbol, 'module' AS kind, 'rust' AS language, r_regionkey::BIGINT AS k FROM region
 UNION ALL SELECT n_nationkey::BIGINT + 1000, 'src/n' || n_nationkey || '.rs', 'nation_' || n_nationkey, 'module', 'rust', n_nationkey::BIGINT FROM nation
 UNION ALL SELECT c_custkey + 4000000000, 'src/n' || c_nationkey || '.rs', 'customer_' || c_custkey, 'struct', 'rust', c_custkey FROM customer
 UNION ALL SELECT s_suppkey + 1000000000, 'src/n' || s_nationkey || '.rs', 'supplier_' || s_suppkey, 'struct', 'rust', s_suppkey FROM supplier
 UNION ALL SELECT o_orderkey + 8000000000, 'src/n' || c_nationkey || '.rs', 'order_' || o_orderkey, 'function', 'rust', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT p_partkey + 2000000000, 'src/brand/' || replace(p_brand, '#', '_') || '.py', 'part_' || p_partkey, 'function', 'python', p_partkey FROM part
), symbols AS (
 SELECT symbol_id, file_path, symbol, kind, language, language || ':' || file_path || '::' || symbol AS qualified_symbol, (k % 4000 * 3 + 1)::INT AS start_line, 1 AS start_column,
  (k % 4000 * 3 + 1 + k % 97)::INT AS end_line, CASE WHEN kind = 'function' THEN CASE WHEN k % 3 = 0 THEN 'pub fn ' ELSE 'fn ' END || symbol END AS signature, (k % 97 + 1)::INT AS line_count
 FROM base
), edges AS (
 SELECT n_regionkey::BIGINT + 1 AS a, n_nationkey::BIGINT + 1000 AS b, 'contains' AS edge_kind, 1.0::DOUBLE AS confidence, 'ast_definition' AS provenance FROM nation
 UNION ALL SELECT c_nationkey::BIGINT + 1000, c_custkey + 4000000000, 'contains', 1.0, 'ast_definition' FROM customer
 UNION ALL SELECT s_nationkey::BIGINT + 1000, s_suppkey + 1000000000, 'contains', 1.0, 'ast_definition' FROM supplier
 UNION ALL SELECT DISTINCT l_orderkey + 8000000000, l_partkey + 2000000000, 'calls', 0.95, 'call_resolution' FROM lineitem
 UNION ALL SELECT DISTINCT l_orderkey + 8000000000, l_suppkey + 1000000000, 'calls', 0.95, 'call_resolution' FROM lineitem
 UNION ALL SELECT DISTINCT l_partkey + 2000000000, l_suppkey + 1000000000, 'implements', 0.95, 'ast_reference' FROM lineitem
 UNION ALL SELECT o_custkey + 4000000000, o_orderkey + 8000000000, 'imports', 0.9, 'import_resolution' FROM orders
), named AS (
 SELECT e.*, s.symbol AS s_symbol, s.file_path AS s_file, t.symbol AS t_symbol, t.file_path AS t_file FROM edges e JOIN symbols s ON s.symbol_id = e.a JOIN symbols t ON t.symbol_id = e.b
), file_edges AS (SELECT s_file AS f, t_file AS t, count(*) AS n FROM named WHERE s_file <> t_file GROUP BY ALL)
"""

CORPUS = r"""
WITH RECURSIVE files0 AS (
 SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '.md' WHEN lang = 'en' THEN '.rs' WHEN lang = 'de' THEN '.py' WHEN lang = 'fr' THEN '.ts' ELSE '.go' END AS ext,
  CASE WHEN doc_id % 10 = 0 THEN 'tests/fixtures/' WHEN doc_id % 10 IN (1, 2) THEN 'tests/' ELSE 'src/' END || source || '/d' || doc_id || CASE WHEN doc_id % 10 = 2 THEN '_test' ELSE '' END AS stem, text FROM documents
), files AS (
 SELECT doc_id, stem || ext AS file_path, CASE ext WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' ELSE 'unknown' END AS language, sha256(text) AS content_hash,
  (len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INT AS line_count, string_split(text, chr(10)) AS parts FROM files0
), lines AS (SELECT doc_id, file_path, language, line_count, unnest(parts) AS line_text, generate_subscripts(parts, 1)::INT AS line FROM files
), pieces0 AS (SELECT * EXCLUDE line_text, regexp_extract_all(line_text, '[^A-Za-z0-9_]*[A-Za-z0-9_]+') AS p FROM lines
), pieces AS (SELECT * EXCLUDE p, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces0
), tokens0 AS (SELECT *, regexp_extract(piece, '[A-Za-z0-9_]+$') AS symbol, sum(strlen(piece)) OVER (PARTITION BY doc_id, line ORDER BY i) AS e FROM pieces
), tokens AS (SELECT doc_id, file_path, language, line_count, symbol, line, (e - length(symbol) + 1)::INT AS "column", row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM tokens0 WHERE NOT regexp_matches(symbol, '^[0-9]')
), symbols AS (
 SELECT doc_id * 1000000 + line AS symbol_id, doc_id, file_path, symbol, ['function', 'struct', 'enum', 'trait', 'import'][line % 5 + 1] AS kind, language, language || ':' || file_path || '::' || symbol AS qualified_symbol, line AS start_line, "column" AS start_column,
  coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, line_count)::INT AS end_line, CASE WHEN line % 2 = 0 THEN 'pub ' ELSE '' END || symbol AS signature,
  (coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, line_count) - line + 1)::INT AS line_count
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY "column") AS n1 FROM tokens) WHERE n1 = 1
), refs AS (
 SELECT t.* FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY "column") AS n1 FROM tokens) t WHERE n1 > 1 AND symbol IN (SELECT symbol FROM symbols)
), in_file AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY file_path, symbol ORDER BY kind = 'import', start_line) = 1
), only_one AS (SELECT language, symbol, min(symbol_id) AS symbol_id, min(kind) AS kind FROM symbols GROUP BY ALL HAVING count(*) = 1
), wanted AS (
 SELECT DISTINCT s.symbol_id AS a, r.file_path, r.symbol, r.language, CASE WHEN s.kind = 'import' THEN 'imports' ELSE 'calls' END AS edge_kind FROM refs r JOIN symbols s ON s.file_path = r.file_path AND s.start_line = r.line
), edges AS (
 SELECT DISTINCT a, coalesce(f.symbol_id, o.symbol_id) AS b, edge_kind, CASE edge_kind WHEN 'imports' THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence, CASE edge_kind WHEN 'imports' THEN 'import_resolution' ELSE 'call_resolution' END AS provenance
 FROM wanted w LEFT JOIN in_file f ON f.file_path = w.file_path AND f.symbol = w.symbol LEFT JOIN only_one o ON o.language = w.language AND o.symbol = w.symbol
 WHERE coalesce(f.symbol_id, o.symbol_id) IS NOT NULL AND coalesce(f.symbol_id, o.symbol_id) <> a AND NOT (edge_kind = 'imports' AND coalesce(f.kind, o.kind) = 'import')
), named AS (
 SELECT e.*, s.symbol AS s_symbol, s.file_path AS s_file, t.symbol AS t_symbol, t.file_path AS t_file FROM edges e JOIN symbols s ON s.symbol_id = e.a JOIN symbols t ON t.symbol_id = e.b
)
"""

CODE = r"regexp_matches(file_path, '\.(rs|tsx?|py|go)$')"
TEST = r"(file_path LIKE 'tests/%' OR contains(file_path, '/tests/') OR regexp_matches(file_path, '(^|/)([^/]*_test\.(rs|go|py)|[^/]*_tests\.py|test_[^/]*\.py|[^/]*\.(test|spec)\.tsx?)$'))"
LIKE_TEST = "(file_path ILIKE 'tests/%' OR file_path ILIKE '%_test.%')"
FIXTURE = "(file_path LIKE 'tests/fixtures/%' OR contains(file_path, '/tests/fixtures/'))"
LANGUAGE = "CASE WHEN ends_with(file_path, '.rs') THEN 'rust' WHEN regexp_matches(file_path, '\\.tsx?$') THEN 'typescript' WHEN ends_with(file_path, '.py') THEN 'python' WHEN ends_with(file_path, '.go') THEN 'go' ELSE 'unknown' END"
DEFS = "SELECT file_path, start_line AS line, start_column AS \"column\", symbol, 'exact_symbol_name' AS why_matched, 'ast_exact' AS confidence, 1.0::DOUBLE AS score FROM symbols WHERE symbol = '{0}'"
REFS = "SELECT DISTINCT file_path, line, \"column\", symbol, 'ast_reference' AS why_matched, 'ast_likely' AS confidence, 0.95::DOUBLE AS score FROM refs WHERE symbol = '{0}'"
TEXT = (
    "SELECT file_path, line, \"column\", symbol, CASE WHEN symbol = '{0}' THEN 'exact_symbol_name' ELSE 'text_substring_match' END AS why_matched, 'text_fallback' AS confidence, CASE WHEN symbol = '{0}' THEN 0.8 ELSE 0.4 END::DOUBLE AS score "
    "FROM tokens WHERE (symbol = '{0}' OR symbol ILIKE '%{0}%')"
)


def _fallback(first: str, name: str, more: str = "") -> str:
    a = first.format(name)
    return f"SELECT * FROM ({a}) UNION ALL SELECT * FROM ({TEXT.format(name)} {more}) WHERE NOT EXISTS (SELECT 1 FROM ({a}))"


RELATION = "CASE edge_kind WHEN 'calls' THEN 'called_by' WHEN 'contains' THEN 'contained_by' WHEN 'imports' THEN 'imported_by' WHEN 'implements' THEN 'implemented_by' ELSE edge_kind END"
SCORE = (
    "CASE WHEN provenance = 'call_resolution' AND edge_kind = 'calls' THEN 0.97 WHEN provenance = 'import_resolution' AND edge_kind = 'imports' THEN 0.95 WHEN provenance = 'ast_reference' AND edge_kind = 'implements' THEN 0.94 "
    "WHEN provenance = 'ast_definition' AND edge_kind = 'contains' THEN 0.94 WHEN provenance = 'call_resolution' THEN 0.95 WHEN provenance = 'import_resolution' THEN 0.94 ELSE 0.93 END::DOUBLE"
)
PLACE = 's.symbol, s.kind, s.file_path, s.start_line AS line, s.start_column AS "column"'


def _diff(seeds: str, distance: int) -> str:
    """Rows of diff-impact: a node stands at its least distance from each seed, once for each relationship and distance."""
    return f""", seeds AS (SELECT symbol_id, symbol AS of, row_number() OVER (ORDER BY file_path, start_line, start_column, symbol, symbol_id) AS turn FROM symbols WHERE symbol_id IN ({seeds})), walk AS (
 SELECT symbol_id AS seed, symbol_id AS node, 0 AS d FROM seeds
 UNION SELECT w.seed, e.a, w.d + 1 FROM walk w JOIN edges e ON e.b = w.node WHERE w.d < {distance} AND e.a NOT IN (SELECT symbol_id FROM seeds)
), least AS (SELECT seed, node, min(d) AS d FROM walk GROUP BY ALL
), reached AS (
 SELECT e.a AS node, {RELATION} AS relationship, l.d AS distance, q.turn, q.of, e.provenance, round({SCORE} - 0.01::DOUBLE * (l.d - 1), 6) AS score
 FROM least l JOIN edges e ON e.a = l.node JOIN least p ON p.seed = l.seed AND p.node = e.b AND p.d = l.d - 1 JOIN seeds q ON q.symbol_id = l.seed WHERE l.d > 0
), best AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY node, relationship, distance ORDER BY turn, score DESC, provenance) = 1
), result AS (
 SELECT 'impacted_symbol' AS result_kind, {PLACE}, s.qualified_symbol, s.language, b.distance, b.relationship, 'direct ' || b.relationship || ' neighbor of changed symbol ' || chr(39) || b.of || chr(39) AS why_included, 'graph_likely' AS confidence, b.provenance, b.score
 FROM best b JOIN symbols s ON s.symbol_id = b.node
 UNION ALL SELECT 'impacted_symbol', {PLACE}, s.qualified_symbol, s.language, 0, 'changed_symbol', 'symbol defined in changed file', 'graph_exact', 'ast_definition', 1.0 FROM seeds JOIN symbols s USING (symbol_id)
), plain AS (SELECT *, NULL::VARCHAR AS target, NULL::VARCHAR AS target_kind FROM result) """


DIFF_ORDER = 'ORDER BY score DESC, result_kind, file_path, line, "column", qualified_symbol, relationship, distance, kind LIMIT'


def _context(task: str) -> str:
    # DuckDB's list_distinct keeps no order: the words are numbered by hand
    seen: list[str] = []
    import re

    for w in (x.lower() for x in re.findall("[A-Za-z0-9_]+", task)):
        if len(w) >= 3 and w not in ("about", "after", "and", "for", "from", "into", "that", "the", "then", "this", "when", "with") and w not in seen:
            seen.append(w)
    words = "[" + ", ".join(f"'{w}'" for w in seen) + "]"
    return rf""", own0 AS (
 SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(symbol, '([a-z])([A-Z])', '\1_\2', 'g'), '[_\W]'), lambda x: lower(x)), lambda x: length(x) >= 3))) AS own FROM symbols
), own1 AS (SELECT *, list_filter({words}, lambda w: len(list_filter(own, lambda s: s = w OR starts_with(s, w) OR starts_with(w, s))) > 0) AS matched, list_contains({words}, lower(symbol)) AS exact FROM own0
), hit AS (SELECT *, least(0.98::DOUBLE, 0.62::DOUBLE + 0.09::DOUBLE * len(matched) + 0.04::DOUBLE * least(len(own), 4) + 0.04::DOUBLE * exact::INT) AS score, array_to_string(matched, ', ') AS words FROM own1 WHERE len(matched) > 0
), direct AS (
 SELECT file_path, start_line, symbol, kind, end_line, 'direct definition token-overlap relevance for [' || words || ']' AS why_included, CASE WHEN len(matched) >= 2 OR exact THEN 'context_high' ELSE 'context_medium' END AS confidence, score FROM hit
), near AS (
 SELECT n.file_path, n.start_line, n.symbol, n.kind, n.end_line, 'graph neighbor of ''' || h.symbol || ''' from token-overlap relevance [' || h.words || ']' AS why_included, 'context_medium' AS confidence, greatest(h.score - 0.2::DOUBLE, 0.55::DOUBLE) AS score
 FROM hit h JOIN edges e ON e.a = h.symbol_id JOIN symbols n ON n.symbol_id = e.b QUALIFY row_number() OVER (PARTITION BY n.file_path, n.start_line, n.symbol, n.kind ORDER BY h.file_path, h.start_line, h.start_column, h.symbol) = 1
) """


CONTEXT_ORDER = "ORDER BY score DESC, file_path, start_line, symbol, kind, end_line, why_included LIMIT"
CONTEXT_OUT = "SELECT * REPLACE (round(score, 6) AS score) FROM"
MENTIONS = f"(SELECT symbol, count(DISTINCT file_path) AS test_files FROM tokens WHERE {LIKE_TEST} GROUP BY ALL)"
GAPS = (
    "SELECT symbol, coalesce(raw, span) AS line_count, hits AS test_hits, CASE WHEN coalesce(raw, span) > 80 THEN 'high' WHEN coalesce(raw, span) > 30 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN hits > 0 THEN 'covered' ELSE 'uncovered' END AS coverage_status "
    "FROM (SELECT s.symbol, s.line_count AS raw, max(s.end_line - s.start_line + 1) AS span, coalesce(max(m.test_files), 0) AS hits FROM symbols s LEFT JOIN {m} m USING (symbol) WHERE s.kind = 'function' AND {w} GROUP BY s.symbol, s.line_count)"
)
STATE = "CASE WHEN yes = 0 AND no = 0 THEN 'unknown' WHEN no = 0 THEN 'covered' WHEN yes = 0 THEN 'uncovered' ELSE 'mixed' END"


def _gaps(where: str, more: str = "") -> str:
    found = GAPS.format(m=MENTIONS, w=where)
    return f"SELECT g.*, {STATE} AS analysis_state FROM ({found}) g, (SELECT count(*) FILTER (test_hits > 0) AS yes, count(*) FILTER (test_hits = 0) AS no FROM ({found})) {more}"


OLD_NEW = ", old AS (SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE content_hash END AS h FROM files WHERE doc_id % 7 <> 0), new AS (SELECT file_path, content_hash AS h FROM files WHERE doc_id % 11 <> 0) "


def _cycles(longest: int) -> str:
    """Strong components of 2 to longest files by mutual reach, and the edges inside."""
    return f""", pairs AS (SELECT DISTINCT s_file AS f, t_file AS t FROM named WHERE s_file <> t_file
), reach AS (SELECT f, t FROM pairs UNION SELECT r.f, p.t FROM reach r JOIN pairs p ON p.f = r.t
), scc AS (SELECT r.f AS node, min(least(r.f, r.t)) AS c FROM reach r JOIN reach q ON q.f = r.t AND q.t = r.f WHERE r.f <> r.t GROUP BY ALL
), cycles AS (SELECT c, string_agg(node, ',' ORDER BY node) AS files, count(*) AS n_files FROM scc GROUP BY c HAVING count(*) BETWEEN 2 AND {longest}
), inside AS (SELECT x.files, x.n_files, n.* FROM named n JOIN scc i ON i.node = n.s_file JOIN scc k ON k.node = n.t_file AND k.c = i.c JOIN cycles x ON x.c = i.c WHERE n.s_file <> n.t_file
), cyc AS (SELECT files, n_files, count(*) AS n_edges, (SELECT count(*) FROM cycles) AS total_cycles FROM inside GROUP BY files, n_files)
"""


HOT = """SELECT s.symbol, s.file_path, s.kind, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) + coalesce(o.n, 0) AS total FROM symbols s
 LEFT JOIN (SELECT b, count(DISTINCT a) AS n FROM edges GROUP BY b) i ON i.b = s.symbol_id LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM edges GROUP BY a) o ON o.a = s.symbol_id
 WHERE coalesce(i.n, 0) + coalesce(o.n, 0) > 0 ORDER BY total DESC, s.file_path, s.symbol LIMIT 10"""


LEAF = "(NOT public AND kind = 'function' AND outs = 0)"
DEGREES = """, degrees AS (SELECT s.*, coalesce(s.signature ILIKE 'pub %' OR s.signature ILIKE 'pub(%', false) AS public, (SELECT count(*) FROM edges e WHERE e.b = s.symbol_id) AS ins, (SELECT count(*) FROM edges e WHERE e.a = s.symbol_id) AS outs
 FROM symbols s WHERE kind IN ('function', 'struct', 'enum', 'trait'))"""


def _dead(aggressive: bool) -> str:
    return DEGREES + f""" SELECT file_path, symbol, kind, start_line AS line, CASE WHEN {LEAF} THEN 'high' WHEN NOT public THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN {LEAF} THEN 'private leaf function has no inbound or outbound symbol edges' WHEN NOT public THEN 'private symbol has no inbound symbol edges' ELSE 'public/exported symbol has no inbound symbol edges in indexed scope' END AS reason
 FROM degrees WHERE ins = 0 {'' if aggressive else 'AND ' + LEAF}"""


def _plan(target: str, boundary: str) -> str:
    """The three actions of a refactoring plan, as its contract lists them."""
    gaps = GAPS.format(m=MENTIONS, w=f"s.file_path = '{target}'")
    return DEGREES + f""", gaps AS ({gaps}), sides AS ({boundary}), facts AS (SELECT (SELECT count(*) FROM sides WHERE is_public) AS boundary_public, (SELECT count(*) FROM sides WHERE NOT is_public) AS boundary_internal,
 (SELECT count(*) FROM degrees WHERE ins = 0 AND {LEAF}) AS dead_candidates, (SELECT count(*) FROM gaps WHERE test_hits > 0) AS yes, (SELECT count(*) FROM gaps WHERE test_hits = 0) AS no)
 SELECT a.priority, a.action, CASE WHEN a.priority = 1 THEN 'high' WHEN a.priority = 2 AND no = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN a.priority = 2 AND no > 0 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN yes = 0 AND no = 0 THEN 'coverage state unknown' ELSE '' END AS blockers, boundary_public, boundary_internal, dead_candidates, {STATE} AS test_gap_state
 FROM facts, (VALUES (1, 'analyze-boundary'), (2, 'address-test-gaps'), (3, 'review-dead-symbols')) a(priority, action)"""


def _tree(depth: int, files: str, focus: str = "", deps: bool = True) -> str:
    """Nodes of the tree of files (file_path, line_count)."""
    lists = "i.files AS imports, u.files AS used_by" if deps else "NULL::VARCHAR AS imports, NULL::VARCHAR AS used_by"
    return f"""SELECT n.*, {lists} FROM (
 SELECT CASE WHEN d = 0 THEN '.' ELSE array_to_string(parts[1:d], '/') END AS path, d AS depth, CASE WHEN len(parts) = d THEN 'file' ELSE 'directory' END AS kind, max(CASE WHEN len(parts) = d THEN lines END) AS line_count,
  sum(CASE WHEN len(parts) = d THEN symbols ELSE 0 END)::BIGINT AS symbol_count, count(*) AS total_files, sum(symbols)::BIGINT AS total_symbols
 FROM (SELECT string_split(f.file_path, '/') AS parts, f.line_count AS lines, unnest(range(0, least(len(string_split(f.file_path, '/')), {depth}) + 1))::INT AS d, coalesce(s.n, 0) AS symbols
  FROM ({files}) f LEFT JOIN (SELECT file_path, count(*) AS n FROM symbols GROUP BY ALL) s USING (file_path) {focus}) GROUP BY ALL) n
 LEFT JOIN (SELECT s_file AS path, string_agg(DISTINCT t_file, ',' ORDER BY t_file) AS files FROM named WHERE s_file <> t_file GROUP BY ALL) i ON i.path = n.path AND n.kind = 'file'
 LEFT JOIN (SELECT t_file AS path, string_agg(DISTINCT s_file, ',' ORDER BY s_file) AS files FROM named WHERE s_file <> t_file GROUP BY ALL) u ON u.path = n.path AND n.kind = 'file'"""


def _call_path(start: str, goal: str, depth: int) -> str:
    """The least of the shortest paths, level by level."""
    sql = f", l0 AS (SELECT symbol_id AS node, symbol, [{{'symbol': symbol, 'file_path': file_path, 'id': symbol_id}}] AS path FROM symbols WHERE symbol = '{start}' ORDER BY file_path, symbol_id LIMIT 1)"
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        sql += f""", l{k} AS (SELECT e.b AS node, s.symbol, min(list_append(p.path, {{'symbol': s.symbol, 'file_path': s.file_path, 'id': s.symbol_id}})) AS path
 FROM l{k - 1} p JOIN edges e ON e.a = p.node AND e.edge_kind = 'calls' JOIN symbols s ON s.symbol_id = e.b WHERE e.b NOT IN ({before}) GROUP BY ALL)"""
    levels = " UNION ALL ".join(f"SELECT {k} AS d, path FROM l{k} WHERE symbol = '{goal}'" for k in range(1, depth + 1))
    return sql + f" SELECT (i - 1)::INT AS position, path[i].symbol AS symbol FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM (SELECT * FROM ({levels}) ORDER BY d, path LIMIT 1))"


def _hits(names: str) -> str:
    return f"SELECT symbol, file_path, count(*) AS hits FROM tokens WHERE {TEST} AND symbol IN ({names}) GROUP BY ALL"


EDGE_MATCH = PLACE.replace("s.symbol, s.kind, s.file_path", "s.file_path, s.symbol, s.kind")
PRIORITY = f"CASE WHEN {TEST} THEN CASE WHEN {FIXTURE} THEN 2 ELSE 1 END WHEN {CODE} THEN 0 ELSE 3 END"
COUPLING_TEST = r"(file_path LIKE 'tests/%' OR contains(file_path, '/tests/') OR regexp_matches(file_path, '(^|/)([^/]*_test\.(rs|py)|[^/]*_tests\.py|test_[^/]*|[^/]*\.(test|spec)\.ts)$'))"
STAR_FILES = "SELECT file_path, max(end_line) AS line_count FROM symbols GROUP BY ALL"
RECOMMENDED = f""", hot AS ({HOT}), ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, file_path, symbol)::INT AS turn FROM hot), big AS (SELECT * FROM ({STAR_FILES}) ORDER BY line_count DESC, file_path LIMIT 5), recommended AS (
 SELECT 1 AS position, 1 AS turn, 'start_exploring' AS kind, 'Start exploring: ' || file_path || ' (entry point, ' || fan_out || ' symbols)' AS message, file_path FROM (SELECT * FROM ranked ORDER BY fan_out DESC, turn DESC LIMIT 1)
 UNION ALL SELECT 2, min(turn), 'careful_around', 'Careful around: ' || file_path || ' (large file, high fan-in)', file_path FROM ranked WHERE fan_in > 0 AND file_path IN (SELECT file_path FROM big) GROUP BY file_path
 UNION ALL SELECT 3, 1, 'cycle_warning', k || ' circular dependency cycle' || CASE WHEN k = 1 THEN '' ELSE 's' END || ' detected', NULL FROM (SELECT count(*) AS k FROM cyc) WHERE k > 0)"""
#: Source files of the supplier table: three lines a function, each calls the next of its nation, the last one the first of the fourth nation after.
SOURCES = """WITH s AS (SELECT s_nationkey::INT AS n, s_suppkey::BIGINT AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next FROM supplier
), f AS (SELECT *, 'code/n' || n || ['.rs', '.py', '.ts', '.go'][n % 4 + 1] AS file_path FROM s
), w AS (SELECT f.*, coalesce(f.next, (SELECT min(k) FROM s WHERE s.n = f.n + 4)) AS called FROM f
), t AS (SELECT w.*, g.file_path AS calls_in FROM w LEFT JOIN f g ON g.k = w.called)
SELECT row_number() OVER (ORDER BY file_path, i) AS symbol_id, file_path, 'supplier_' || k AS symbol, 'function' AS kind, ['rust', 'python', 'typescript', 'go'][n % 4 + 1] AS language, (3 * i - 2)::INT AS start_line, (3 * i - CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END)::INT AS end_line,
 'supplier_' || called AS calls, calls_in, CASE WHEN called IS NOT NULL THEN 0.95 END::DOUBLE AS confidence, CASE WHEN called IS NOT NULL THEN 'call_resolution' END AS provenance FROM t"""


def _impact(symbol: str) -> str:
    return f"SELECT DISTINCT {PLACE}, 1 AS distance, {RELATION} AS relationship, 'graph_likely' AS confidence, {SCORE} AS score FROM edges e JOIN symbols s ON s.symbol_id = e.a JOIN symbols t ON t.symbol_id = e.b WHERE t.symbol = '{symbol}'"


def _explain(symbol: str, end_column: str) -> str:
    inbound = ", ".join(f"(SELECT count(*) FROM edges e WHERE e.b = symbol_id AND edge_kind = '{k}') AS in_{v}" for k, v in (("calls", "called_by"), ("contains", "contained_by"), ("imports", "imported_by"), ("implements", "implemented_by")))
    outbound = ", ".join(f"(SELECT count(*) FROM edges e WHERE e.a = symbol_id AND edge_kind = '{k}') AS out_{k}" for k in ("calls", "contains", "imports", "implements"))
    return f"""SELECT symbol, qualified_symbol, kind, language, file_path, start_line, start_column, end_line, 2 AS {end_column}, signature, {inbound}, {outbound}, 'exact symbol definition match' AS why_included, 'graph_exact' AS confidence,
 'ast_definition' AS provenance, 1.0::DOUBLE AS score FROM symbols WHERE symbol = '{symbol}'"""


def _rename(symbol: str, scope: str) -> str:
    semantic = _fallback(REFS, symbol)
    return f"SELECT (SELECT count(*) FROM ({semantic})) AS semantic_total, (SELECT count(*) FROM ({semantic}) WHERE {scope}) AS semantic_in_scope, count(*) AS lexical_total, count(*) FILTER ({scope}) AS lexical_in_scope FROM tokens WHERE symbol = '{symbol}'"


def _resolve(symbol: str, where: str) -> str:
    order = f"symbol = '{symbol}' DESC, symbol, file_path, start_line, symbol_id"
    return f"""SELECT symbol_id, symbol, qualified_symbol, kind, language, file_path, start_line AS line, signature, count(*) OVER () > 1 AS ambiguous, row_number() OVER (ORDER BY {order}) = 1 AS recommended
 FROM (SELECT * FROM symbols WHERE symbol ILIKE '%{symbol}%' ORDER BY {order} LIMIT 50) WHERE {where}"""


def _tests_for(symbol: str, parts: tuple[str, ...], command: str) -> str:
    """Without pytest or a node runner, as the query probes none."""
    names = ", ".join(f"'{x}'" for x in (symbol, *parts))
    turn = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate((symbol, *parts)))
    plain = command.replace("WHEN regexp_matches(file_path, '(^|/)(test_[^/]*|[^/]*_tests?)", "WHEN false AND regexp_matches(file_path, '(^|/)(test_[^/]*|[^/]*_tests?)").replace("WHEN regexp_matches(file_path, '\\.(test|spec)", "WHEN false AND regexp_matches(file_path, '\\.(test|spec)")
    return f""", h AS ({_hits(names)}), r AS (SELECT file_path AS target, CASE WHEN symbol = '{symbol}' THEN hits ELSE greatest(hits - 1, 1) END AS hits, ({plain}) IS NOT NULL AS runnable FROM h QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY CASE symbol {turn} END) = 1)
 SELECT *, CASE WHEN runnable THEN 'integration_test_file' ELSE 'support_test_file' END AS target_kind, 'direct symbol match for ''{symbol}'' in ' || CASE WHEN runnable THEN 'test file' ELSE 'support path' END AS why_included, CASE WHEN runnable AND hits > 1 THEN 'graph_likely' ELSE 'context_medium' END AS confidence,
 CASE WHEN runnable THEN CASE WHEN hits > 1 THEN 0.90 ELSE 0.75 END ELSE CASE WHEN hits > 1 THEN 0.62 ELSE 0.58 END END::DOUBLE AS score FROM r"""


def _batch(most: int) -> str:
    """Answers to the first requests of the batch."""
    asked = ((1, "find", "The"), (2, "refs", "The"), (3, "find", "nosuchname"), (4, "find", "thatin"), (5, "drop", "x"), (6, "refs", "ononst"))
    parts = [f"SELECT 5 AS position, '5' AS id, 'drop' AS command, NULL AS file_path, NULL AS line, NULL AS \"column\", NULL AS symbol, NULL AS why_matched, NULL AS confidence, NULL AS score, 'unsupported command ' || chr(39) || 'drop' || chr(39) AS error"]
    parts += [f"SELECT {i} AS position, '{i}' AS id, '{command}' AS command, *, NULL::VARCHAR AS error FROM ({_fallback(DEFS if command == 'find' else REFS, symbol)})" for i, command, symbol in asked[:most] if i != 5]
    return " UNION ALL BY NAME ".join(f"({p})" if " WITH " in p else p for p in parts[1:] + parts[:1])


def oracle_sql() -> dict[str, str]:
    s, c = STAR, CORPUS
    n, part, order, part_fn, supplier, file = "The", "Then", "order_7", "part_12", "supplier_3", "src/n3.rs"
    boundary = f"""SELECT s.symbol, s.kind, coalesce(s.signature ILIKE 'pub %' OR s.signature ILIKE 'pub(%', false) AS is_public, coalesce(sum(CASE WHEN k.file_path IS NOT NULL AND k.file_path <> s.file_path THEN 1 ELSE 0 END), 0)::BIGINT AS external_references
 FROM symbols s LEFT JOIN edges e ON e.b = s.symbol_id LEFT JOIN symbols k ON k.symbol_id = e.a WHERE s.file_path = '{file}' GROUP BY s.symbol_id, s.symbol, s.kind, s.signature"""
    command = r"""CASE WHEN regexp_matches(file_path, '^tests/[^/]+\.rs$') THEN 'cargo test --test ' || regexp_extract(file_path, '^tests/([^/]+)\.rs$', 1) WHEN regexp_matches(file_path, '(^|/)(test_[^/]*|[^/]*_tests?)\.py$') THEN 'pytest ' || file_path
 WHEN ends_with(file_path, '_test.go') THEN 'go test ./' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) WHEN regexp_matches(file_path, '\.(test|spec)\.tsx?$') THEN 'npx jest --runTestsByPath ' || file_path END"""
    plan_file = "src/src5/d25.rs"
    found = {
        "hotspots": s + HOT,
        "status_counts": c + "SELECT 'source_files' AS \"table\", count(*) AS rows FROM files UNION ALL SELECT 'definitions', count(*) FROM symbols UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'text_occurrences', count(*) FROM tokens UNION ALL SELECT 'edges', count(*) FROM edges",
        "language_files": c + "SELECT language, count(DISTINCT file_path) AS files FROM symbols GROUP BY ALL",
        "entry_points": c + f"SELECT DISTINCT file_path FROM symbols WHERE symbol = '{n}' AND kind = 'function'",
        "health_files": c + "SELECT file_path, f.line_count, coalesce(k, 0) AS symbol_count FROM files f LEFT JOIN (SELECT file_path, count(*) AS k FROM symbols GROUP BY ALL) USING (file_path) ORDER BY line_count DESC, file_path LIMIT 20",
        "health_functions": s + "SELECT file_path, symbol, line_count, start_line FROM symbols WHERE kind = 'function' ORDER BY line_count DESC, file_path, symbol, start_line LIMIT 20",
        "anatomy": s + f"SELECT symbol, kind, start_line, line_count, count(*) OVER () AS total_symbols, count(*) FILTER (kind = 'function') OVER () AS function_count FROM symbols WHERE file_path = '{file}' ORDER BY start_line, symbol, kind",
        "outline": c + "SELECT symbol, kind, start_line AS line, signature, CASE WHEN signature LIKE 'pub%' THEN 'public' ELSE 'private' END AS visibility FROM symbols WHERE file_path = 'src/src3/d3.ts'",
        "tokens_summary": c + "SELECT language, count(*) AS tokens, sum(line)::BIGINT AS lines, sum(\"column\")::BIGINT AS columns, count(DISTINCT symbol) AS names FROM tokens GROUP BY ALL",
        "symbols_summary": c + "SELECT language, kind, count(*) AS symbols, sum(start_column)::BIGINT AS columns, sum(line_count)::BIGINT AS lines, count(DISTINCT symbol) AS names FROM symbols GROUP BY ALL",
        "find_ast": c + _fallback(DEFS, n),
        "find_text_fallback": c + _fallback(DEFS, "thatin"),
        "refs_ast": c + _fallback(REFS, part),
        "refs_text_fallback": c + _fallback(REFS, "ononst"),
        "find_scoped": c + _fallback(DEFS, "wh_he", f"AND {CODE} AND NOT {TEST}"),
        "find_filtered": c + f"SELECT file_path, line, \"column\", symbol, why_matched, confidence, round(greatest(0::DOUBLE, score - CASE WHEN {FIXTURE} THEN 0.25 WHEN {TEST} THEN 0.10 ELSE 0 END::DOUBLE), 6) AS score FROM ({_fallback(DEFS, n)}) WHERE {TEST} AND {LANGUAGE} = 'rust'",
        "find_in_file": c + f"SELECT * FROM ({_fallback(DEFS, n)}) WHERE file_path = 'src/src3/d43.rs'",
        "find_qualified": c + f"""SELECT file_path, line, "column", symbol, why_matched, confidence, round(new_score, 6) AS score FROM (SELECT *, greatest(0::DOUBLE, score - CASE WHEN {FIXTURE} THEN 0.25 WHEN {TEST} THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN file_path = 'src/src3/d43.rs' THEN 0.30 ELSE 0 END::DOUBLE
 + CASE WHEN {LANGUAGE} = 'rust' THEN 0.15 ELSE 0 END::DOUBLE) AS new_score, CASE WHEN {TEST} THEN 1 WHEN {CODE} THEN 0 ELSE 2 END AS path_rank FROM ({_fallback(DEFS, n)})) ORDER BY new_score DESC, path_rank, file_path, line, "column", symbol, why_matched LIMIT 40""",
        "find_compact": c + f"SELECT file_path || ':' || line || ' ' || symbol AS text FROM ({_fallback(DEFS, part)})",
        "find_ranked": c + f"""SELECT file_path, line, "column", symbol, why_matched, confidence, round(new_score, 6) AS score FROM (SELECT *, greatest(0::DOUBLE, score - CASE WHEN {FIXTURE} THEN 0.25 WHEN {TEST} THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN file_path = 'src/src3/d43.rs' THEN 0.30 ELSE 0 END::DOUBLE
 + CASE WHEN {LANGUAGE} = 'rust' THEN 0.15 ELSE 0 END::DOUBLE) AS new_score, CASE WHEN {TEST} THEN 1 WHEN {CODE} THEN 0 ELSE 2 END AS path_rank FROM ({_fallback(DEFS, n)}) WHERE NOT (file_path LIKE 'src/src1/%' OR (file_path LIKE 'tests/%' AND regexp_matches(file_path, '^tests/.*?/d2.*_test\\.rs$')))) ORDER BY new_score DESC, path_rank, file_path, line, "column", symbol, why_matched LIMIT 25""",
        "refs_grouped": c + f"""SELECT CASE WHEN confidence = 'ast_exact' THEN 'Definitions' WHEN file_path LIKE 'tests/%' OR contains(file_path, '_test.') OR contains(file_path, '.test.') THEN 'Test' WHEN regexp_matches(file_path, '\\.(md|rst|txt)$') THEN 'Documentation' WHEN {CODE} THEN 'Source' ELSE 'Other' END AS bucket,
 count(*) AS matches, count(DISTINCT file_path) AS files FROM ({_fallback(REFS, part)}) GROUP BY 1""",
        "did_you_mean": c + "SELECT DISTINCT symbol FROM symbols WHERE symbol ILIKE '%ther%' ORDER BY length(symbol), symbol LIMIT 5",
        "resolve_candidates": c + _resolve(n, "kind = 'function'"),
        "resolve_filtered": c + _resolve(n, f"{CODE} AND NOT {TEST} AND {LANGUAGE} = 'rust'"),
        "batch_query": c + _batch(6),
        "batch_fail_fast": c + _batch(5),
        "snippet": c + f"""SELECT s.symbol, s.kind, s.file_path, s.start_line, s.end_line, trim(array_to_string(f.parts[greatest(s.start_line - 1, 1):s.end_line + 1], chr(10)), ' ') AS snippet, s.signature FROM symbols s JOIN files f USING (file_path) WHERE s.symbol = '{part}'""",
        "callers": s + f"SELECT {EDGE_MATCH}, e.confidence FROM edges e JOIN symbols s ON s.symbol_id = e.a JOIN symbols t ON t.symbol_id = e.b WHERE t.symbol = '{part_fn}' AND edge_kind = 'calls'",
        "callees": s + f"SELECT {EDGE_MATCH}, e.confidence FROM edges e JOIN symbols s ON s.symbol_id = e.b JOIN symbols t ON t.symbol_id = e.a WHERE t.symbol = '{order}' AND edge_kind = 'calls'",
        "impact": s + _impact(supplier) + ' ORDER BY score DESC, file_path, line, "column", symbol, relationship',
        "impact_ranked": c + f"SELECT symbol, kind, file_path, line, \"column\", distance, relationship, confidence, round(greatest(0, score - CASE WHEN {FIXTURE} THEN 0.25 WHEN {TEST} THEN 0.10 ELSE 0 END::DOUBLE), 6) AS score FROM ({_impact('ai')}) ORDER BY score DESC, {PRIORITY}, file_path, line, \"column\", symbol, relationship",
        "impact_filtered": c + f"SELECT * FROM ({_impact('ai')}) WHERE {CODE} AND NOT {TEST} AND file_path NOT LIKE 'src/src1/%' ORDER BY score DESC, file_path, line, \"column\", symbol, relationship",
        "explain_counts": s + _explain(supplier, "end_column") + "",
        "explain_snippet": c + f"""SELECT s.symbol, s.file_path, s.start_line, s.qualified_symbol, (SELECT count(*) FROM edges e WHERE e.b = s.symbol_id AND edge_kind = 'calls') AS in_called_by, (SELECT count(*) FROM edges e WHERE e.a = s.symbol_id AND edge_kind = 'calls') AS out_calls,
 nullif(trim(array_to_string(f.parts[s.start_line:s.end_line], chr(10)), ' '), '') AS snippet FROM symbols s JOIN files f USING (file_path) WHERE s.symbol = '{part}'""",
        "related": s + f""", t AS (SELECT * FROM symbols WHERE symbol = '{part_fn}' ORDER BY file_path, symbol_id LIMIT 1), r AS (SELECT x.symbol, x.file_path, x.kind, 'sibling' AS relationship, 0 AS o FROM symbols x JOIN t ON x.file_path = t.file_path WHERE x.symbol_id <> t.symbol_id
 UNION ALL SELECT DISTINCT x.symbol, x.file_path, x.kind, 'shared_caller', 1 FROM t JOIN edges e1 ON e1.b = t.symbol_id AND e1.edge_kind = 'calls' JOIN edges e2 ON e2.a = e1.a AND e2.edge_kind = 'calls' AND e2.b <> t.symbol_id JOIN symbols x ON x.symbol_id = e2.b)
 SELECT symbol, file_path, kind, relationship FROM r WHERE symbol <> '{part_fn}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY o, file_path, kind) = 1""",
        "deps": s + f"SELECT 'depends_on' AS direction, t AS file_path, n AS edge_count FROM file_edges WHERE f = '{file}' UNION ALL SELECT 'depended_on_by', f, n FROM file_edges WHERE t = '{file}'",
        "file_graph": s + "SELECT f AS from_file, t AS to_file, n AS edge_count FROM file_edges",
        "coupling": s + "SELECT x.f AS file_a, x.t AS file_b, x.n AS a_to_b_edges, coalesce(y.n, 0) AS b_to_a_edges, x.n + coalesce(y.n, 0) AS total_edges FROM file_edges x LEFT JOIN file_edges y ON y.f = x.t AND y.t = x.f WHERE x.f < x.t ORDER BY total_edges DESC, file_a, file_b LIMIT 20",
        "coupling_production": c + f", fe AS (SELECT s_file AS f, t_file AS t, count(*) AS n FROM named WHERE s_file <> t_file GROUP BY ALL) SELECT * FROM (SELECT x.f AS file_a, x.t AS file_b, x.n AS a_to_b_edges, coalesce(y.n, 0) AS b_to_a_edges, x.n + coalesce(y.n, 0) AS total_edges FROM fe x LEFT JOIN fe y ON y.f = x.t AND y.t = x.f WHERE x.f < x.t ORDER BY total_edges DESC, file_a, file_b LIMIT 40) WHERE NOT {COUPLING_TEST.replace('file_path', 'file_a')} AND NOT {COUPLING_TEST.replace('file_path', 'file_b')}",
        "boundary": s + boundary,
        "boundary_public": s + f"SELECT * FROM ({boundary}) WHERE is_public",
        "dead_conservative": c + _dead(False),
        "dead_aggressive": c + _dead(True),
        "tests_for": c + _tests_for("the_then", ("the", "then"), command),
        "test_gaps": c + _gaps(f"s.file_path = '{plan_file}'"),
        "test_gaps_risk": c + _gaps(f"s.symbol = '{n}'", "WHERE risk >= 'low'"),
        "suggest": s + """SELECT s.symbol, s.file_path, s.line_count, count(DISTINCT e.a::VARCHAR || e.edge_kind) AS fan_in, false AS has_tests, s.line_count::DOUBLE + count(DISTINCT e.a::VARCHAR || e.edge_kind) * 5.0::DOUBLE + 20.0::DOUBLE AS refactoring_value FROM symbols s LEFT JOIN edges e ON e.b = s.symbol_id
 WHERE s.kind = 'function' AND s.line_count >= 10 GROUP BY s.symbol_id, s.symbol, s.file_path, s.line_count ORDER BY refactoring_value DESC, s.file_path, s.symbol, s.symbol_id LIMIT 10""",
        "rename_check": c + _rename(part, f"NOT {FIXTURE} AND NOT {TEST}"),
        "rename_check_tests": c + _rename("ononst", f"NOT {FIXTURE}"),
        "move_check": c + f"SELECT (SELECT count(*) FROM ({_fallback(REFS, part)})) AS \"references\", (SELECT count(*) FROM (SELECT DISTINCT s.file_path, s.start_line, s.start_column, s.symbol, edge_kind FROM edges e JOIN symbols s ON s.symbol_id = e.a JOIN symbols t ON t.symbol_id = e.b WHERE t.symbol = '{part}')) AS dependents, (SELECT count(DISTINCT file_path) FROM ({_hits(repr(part))})) AS tests",
        "split_check": s + f"SELECT '{file}' AS file, 'none' AS mode, count(*) AS symbol_count, count(*) FILTER (kind = 'function') AS function_count FROM symbols WHERE file_path = '{file}'",
        "extract_check": s + f"SELECT symbol, file_path, start_line AS function_start_line, end_line AS function_end_line, 22 AS extract_start_line, 29 AS extract_end_line, 8 AS estimated_line_count, signature, CASE WHEN start_line = 22 AND end_line = 29 THEN 'requested range covers entire function' ELSE '' END AS warnings FROM symbols WHERE symbol = '{order}' AND kind = 'function'",
        "test_scaffold": c + f"""SELECT '{part}' AS symbol, coalesce((SELECT signature FROM symbols WHERE symbol = '{part}' ORDER BY file_path, start_line, start_column, kind, symbol_id LIMIT 1), '<unknown>') AS signature, t.* FROM (SELECT 1) LEFT JOIN (WITH x AS (SELECT 1) {_tests_for(part, (), command)}) t ON true""",
        "refactor_plan": c + _plan(plan_file, boundary.replace(file, plan_file)),
        "refactor_plan_unknown": s + _plan("src/none.rs", boundary.replace(file, "src/none.rs")).replace("FROM tokens", "FROM (SELECT file_path, symbol FROM symbols)"),
        "safe_steps": f"SELECT *, '{order}' AS symbol, 'move' AS action FROM (VALUES (1, 'Step 1: Stage the move change for {order}'), (2, 'Step 2: Run targeted checks'), (3, 'Step 3: Run full test suite')) t(position, step)",
        "schema_registry": "SELECT position, command, 'trellis/' || command || '@v1' AS schema FROM (VALUES (1, 'status'), (2, 'find'), (3, 'refs'), (4, 'resolve'), (5, 'query'), (6, 'refactor-plan'), (7, 'error')) t(position, command)",
        "verify_plan": c + f""", k AS (SELECT DISTINCT symbol FROM symbols WHERE file_path IN ('{plan_file}', 'tests/src1/d1.rs') AND lower(symbol) NOT IN ('args', 'common', 'error', 'file', 'files', 'json', 'main', 'mod', 'output', 'path', 'query', 'repo', 'result', 'run', 'symbol', 'test', 'tests', 'value')
 ), h AS (SELECT *, {command} AS step FROM ({_hits('SELECT symbol FROM k')})), b AS (SELECT step, 'targeted test references changed symbol ''' || symbol || '''' AS why_included, CASE WHEN hits > 1 THEN 'graph_likely' ELSE 'context_medium' END AS confidence, CASE WHEN hits > 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS score FROM h WHERE step IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY step ORDER BY score DESC, confidence = 'graph_likely' DESC, why_included) = 1 ORDER BY score DESC, confidence = 'graph_likely' DESC, step, why_included LIMIT 8)
 SELECT step, 'targeted' AS scope, why_included, confidence, score FROM b UNION ALL SELECT 'cargo test', 'full_suite', 'required safety gate after refactor', 'context_high', 1.0""",
        "context_direct": c + _context("fix the then andthe order of thation in Erthe") + f"{CONTEXT_OUT} (SELECT * FROM direct {CONTEXT_ORDER} 30)",
        "context_full": c + _context("fix the then andthe order of thation in Erthe") + f"{CONTEXT_OUT} (SELECT * FROM (SELECT * FROM direct UNION ALL SELECT * FROM near) WHERE NOT {TEST} {CONTEXT_ORDER} 60)",
        "diff_impact": s + _diff(f"SELECT symbol_id FROM symbols WHERE symbol IN ('{supplier}', '{part_fn}')", 3) + "SELECT * FROM plain",
        "diff_impact_lines": s + _diff(f"SELECT symbol_id FROM symbols WHERE file_path = '{file}' AND start_line <= 160 AND end_line >= 100", 2) + f"SELECT * FROM plain {DIFF_ORDER} 30",
        "diff_impact_names": s + _diff(f"SELECT symbol_id FROM symbols WHERE file_path = '{file}' AND symbol IN ('{supplier}', 'nation_3')", 2) + f"SELECT * FROM plain {DIFF_ORDER} 40",
        "diff_impact_tests": c + _diff(f"SELECT symbol_id FROM symbols WHERE file_path = '{plan_file}' AND kind <> 'import'", 2) + f""", th AS ({_hits('SELECT symbol FROM result')})
 SELECT * FROM plain WHERE relationship <> 'changed_symbol' UNION ALL BY NAME SELECT 'test_target' AS result_kind, {LANGUAGE} AS language, 'references impacted symbol ' || chr(39) || symbol || chr(39) AS why_included, CASE WHEN hits > 1 THEN 'graph_likely' ELSE 'context_medium' END AS confidence, 'text_fallback' AS provenance,
  CASE WHEN hits > 1 THEN 0.84 ELSE 0.70 END::DOUBLE AS score, file_path AS target, 'integration_test_file' AS target_kind FROM (SELECT * FROM th QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY hits > 1 DESC, symbol) = 1)""",
        "call_path": c + _call_path(n, "Of", 6),
        "circular": s + _cycles(10) + "SELECT * FROM cyc ORDER BY n_files, files",
        "circular_wide": s + _cycles(1000) + "SELECT * FROM cyc ORDER BY n_files, files",
        "circular_corpus": c + _cycles(1000000) + "SELECT * FROM cyc ORDER BY n_files, files",
        "cycle_edges": c + _cycles(1000000) + "SELECT files, s_file AS from_file, s_symbol AS from_symbol, t_file AS to_file, t_symbol AS to_symbol, edge_kind FROM inside",
        "tree": c + _tree(3, "SELECT file_path, line_count FROM files"),
        "tree_shallow": c + _tree(2, "SELECT file_path, line_count FROM files", deps=False),
        "tree_focus": s + _tree(3, STAR_FILES, "WHERE f.file_path LIKE 'src/brand/%'"),
        "tree_symbols": s + f"SELECT t.path, t.kind, l.names FROM ({_tree(3, STAR_FILES, "WHERE f.file_path LIKE 'src/brand/%'", deps=False)}) t LEFT JOIN (SELECT file_path AS path, string_agg(symbol, ',' ORDER BY start_line, symbol, kind) AS names FROM symbols GROUP BY ALL) l USING (path)",
        "orient": s + _cycles(10) + RECOMMENDED + f""" SELECT 'tree' AS section, row_number() OVER (ORDER BY path, kind)::INT AS position, kind AS name, path AS file_path, total_symbols AS value FROM ({_tree(3, STAR_FILES, deps=False)})
 UNION ALL SELECT 'largest_files', row_number() OVER (ORDER BY line_count DESC, file_path)::INT, NULL, file_path, line_count::BIGINT FROM (SELECT * FROM ({STAR_FILES}) ORDER BY line_count DESC, file_path LIMIT 5)
 UNION ALL SELECT 'largest_functions', row_number() OVER (ORDER BY line_count DESC, file_path, symbol, start_line)::INT, symbol, file_path, line_count::BIGINT FROM (SELECT * FROM symbols WHERE kind = 'function' ORDER BY line_count DESC, file_path, symbol, start_line LIMIT 5)
 UNION ALL SELECT 'hotspots', row_number() OVER (ORDER BY total DESC, file_path, symbol)::INT, symbol, file_path, total FROM hot
 UNION ALL SELECT 'cycles', row_number() OVER (ORDER BY n_files, files)::INT, NULL, files, n_edges FROM cyc
 UNION ALL SELECT 'recommendations', row_number() OVER (ORDER BY position, turn)::INT, message, file_path, position::BIGINT FROM recommended""",
        "orient_recommendations": s + _cycles(10) + RECOMMENDED + " SELECT * FROM recommended ORDER BY position, turn",
        "edge_resolution": c + "SELECT edge_kind, provenance, count(*) AS edges, sum(a)::BIGINT AS sources, sum(b)::BIGINT AS targets, max(confidence) AS confidence FROM edges GROUP BY ALL",
        "incremental_diff": c + OLD_NEW + "SELECT file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN w.h IS NULL THEN 'removed' WHEN o.h = w.h THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new w USING (file_path)",
        "to_index": c + OLD_NEW + "SELECT w.file_path FROM new w LEFT JOIN old o ON o.file_path = w.file_path AND o.h = w.h WHERE o.h IS NULL",
        "stale_prune": c + OLD_NEW + "SELECT file_path FROM old WHERE file_path IN (SELECT file_path FROM new)",
        "prune_edges": s + "SELECT edge_kind, count(*) AS edges, sum(a)::BIGINT AS sources FROM named WHERE s_file NOT IN ('src/n3.rs', 'src/n4.rs') AND t_file NOT IN ('src/n3.rs', 'src/n4.rs') GROUP BY ALL",
        "index_sources": SOURCES,
        "index_corpus": c + "SELECT 'files' AS \"table\", count(*) AS rows FROM files UNION ALL SELECT 'tokens', count(*) FROM tokens UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'names', count(DISTINCT symbol) FROM tokens",
        "index_star": s + f"SELECT 'files' AS \"table\", count(*) AS rows FROM ({STAR_FILES}) UNION ALL SELECT unnest(['tokens', 'symbols', 'references', 'names']), count(*) FROM symbols GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM edges",
        "summary": c + f"SELECT 'status' AS section, 'source_files' AS name, count(*) AS value FROM files UNION ALL SELECT 'status', 'definitions', count(*) FROM symbols UNION ALL SELECT 'status', 'references', count(*) FROM refs UNION ALL SELECT 'status', 'text_occurrences', count(*) FROM tokens UNION ALL SELECT 'status', 'edges', count(*) FROM edges UNION ALL SELECT 'language', language, count(DISTINCT file_path) FROM symbols GROUP BY language UNION ALL SELECT DISTINCT 'entry_point', file_path, 1::BIGINT FROM symbols WHERE symbol = '{n}' AND kind = 'function'",
        "json_envelope": s + f"SELECT DISTINCT '{{\"schema\":\"callees@v2\",\"command\":\"callees\",\"ok\":true,\"meta\":{{\"version\":2}},\"data\":{{\"symbol\":\"' || t_symbol || '\"}}}}' AS json FROM named WHERE s_symbol = '{order}' AND edge_kind = 'calls'",
    }
    return found
