"""Graph queries over symbols and typed edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import workdir
from ..functions import paths, scoring
from ..schemas import Index, picked
from .lookup import first_by, path_filter, qualified

#: Distinct file edges (two paths each) that one task searches for strong components; more are coloured on the cluster.
ONE_TASK = 200_000
#: Up to so many bytes of cycles' lists of files are handed to all tasks at once.
LISTS = 16 << 20


def _ends(symbols: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return symbols.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("symbol_id", *columns)])


def enriched(ix: Index, *columns: str) -> DataFrame:
    """Edges with the given columns of both ends, as src_* and dst_*."""
    e = ix.edges.join(_ends(ix.symbols, "src", *columns), F.col("from_symbol_id") == F.col("src_symbol_id"))
    return e.join(_ends(ix.symbols, "dst", *columns), F.col("to_symbol_id") == F.col("dst_symbol_id"))


def _neighbours(ix: Index, symbol: str, near: str, far: str, kinds: list[str] | None = None) -> DataFrame:
    """Edges of a name's definitions with the symbols at their other end. Both lookups push their ids to the scan where these are few."""
    named = ix.symbols.where(F.col("symbol") == symbol).select("symbol_id")
    e = picked(ix.edges if near == "to_symbol_id" else ix.outgoing, near, named)
    if kinds:
        e = e.where(F.col("edge_kind").isin(kinds))
    return e.join(picked(ix.by_id, "symbol_id", e.select(far)), F.col(far) == F.col("symbol_id"))


def _edge_matches(rows: DataFrame, include_fixtures: bool) -> DataFrame:
    out = rows.select("file_path", "symbol", "kind", F.col("start_line").alias("line"), F.col("start_column").alias("column"), "confidence")
    return out.orderBy(paths.priority_rank(F.col("file_path"), include_fixtures), "file_path", "line", "column", "symbol", "kind")


def callers(ix: Index, symbol: str, include_fixtures: bool = False) -> DataFrame:
    """A row for each call of each definition of a name; code before tests before fixtures, then by place."""
    return _edge_matches(_neighbours(ix, symbol, "to_symbol_id", "from_symbol_id", ["calls"]), include_fixtures)


def callees(ix: Index, symbol: str, include_fixtures: bool = False) -> DataFrame:
    return _edge_matches(_neighbours(ix, symbol, "from_symbol_id", "to_symbol_id", ["calls"]), include_fixtures)


def impact(ix: Index, symbol: str, include_fixtures: bool | None = None, **filters) -> DataFrame:
    """Dependents at distance 1 of all definitions of a name, best score first.

    With include_fixtures given, the caller's path penalties and path order
    hold too, and filters are those of lookup.path_filter.
    """
    relation = scoring.relationship(F.col("edge_kind"))
    provenance = scoring.normalized_provenance(F.col("provenance"), F.col("edge_kind"))
    score = scoring.semantic_score(provenance, relation, F.lit(1))
    p = F.col("file_path")
    if include_fixtures is not None:
        score = scoring.preference(score, p, include_fixtures)
    rows = _neighbours(ix, symbol, "to_symbol_id", "from_symbol_id").select(
        "symbol", "kind", "file_path", F.col("start_line").alias("line"), F.col("start_column").alias("column"), F.lit(1).alias("distance"), relation.alias("relationship"), scoring.semantic_confidence(provenance).alias("confidence"), score.alias("score"),
    )
    rows = first_by(rows, ["file_path", "line", "column", "symbol", "relationship"], [F.desc("score"), "kind", "confidence"]).where(path_filter(p, **filters))
    by_path = [] if include_fixtures is None else [paths.priority_rank(p, include_fixtures)]
    return rows.orderBy(F.desc("score"), *by_path, "file_path", "line", "column", "symbol", "relationship")


def hotspots(ix: Index, limit: int = 10) -> DataFrame:
    """Symbols of most distinct neighbours. Each side is aggregated alone, then joined by id."""
    fan_in = ix.edges.groupBy(F.col("to_symbol_id").alias("symbol_id")).agg(F.count_distinct("from_symbol_id").alias("fan_in"))
    fan_out = ix.edges.groupBy(F.col("from_symbol_id").alias("symbol_id")).agg(F.count_distinct("to_symbol_id").alias("fan_out"))
    both = fan_in.join(fan_out, "symbol_id", "full").select("symbol_id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    total = both.withColumn("total", F.col("fan_in") + F.col("fan_out")).where("total > 0")
    return total.join(ix.symbols, "symbol_id").select("symbol", "file_path", "kind", "fan_in", "fan_out", "total").orderBy(F.desc("total"), "file_path", "symbol").limit(limit)


def file_edges(ix: Index) -> DataFrame:
    """Edges between files, with their number."""
    e = enriched(ix, "file_path").where("src_file_path <> dst_file_path")
    return e.groupBy(F.col("src_file_path").alias("from_file"), F.col("dst_file_path").alias("to_file")).agg(F.count("*").alias("edge_count"))


def dependencies(ix: Index, file: str) -> DataFrame:
    """Files that a file depends on, then those that depend on it, each by falling number of edges."""
    mine = ix.by_file.where(F.col("file_path") == file).select("symbol_id")

    def side(edges: DataFrame, near: str, far: str, direction: str) -> DataFrame:
        e = picked(edges, near, mine)
        ends = picked(ix.by_id, "symbol_id", e.select(far)).select(F.col("symbol_id").alias(far), "file_path").where(F.col("file_path") != file)
        return e.join(ends, far).groupBy("file_path").agg(F.count("*").alias("edge_count")).select(F.lit(direction).alias("direction"), "file_path", "edge_count")

    out = side(ix.outgoing, "from_symbol_id", "to_symbol_id", "depends_on").unionByName(side(ix.edges, "to_symbol_id", "from_symbol_id", "depended_on_by"))
    return out.orderBy(F.desc("direction"), F.desc("edge_count"), "file_path")


def related(ix: Index, symbol: str, include_fixtures: bool = False) -> DataFrame:
    """Siblings in the file of a name's first definition, and other symbols that its callers call; each name once, siblings first."""
    target = ix.symbols.where(F.col("symbol") == symbol).orderBy("file_path", "symbol_id").limit(1).select("symbol_id", "file_path")
    first = target.select("symbol_id")
    siblings = picked(ix.by_file, "file_path", target.select("file_path")).select("symbol", "file_path", "kind", F.lit("sibling").alias("relationship"))
    who = picked(ix.edges, "to_symbol_id", first).where("edge_kind = 'calls'").select("from_symbol_id")
    called = picked(ix.outgoing, "from_symbol_id", who).where("edge_kind = 'calls'").select("to_symbol_id")
    shared = picked(ix.by_id, "symbol_id", called).select("symbol", "file_path", "kind", F.lit("shared_caller").alias("relationship"))
    rows = siblings.unionByName(shared).where(F.col("symbol") != symbol)
    rows = first_by(rows, ["symbol"], [(F.col("relationship") == "shared_caller").cast("int"), "file_path", "kind"])
    return rows.orderBy(paths.priority_rank(F.col("file_path"), include_fixtures), "file_path", "symbol", "relationship", "kind")


def changed_symbols(ix: Index, files: list[str], lines: DataFrame | None = None, names: list[str] = (), include_imports: bool = False) -> DataFrame:
    """Symbols of changed files; lines (file_path, start_line, end_line) narrows files that it names to overlapping ones."""
    s = ix.by_file.where(F.col("file_path").isin(list(files)))
    if not include_imports:
        s = s.where("kind <> 'import'")
    if names:
        s = s.where(F.col("symbol").isin(list(names)))
    if lines is None:
        return s
    r = lines.select(F.col("file_path").alias("r_file"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    hit = s.join(r, (F.col("file_path") == F.col("r_file")) & (F.col("start_line") <= F.col("r_end")) & (F.col("end_line") >= F.col("r_start")), "left_semi")
    whole = s.join(lines.select(F.col("file_path").alias("r_file")).distinct(), F.col("file_path") == F.col("r_file"), "left_anti")
    return hit.unionByName(whole)


IMPACTED = (
    "symbol", "qualified_symbol", "kind", "language", "file_path", "line", "column", "distance", "relationship", "why_included", "confidence", "provenance", "score",
)


def diff_impact(ix: Index, changed: DataFrame, distance: int = 2, limit: int | None = 30, exclude_changed: bool = False, with_tests: bool = False) -> DataFrame:
    """Changed symbols and what reaches them over incoming edges, breadth first from each seed.

    Other changed symbols are neither reported nor passed. A node stands at its
    least distance from a seed, once for each relationship and each such
    distance; the reason names the first seed by place. Every hop is staged.
    """
    place = ["file_path", "start_line", "start_column", "symbol", "symbol_id"]
    seeds = workdir.stage(changed.select(F.col("symbol_id").alias("seed"), F.struct(*place).alias("turn"), F.col("symbol").alias("of")), "seeds")
    frontier = seeds.select("seed", F.col("seed").alias("at"))
    visited, reached = frontier, None
    for hop in range(1, distance + 1):
        e = picked(ix.edges, "to_symbol_id", frontier.select("at")).select(F.col("from_symbol_id").alias("node"), F.col("to_symbol_id").alias("at"), "edge_kind", "provenance")
        e = e.join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
        seen = visited.select("seed", F.col("at").alias("node"))
        step = e.join(frontier, "at").join(seen, ["seed", "node"], "left_anti")
        found = workdir.stage(step.select("seed", "node", "edge_kind", "provenance", F.lit(hop).alias("distance")).distinct(), "hop")
        reached = found if reached is None else reached.unionByName(found)
        frontier = found.select("seed", F.col("node").alias("at")).distinct()
        visited = visited.unionByName(frontier)
        if found.isEmpty():
            break
    columns = [F.col("start_line").alias("line"), F.col("start_column").alias("column")]
    out = None
    if reached is not None:
        relation = scoring.relationship(F.col("edge_kind"), F.lit("called_by"))
        provenance = scoring.normalized_provenance(F.col("provenance"), F.col("edge_kind"))
        rows = reached.join(seeds, "seed").select("node", "turn", "of", relation.alias("relationship"), "distance", provenance.alias("provenance"), scoring.semantic_confidence(provenance).alias("confidence"), scoring.semantic_score(provenance, relation, F.col("distance")).alias("score"))
        rows = first_by(rows, ["node", "relationship", "distance"], ["turn", F.desc("score"), "provenance"])
        rows = rows.join(picked(ix.by_id, "symbol_id", rows.select("node")), F.col("node") == F.col("symbol_id"))
        why = F.concat(F.lit("direct "), "relationship", F.lit(" neighbor of changed symbol '"), "of", F.lit("'"))
        out = rows.withColumns({"line": F.col("start_line"), "column": F.col("start_column"), "qualified_symbol": qualified(), "why_included": why}).select(F.lit("impacted_symbol").alias("result_kind"), *IMPACTED)
    own = changed.select(
        F.lit("impacted_symbol").alias("result_kind"), "symbol", qualified().alias("qualified_symbol"), "kind", "language", "file_path", *columns, F.lit(0).alias("distance"), F.lit("changed_symbol").alias("relationship"),
        F.lit("symbol defined in changed file").alias("why_included"), F.lit("graph_exact").alias("confidence"), F.lit("ast_definition").alias("provenance"), F.lit(1.0).alias("score"),
    )
    every = own if out is None else out.unionByName(own)
    if with_tests:  # also of the changed symbols themselves
        tests = test_targets(ix, every.select("symbol").distinct())
    out = every.where("relationship <> 'changed_symbol'") if exclude_changed else every
    if with_tests:
        out = out.unionByName(tests, allowMissingColumns=True)
    else:
        out = out.withColumns({"target": F.lit(None).cast("string"), "target_kind": F.lit(None).cast("string")})
    out = out.orderBy(F.desc("score"), "result_kind", "file_path", "line", "column", "qualified_symbol", "target_kind", "target", "relationship", "distance", "kind")
    return out if limit is None else out.limit(limit)


def test_targets(ix: Index, names: DataFrame) -> DataFrame:
    """Test files that mention one of names (symbol): by their best mention, of equal ones the first name."""
    tokens = picked(ix.tokens, "symbol", names).where(paths.is_test(F.col("file_path")))
    hits = tokens.groupBy("file_path", "symbol").agg(F.count("*").alias("hits"))
    best = first_by(hits, ["file_path"], [F.desc(F.when(F.col("hits") > 1, 1).otherwise(0)), "symbol"])
    return best.select(
        F.lit("test_target").alias("result_kind"), F.col("file_path").alias("target"), F.lit("integration_test_file").alias("target_kind"), paths.language(F.col("file_path")).alias("language"),
        F.concat(F.lit("references impacted symbol '"), "symbol", F.lit("'")).alias("why_included"), scoring.test_target_label(F.col("hits")).alias("confidence"), F.lit("text_fallback").alias("provenance"),
        scoring.test_target_score(F.col("hits")).alias("score"),
    )


def call_path(ix: Index, start: str, goal: str, depth: int = 10) -> DataFrame:
    """The shortest chain of calls between two names; of equals the first by (symbol, file, id), step by step. Rows: position, symbol.

    Each hop is staged: only the last one's best path, at most depth + 1 names, comes to the driver.
    """
    spark = ix.symbols.sparkSession
    first = ix.symbols.where(F.col("symbol") == start).orderBy("file_path", "symbol_id").limit(1)
    step = lambda name, file, node: F.array(F.struct(name.alias("symbol"), file.alias("file_path"), node.alias("id")))
    frontier = workdir.stage(first.select(F.col("symbol_id").alias("at"), step(F.col("symbol"), F.col("file_path"), F.col("symbol_id")).alias("path")), "path")
    visited = frontier.select("at")
    for _ in range(depth):
        calls = picked(ix.outgoing, "from_symbol_id", frontier.select("at")).where("edge_kind = 'calls'").select(F.col("from_symbol_id").alias("at"), F.col("to_symbol_id").alias("next"))
        grown = calls.join(frontier, "at").join(visited.withColumnRenamed("at", "next"), "next", "left_anti")
        grown = grown.join(picked(ix.by_id, "symbol_id", grown.select("next")).select(F.col("symbol_id").alias("next"), "symbol", "file_path"), "next")
        grown = grown.select(F.col("next").alias("at"), "symbol", F.concat("path", step(F.col("symbol"), F.col("file_path"), F.col("next"))).alias("path"))
        grown = workdir.stage(grown.groupBy("at", "symbol").agg(F.min("path").alias("path")), "path")
        hit = grown.where(F.col("symbol") == goal).agg(F.min("path").alias("path")).first().path
        if hit is not None:
            return spark.createDataFrame([(i, r.symbol) for i, r in enumerate(hit)], "position int, symbol string").orderBy("position")
        if grown.isEmpty():
            break
        frontier = grown.select("at", "path")
        visited = visited.unionByName(frontier.select("at"))
    return spark.createDataFrame([], "position int, symbol string")


def strong_components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of components of at least two nodes in a directed graph (from_file, to_file).

    A file graph is small beside its corpus. Up to one_task distinct edges,
    counted first, one task searches it; beyond, forward and backward
    smallest-label propagation with removal runs on the whole cluster.
    """
    edges = workdir.stage(pairs.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")).where("a <> b").distinct(), "file-graph")
    if edges.count() > one_task:
        return coloured_components(edges)

    def search(batches):
        rows = [(a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        found = [(n, min(c)) for c in tarjan(rows) if len(c) > 1 for n in c]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(search, "node string, component string")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without the nodes that nothing enters or leaves, again and again: they are on no cycle."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        kept = workdir.stage(kept.select("a", "b"), "trimmed")
        more = kept.count()
        edges = kept
        if more == n:
            break
        n = more
    return edges


def coloured_components(edges: DataFrame) -> DataFrame:
    """Repeat on edges (a, b): give every node the smallest node that reaches it; what also reaches that node is its component and leaves."""
    spark = edges.sparkSession
    out = spark.createDataFrame([], "node string, component string")

    def spread(e: DataFrame, label: DataFrame) -> DataFrame:
        while True:
            more = e.join(label, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label").unionByName(label).groupBy("node").agg(F.min("label").alias("label"))
            more = workdir.stage(more, "labels")
            if more.exceptAll(label).isEmpty():
                return more
            label = more

    left = trimmed(edges)
    while not left.isEmpty():
        nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        colour = spread(left, nodes.withColumn("label", F.col("node")))
        same = left.join(colour.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
        found = workdir.stage(spread(same.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.where("node = label")).select("node", F.col("label").alias("component")), "found")
        out = out.unionByName(found)
        gone = found.select("node")
        left = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        left = trimmed(workdir.stage(left, "left"))
    many = out.groupBy("component").count().where("count > 1").select("component")
    return out.join(many, "component").select("node", "component")


def tarjan(edges: list[tuple[str, str]]) -> list[set[str]]:
    """Strongly connected components, without recursion."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    found: list[set[str]] = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part: set[str] = set()
                    while node not in part:
                        part.add(stack.pop())
                    on -= part
                    found.append(part)
    return found


def _cycles(ix: Index, longest: int) -> tuple[DataFrame, DataFrame]:
    """(component, files, n_files) of each cycle, and the edges between its files, with their component."""
    e = enriched(ix, "file_path", "symbol").where("src_file_path <> dst_file_path")
    parts = workdir.stage(strong_components(e.select(F.col("src_file_path").alias("from_file"), F.col("dst_file_path").alias("to_file"))), "components")
    few = parts.groupBy("component").agg(F.count("*").alias("n_files")).where(F.col("n_files") <= longest)
    member = parts.join(few.select("component"), "component")
    sized = member.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"), F.count("*").alias("n_files"))
    inside = e.join(member.select(F.col("node").alias("src_file_path"), F.col("component").alias("c1")), "src_file_path").join(member.select(F.col("node").alias("dst_file_path"), F.col("component").alias("c2")), "dst_file_path").where("c1 = c2")
    return sized, inside.withColumnRenamed("c1", "component")


def circular(ix: Index, longest: int = 10) -> DataFrame:
    """Files of each dependency cycle of 2 to longest files, the number of edges inside, and the number of cycles in all."""
    sized, inside = _cycles(ix, longest)
    rows = workdir.stage(sized.join(inside.groupBy("component").agg(F.count("*").alias("n_edges")), "component").select("files", "n_files", "n_edges"), "cycles")
    total = F.lit(rows.count()).cast("long")
    return rows.orderBy("n_files", "files").select(F.array_join("files", ",").alias("files"), "n_files", "n_edges", total.alias("total_cycles"))


def cycle_edges(ix: Index, longest: int = 10) -> DataFrame:
    """The edges of each cycle of circular: a row each, with the files of its cycle.

    A cycle's list of files is as long as the cycle, so rows carry the cycle's
    number through the sort (whose keys are sampled on the driver) and get the
    list after it. All lists name each file once: up to LISTS bytes, counted,
    one scalar holds them; beyond, they are joined and shuffled with the rows.
    """
    sized, inside = _cycles(ix, longest)
    cycles = workdir.stage(sized.select("component", "n_files", F.array_join("files", ",").alias("files")), "cycles")
    numbered = workdir.stage(cycles.withColumn("n", F.row_number().over(Window.orderBy("n_files", "files"))).select("component", "n", "files"), "cycles")
    few = (numbered.agg(F.sum(F.octet_length("files"))).first()[0] or 0) <= LISTS
    rows = inside.join(numbered if not few else numbered.drop("files"), "component").select(
        "n", *([] if few else ["files"]), F.col("src_file_path").alias("from_file"), F.col("src_symbol").alias("from_symbol"), F.col("dst_file_path").alias("to_file"), F.col("dst_symbol").alias("to_symbol"), "edge_kind",
    )
    files = F.col("files")
    if few:
        lists = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "files"))), lambda x: x["files"]).alias("lists"))
        files = F.element_at(lists.scalar(), F.col("n"))
    return rows.orderBy("n", "from_file", "from_symbol", "to_file", "to_symbol", "edge_kind").select(files.alias("files"), "from_file", "from_symbol", "to_file", "to_symbol", "edge_kind")
