"""Retrieval and orientation: task context, directory tree, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import workdir
from ..functions import paths, scoring
from ..functions import text as tx
from ..schemas import Index
from . import diagnostics, graph
from .lookup import first_by


def context(ix: Index, task: str, budget: int = 1200, neighbours: bool = True, code_only: bool = False, exclude_tests: bool = False) -> DataFrame:
    """Symbols whose name shares words with a task, and what they lead to, best first; budget / 200 rows, at least one."""
    words = tx.task_keywords(F.lit(task))
    own = tx.symbol_keywords(F.col("symbol"))
    matched = tx.matched_keywords(words, F.col("own"))
    exact = F.array_contains(words, F.lower("symbol")).cast("int")
    hit = ix.symbols.select("symbol_id", "file_path", "symbol", "kind", "start_line", "start_column", "end_line", own.alias("own")).withColumn("matched", matched).where(F.size("matched") > 0)
    hit = hit.withColumn("exact", exact).withColumn("score", scoring.context_score(F.size("matched"), F.size("own"), F.col("exact")))
    listed = F.array_join("matched", ", ")
    strong = (F.size("matched") >= 2) | (F.col("exact") == 1)
    key = ["file_path", "start_line", "symbol", "kind"]
    direct = first_by(hit, key, ["start_column"]).select(
        *key, "end_line", F.concat(F.lit("direct definition token-overlap relevance for ["), listed, F.lit("]")).alias("why_included"), F.when(strong, "context_high").otherwise("context_medium").alias("confidence"), "score",
    )
    out = direct
    if neighbours:
        e = ix.outgoing.join(hit.select(F.col("symbol_id").alias("from_symbol_id"), F.col("symbol").alias("of"), listed.alias("words"), F.col("score").alias("direct"), F.col("file_path").alias("of_file"), F.col("start_line").alias("of_line"), F.col("start_column").alias("of_column")), "from_symbol_id")
        n = e.join(ix.symbols, F.col("to_symbol_id") == F.col("symbol_id"))
        n = first_by(n, key, ["of_file", "of_line", "of_column", "of"]).select(
            *key, "end_line", F.concat(F.lit("graph neighbor of '"), "of", F.lit("' from token-overlap relevance ["), "words", F.lit("]")).alias("why_included"), F.lit("context_medium").alias("confidence"),
            F.greatest(F.col("direct") - 0.2, F.lit(0.55)).alias("score"),
        )
        out = direct.unionByName(n)
    out = out.where(paths.query_scope(F.col("file_path"), code_only, exclude_tests))
    return out.orderBy(F.desc("score"), "file_path", "start_line", "symbol", "kind", "end_line", "why_included").limit(max(1, budget // 200))


def tree(ix: Index, depth: int = 3, focus: str | None = None, deps: bool = True, symbols: bool = False) -> DataFrame:
    """Directories and files to a depth, parents first, then directories before files by name.

    Directories have the files and symbols of all below them. Files have their
    lines and symbols, with deps the files they use and are used by, and with
    symbols their symbols by place. The lists of one file stand in one row.
    """
    per = ix.symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"))
    files = ix.files.select("file_path", "line_count").join(per, "file_path", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
    if focus:
        files = files.where(F.col("file_path").startswith(focus.rstrip("/") + "/") | (F.col("file_path") == focus))
    parts = F.split("file_path", "/")
    # depth 0 is the root, whose children stand at depth 1
    each = files.select("file_path", "line_count", "symbol_count", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(depth)))).alias("depth"))
    is_file = F.size("parts") == F.col("depth")
    path = F.when(F.col("depth") == 0, ".").otherwise(F.array_join(F.slice("parts", F.lit(1), F.greatest("depth", F.lit(1))), "/"))
    nodes = each.groupBy(path.alias("path"), "depth", F.when(is_file, "file").otherwise("directory").alias("kind")).agg(
        F.max(F.when(is_file, F.col("line_count"))).alias("line_count"), F.coalesce(F.sum(F.when(is_file, F.col("symbol_count"))), F.lit(0)).alias("symbol_count"), F.count("*").alias("total_files"), F.sum("symbol_count").alias("total_symbols"),
    )
    for name, near, far in (("imports", "from_file", "to_file"), ("used_by", "to_file", "from_file")):
        if deps:
            listed = graph.file_edges(ix).groupBy(F.col(near).alias("path")).agg(F.array_join(F.array_sort(F.collect_list(far)), ",").alias(name))
            listed = listed.withColumn("kind", F.lit("file"))
            nodes = nodes.join(listed, ["path", "kind"], "left")
        else:
            nodes = nodes.withColumn(name, F.lit(None).cast("string"))
    if symbols:
        listed = ix.symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("start_line", "symbol", "kind"))).alias("symbols")).withColumn("kind", F.lit("file"))
        nodes = nodes.join(listed, ["path", "kind"], "left")
    # a parent's path and its child's differ by one part; directories sort before files below the same parent
    key = F.transform(F.split("path", "/"), lambda x, i: F.concat(F.when((F.col("kind") == "file") & (i == F.size(F.split("path", "/")) - 1), "1").otherwise("0"), x))
    return nodes.orderBy(F.when(F.col("depth") == 0, F.array().cast("array<string>")).otherwise(key))


def orient(ix: Index, depth: int = 3, top: int = 5) -> DataFrame:
    """tree, health, hotspots, cycles and recommendations as one report: section, position, name, file_path, value."""
    spark = ix.symbols.sparkSession
    cycles = workdir.stage(graph.circular(ix, 10), "cycles")

    def rows(section: str, df: DataFrame, name, file, value, order: list) -> DataFrame:
        # each section is bounded by its limit or by the depth of the tree
        position = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order))
        return df.select(F.lit(section).alias("section"), position.alias("position"), name.alias("name"), file.alias("file_path"), value.cast("long").alias("value"))

    hot = graph.hotspots(ix, 10)
    none = F.lit(None).cast("string")
    report = rows("tree", tree(ix, depth, deps=False), F.col("kind"), F.col("path"), F.col("total_symbols"), ["path", "kind"])
    for df in (
        rows("largest_files", diagnostics.health_files(ix, top), none, F.col("file_path"), F.col("line_count"), [F.desc("line_count"), "file_path"]),
        rows("largest_functions", diagnostics.health_functions(ix, top), F.col("symbol"), F.col("file_path"), F.col("line_count"), [F.desc("line_count"), "file_path", "symbol", "start_line"]),
        rows("hotspots", hot, F.col("symbol"), F.col("file_path"), F.col("total"), [F.desc("total"), "file_path", "symbol"]),
        rows("cycles", cycles, none, F.col("files"), F.col("n_edges"), ["n_files", "files"]),
        rows("recommendations", recommendations(ix, cycles, top), F.col("message"), F.col("file_path"), F.col("position"), ["position", "turn"]),
    ):
        report = report.unionByName(df)
    return report.orderBy("section", "position")


def recommendations(ix: Index, cycles: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Where to start, where to be careful (in the order of the hotspots), and whether there are cycles: position, turn, kind, message, file_path."""
    hot = graph.hotspots(ix, 10)
    # the last of equal ones in the hotspots' order
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "file_path", "symbol"))
    hot = workdir.stage(hot.withColumn("turn", turn), "hotspots")
    best = hot.agg(F.max_by(F.struct("file_path", "fan_out"), F.struct("fan_out", "turn")).alias("m")).where("m is not null")
    start = best.select(F.lit(1).alias("position"), F.lit(1).alias("turn"), F.lit("start_exploring").alias("kind"), F.concat(F.lit("Start exploring: "), F.col("m.file_path"), F.lit(" (entry point, "), F.col("m.fan_out").cast("string"), F.lit(" symbols)")).alias("message"), F.col("m.file_path").alias("file_path"))
    large = diagnostics.health_files(ix, min(top, 5)).select("file_path")
    care = hot.where("fan_in > 0").join(large, "file_path", "left_semi").groupBy("file_path").agg(F.min("turn").alias("turn"))
    care = care.select(F.lit(2).alias("position"), "turn", F.lit("careful_around").alias("kind"), F.concat(F.lit("Careful around: "), "file_path", F.lit(" (large file, high fan-in)")).alias("message"), "file_path")
    out = start.unionByName(care)
    cycles = graph.circular(ix) if cycles is None else cycles
    n = cycles.agg(F.count("*").alias("n")).where("n > 0")
    text = F.concat(F.col("n").cast("string"), F.lit(" circular dependency cycle"), F.when(F.col("n") == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" detected"))
    out = out.unionByName(n.select(F.lit(3).alias("position"), F.lit(1).alias("turn"), F.lit("cycle_warning").alias("kind"), text.alias("message"), F.lit(None).cast("string").alias("file_path")))
    return out.orderBy("position", "turn")
