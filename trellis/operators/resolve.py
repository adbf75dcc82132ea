"""Resolution of edge candidates to symbols, and incremental maintenance of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import workdir


def resolve(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of candidates (from_symbol_id, file_path, symbol, language, edge_kind, confidence, provenance[, qualified_symbol]).

    Tiers: the qualified name (then nothing else), the same file, the only
    symbol of that name in the language (imports count against it). The first
    match by non-import, file, line, column wins. Import and implements edges
    to an import are dropped; of equal edges the last stays (by turn, where the candidates have one).
    """
    best = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy((F.col("kind") == "import").cast("int"), "file_path", "start_line", "start_column", "symbol_id"))
    in_file = symbols.withColumn("n", best("file_path", "symbol")).where("n = 1").select("file_path", "symbol", F.col("symbol_id").alias("file_id"), F.col("kind").alias("file_kind"))
    only = symbols.groupBy("language", "symbol").agg(F.count("*").alias("n"), F.min("symbol_id").alias("only_id"), F.min("kind").alias("only_kind")).where("n = 1").drop("n")
    found = wanted.join(in_file, ["file_path", "symbol"], "left").join(only, ["language", "symbol"], "left")
    target, kind = F.coalesce("file_id", "only_id"), F.coalesce("file_kind", "only_kind")
    if "qualified_symbol" in wanted.columns:
        exact = symbols.withColumn("n", best("qualified_symbol")).where("n = 1").select("qualified_symbol", F.col("symbol_id").alias("exact_id"), F.col("kind").alias("exact_kind"))
        found = found.join(exact, "qualified_symbol", "left")
        named = F.col("qualified_symbol").isNotNull()
        target = F.when(named, F.coalesce("exact_id", "file_id")).otherwise(target)
        kind = F.when(named, F.coalesce("exact_kind", "file_kind")).otherwise(kind)
    found = found.select("from_symbol_id", target.alias("to_symbol_id"), kind.alias("to_kind"), "edge_kind", "confidence", "provenance", *(["turn"] if "turn" in wanted.columns else []))
    found = import_guard(found.where("to_symbol_id is not null and from_symbol_id <> to_symbol_id"))
    return upsert_edges(found.drop("to_kind"))


def import_guard(edges: DataFrame) -> DataFrame:
    """Without imports and implements edges whose target (to_kind) is itself an import."""
    return edges.where(~(F.col("edge_kind").isin("imports", "implements") & (F.col("to_kind") == "import")))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, kind): the last written one, by turn; without turns, or of one turn, the one of greatest confidence."""
    last = F.struct(F.col("turn") if "turn" in edges.columns else F.lit(0).alias("turn"), "confidence", "provenance")
    return edges.groupBy("from_symbol_id", "to_symbol_id", "edge_kind").agg(F.max(last).alias("m")).select("from_symbol_id", "to_symbol_id", "edge_kind", "m.confidence", "m.provenance")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, state (added, changed, unchanged, removed) of two snapshots' files (file_path, content_hash)."""
    o = old.select("file_path", F.col("content_hash").alias("old_hash"))
    n = new.select("file_path", F.col("content_hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return n.join(o, "file_path", "full").select("file_path", state.alias("state"))


def to_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files whose content is not indexed yet."""
    return new.join(old.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


def prune(table: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of files that still exist."""
    return table.join(live.select("file_path").distinct(), "file_path", "left_semi")


def prune_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges both of whose ends still exist."""
    ids = symbols.select("symbol_id")
    return edges.join(ids, edges.from_symbol_id == ids.symbol_id, "left_semi").join(ids, edges.to_symbol_id == ids.symbol_id, "left_semi")


def stable_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids for new's symbols (no symbol_id): reused by (file, symbol, kind), oldest first, else numbered on from the greatest.

    The numbers of new ids are dense: range parts of the order are counted, and
    each part starts where the parts before it end.
    """
    key = ["file_path", "symbol", "kind"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    known = old.select(*key, "symbol_id").withColumn("nth", nth(["symbol_id"]))
    joined = new.withColumn("nth", nth(["start_line", "start_column"])).join(known, [*key, "nth"], "left").drop("nth")
    fresh = joined.where("symbol_id is null").drop("symbol_id")
    parts = fresh.repartitionByRange(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_path", "start_line", "start_column", "symbol").withColumn("part", F.spark_partition_id())
    order = ["file_path", "start_line", "start_column", "symbol", "kind"]
    parts = workdir.stage(parts, "numbers")  # a part that is computed again must not get other numbers
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    top = old.agg(F.coalesce(F.max("symbol_id"), F.lit(0))).first()[0]
    numbered = parts.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(before), "part")
    numbered = numbered.withColumn("symbol_id", F.lit(top) + F.col("before") + F.col("i")).drop("part", "i", "before")
    return joined.where("symbol_id is not null").unionByName(numbered)
