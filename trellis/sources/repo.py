"""Repository source: scan a working tree, extract, resolve, and keep a snapshot up to date."""

from __future__ import annotations

import fnmatch
import os
import subprocess
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import workdir
from ..errors import PartialData, StaleIndex
from ..functions import paths
from ..functions import text as tx
from ..operators import resolve as rs
from ..schemas import Index
from . import snapshot
from .extract import EDGE, extract


def _ignored(name: str, folder: bool, rules: list[tuple[str, bool, bool]], relative: str) -> bool:
    hit = False
    for pattern, negative, only_folder in rules:
        if only_folder and not folder:
            continue
        if fnmatch.fnmatch(relative, pattern.lstrip("/")) or ("/" not in pattern.strip("/") and fnmatch.fnmatch(name, pattern)):
            hit = not negative
    return hit


def list_files(root: str) -> Iterator[tuple[str, float]]:
    """(path relative to root, mtime) of files that are neither hidden nor ignored, in path order."""

    def walk(folder: str, rules: list) -> Iterator[tuple[str, float]]:
        own = list(rules)
        for name in (".gitignore", ".ignore"):
            if os.path.isfile(p := os.path.join(folder, name)):
                with open(p, encoding="utf-8", errors="replace") as f:
                    for line in map(str.strip, f):
                        if line and not line.startswith("#"):
                            own.append((line.lstrip("!").rstrip("/"), line.startswith("!"), line.endswith("/")))
        for e in os.scandir(folder):
            relative = os.path.relpath(e.path, root).replace("\\", "/")
            if e.name.startswith(".") or _ignored(e.name, e.is_dir(follow_symlinks=False), own, relative):
                continue
            if e.is_dir(follow_symlinks=False):
                yield from walk(e.path, own)
            elif e.is_file():
                yield relative, e.stat().st_mtime

    yield from sorted(walk(root, []))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """files of a working tree: the driver lists paths, tasks read them. root must be visible to the executors."""
    listed = spark.createDataFrame(list(list_files(root)), "file_path string, mtime double")

    def read(batches):
        for b in batches:
            content = []
            for p in b.column(0).to_pylist():
                with open(os.path.join(root, p), "rb") as f:
                    content.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary())], ["file_path", "mtime", "content"])

    n = max(1, spark.sparkContext.defaultParallelism)
    files = listed.repartition(n).mapInArrow(read, "file_path string, mtime double, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    lines = F.when(text.isNull() | (text == ""), 0).otherwise(F.size(tx.lines(text)))
    return files.select("file_path", F.sha2("content", 256).alias("content_hash"), lines.alias("line_count"), text.alias("text"), "mtime")


def build(files: DataFrame, old: Index | None = None) -> Index:
    """Index of files (file_path, content_hash, line_count, text). With an old snapshot symbol ids are kept where names are."""
    tokens = tx.tokens(files.where("text is not null").select("file_path", "text")).select("file_path", "symbol", "line", "column")
    rows = extract(files)
    named = rows.where("row = 'symbol'").dropDuplicates(["file_path", "symbol", "kind", "start_line", "start_column"])
    plain = named.select(
        "file_path", "symbol", "kind", "language", F.concat("language", F.lit(":"), "file_path", F.lit("::"), "symbol").alias("qualified_symbol"), "container", "start_line", "start_column", "end_line", "end_column", "signature",
        (F.col("end_line") - F.col("start_line") + 1).alias("line_count"),
    )
    if old is None:
        empty = plain.limit(0).withColumn("symbol_id", F.lit(0).cast("long"))
        symbols = rs.stable_ids(empty, plain)
    else:
        symbols = rs.stable_ids(old.symbols, plain)
    references = rows.where("row = 'reference'").select("file_path", "symbol", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    return Index(files.select("file_path", "content_hash", "line_count", "text"), tokens, symbols, references, edges_of(rows.where("row = 'edge'"), symbols))


def edges_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve extracted edges: the first candidate file that defines the name, else the same file, else the language's only one."""
    source = symbols.withColumn("n", F.row_number().over(Window.partitionBy("file_path", "symbol").orderBy("start_line", "start_column"))).where("n = 1")
    source = source.select("file_path", F.col("symbol").alias("from_symbol"), F.col("symbol_id").alias("from_symbol_id"))
    conf = F.when(F.lit(False), F.lit(0.0))
    prov = F.when(F.lit(False), F.lit(""))
    for kind, (c, p) in EDGE.items():
        conf, prov = conf.when(F.col("edge_kind") == kind, c), prov.when(F.col("edge_kind") == kind, p)
    e = edges.select("file_path", "from_symbol", "symbol", "language", "edge_kind", "candidates").join(source, ["file_path", "from_symbol"]).withColumns({"confidence": conf, "provenance": prov})
    tries = e.select("*", F.posexplode("candidates").alias("turn", "candidate"))
    exact = symbols.where("kind <> 'import'").select(F.col("file_path").alias("candidate"), "symbol").distinct()
    first = tries.join(exact, ["candidate", "symbol"]).groupBy("from_symbol_id", "symbol", "edge_kind").agg(F.min(F.struct("turn", "candidate")).alias("m")).select("from_symbol_id", "symbol", "edge_kind", F.col("m.candidate").alias("found"))
    e = e.join(first, ["from_symbol_id", "symbol", "edge_kind"], "left")
    own = F.when(F.col("found").isNotNull(), F.col("found")).when(F.size("candidates") > 0, F.lit("")).otherwise(F.col("file_path"))
    named = F.size("candidates") > 0
    wanted = e.select("from_symbol_id", own.alias("file_path"), "symbol", F.when(named & F.col("found").isNull(), F.lit("-")).otherwise(F.col("language")).alias("language"), "edge_kind", "confidence", "provenance")
    return rs.resolve(wanted.distinct(), symbols)


def save(ix: Index, path: str) -> None:
    """Write a snapshot, sorted for lookups by name, by file and by edge end."""
    snapshot.save(ix, path)


def load(spark: SparkSession, path: str) -> Index:
    return snapshot.load(spark, path)


#: Files whose change makes a snapshot stale.
SOURCE = r"\.(rs|py|go|tsx?|jsx?)$"


def freshness(files: DataFrame, indexed_at: float, index_head: str | None, head: str | None, require: bool = False) -> str:
    """fresh or stale: whether any source file is newer than the snapshot, or the commit differs."""
    newest = files.where(F.col("file_path").rlike(SOURCE)).agg(F.max("mtime")).first()[0]
    state = "stale" if (newest or 0) > indexed_at or (index_head and head and index_head != head) else "fresh"
    if require and state == "stale":
        raise StaleIndex("the index is older than the working tree", "index", {"suggested_fix": "index the working tree again"})
    return state


META = "indexed_at double, head string, indexed_files long, unchanged_files long"


def index(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Index a working tree into path, keeping symbol ids of the snapshot there; gives its summary (META).

    The new snapshot is written beside the old one and takes its place when it is whole.
    """
    files = workdir.stage(scan(spark, root), "scan")
    p, fs = workdir.file_system(spark, path)
    old = load(spark, path) if fs.exists(p) else None
    same = files.join(old.files.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").count() if old else 0
    next_path = f"{path.rstrip('/')}.next"
    save(build(files, old), next_path)
    row = [(time.time(), head(root), files.count() - same, same)]
    spark.createDataFrame(row, META).coalesce(1).write.mode("overwrite").json(f"{next_path}/meta")
    fs.delete(p, True)
    fs.rename(workdir.file_system(spark, next_path)[0], p)
    return spark.read.schema(META).json(f"{path}/meta")


def ensure(spark: SparkSession, root: str, path: str, auto_index: bool = False, require_fresh: bool = False) -> Index:
    """The snapshot at path, made anew if it is missing, or stale and auto_index; raises if it is stale and must not be."""
    p, fs = workdir.file_system(spark, path)
    if not fs.exists(p):
        index(spark, root, path)
    elif auto_index or require_fresh:
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        if freshness(scan(spark, root), meta.indexed_at, meta.head, head(root), require_fresh and not auto_index) == "stale":
            index(spark, root, path)
    return load(spark, path)


def _git(root: str, *args: str) -> list[str]:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout.splitlines()


def head(root: str) -> str | None:
    try:
        return _git(root, "rev-parse", "HEAD")[0]
    except (subprocess.CalledProcessError, IndexError):
        return None


def relative(root: str, named: str) -> str:
    """A named file as the index knows it: relative to root, with forward slashes, without a leading ./"""
    if os.path.isabs(named):
        for base, whole in ((os.path.realpath(root), os.path.realpath(named)), (os.path.realpath(root), named), (root, named)):
            if whole.startswith(base.rstrip("/") + "/"):
                named = whole[len(base.rstrip("/")) + 1 :]
                break
    while named.startswith("./"):
        named = named[2:]
    return named.replace("\\", "/")


def changed_files(root: str, since: str | None = None, unstaged: bool = False, named: list[str] = ()) -> list[str]:
    """Named files, those that differ from a commit, and unstaged ones; sorted, each once."""
    found = {relative(root, n) for n in named}
    if since:
        found |= set(_git(root, "diff", "--name-only", since, "HEAD"))
    if unstaged:
        found |= set(_git(root, "diff", "--name-only"))
    return sorted(found)


def verify_refactor(spark: SparkSession, root: str, before: str, after: str | None = None, strict: bool = False) -> DataFrame:
    """Files between two commits, with what was done to them and whether they are tests.

    Without a later commit nothing is compared. strict: any changed file, and
    anything that kept the comparison from being made, raises PartialData.
    """
    rows: list[list[str]] = []
    warnings: list[str] = []
    if after is None:
        warnings.append("after reference not provided; comparing against working tree")
    else:
        try:
            rows = [line.split("\t") for line in _git(root, "diff", "--name-status", before, after)]
        except subprocess.CalledProcessError as e:
            warnings.append(f"unable to compute git diff between '{before}' and '{after}': {e.stderr}")
    if strict and (warnings or rows):
        why = "; ".join(warnings) or f"{len(rows)} changed file(s) detected"
        raise PartialData(f"verify-refactor strict mode failed: {why}", "verify-refactor", {"changed_files": [r[-1] for r in rows], "warnings": warnings})
    p = F.col("file_path")
    return spark.createDataFrame([(r[-1], r[0][0]) for r in rows], "file_path string, status string").select(p, "status", paths.is_test(p).alias("is_test"), paths.is_code(p).alias("is_code")).orderBy("file_path")
