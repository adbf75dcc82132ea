"""Stored snapshots: an index is built once from its tables, sorted for lookups, and read by every query.

A snapshot is known by what its input files are (path, size, time of change)
and by the code that makes it, so a change of either gives a new one. It is written beside its place and moved
there whole, so a reader never sees half of one, and two builders don't meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workdir
from ..schemas import Index

Build = Callable[[SparkSession, str], Index]
#: Rows of a Parquet page group that lookups skip or read.
ROW_GROUP = 8 << 20
#: Table: its sort order. Ranges are cut over the whole order, so a name that holds a third of all rows spans many files.
LAYOUT = {
    "files": ("file_path",), "tokens": ("symbol", "file_path", "line"), "symbols": ("symbol", "file_path", "start_line"), "references": ("symbol", "file_path", "line"),
    "edges": ("to_symbol_id", "from_symbol_id"), "outgoing": ("from_symbol_id", "to_symbol_id"), "names": ("symbol",), "by_id": ("symbol_id",), "by_file": ("file_path", "start_line"),
}
_open: dict[tuple[str, str], tuple[str, Index]] = {}


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """Of the files of some tables: one listing a table, on the driver."""
    found = []
    for t in tables:
        p, fs = workdir.file_system(spark, f"{sf_dir}/{t}.parquet")
        for s in fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]:
            found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join([_code(), *sorted(found)]).encode()).hexdigest()[:16]


@lru_cache(1)
def _code() -> str:
    """Of the modules that make a snapshot: another version of them makes its own."""
    root = Path(__file__).parent.parent
    sources = sorted([*root.glob("functions/*.py"), *root.glob("sources/*.py"), root / "operators/resolve.py", root / "schemas.py"])
    return hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()


def save(ix: Index, path: str) -> None:
    """Write every table of a snapshot in its order. Tables that others are made from are staged first."""
    spark = ix.symbols.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for name, order in LAYOUT.items():
        df: DataFrame = getattr(ix, name)
        local = "refers" in ix.tokens.columns
        if name == "references" and local:
            continue
        # tokens that know what refers come from the scan in long sorted runs, so a lookup reads some pages of each file
        parts = df if name == "tokens" and local else df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        workdir.write(parts, f"{path}/{name}", compression="zstd", **{"parquet.block.size": ROW_GROUP})
        if name in ("tokens", "symbols", "references", "edges"):
            _reuse(ix, name, spark.read.schema(df.schema).parquet(f"{path}/{name}"))


def _reuse(ix: Index, name: str, stored: DataFrame) -> None:
    """Later tables are made from the stored ones, not from their source again."""
    setattr(ix, name, stored)
    if name == "tokens":
        ix.names = stored.select("symbol").distinct()
    if name == "symbols":
        ix.by_id = ix.by_file = stored
    if name == "edges":
        ix.outgoing = stored


def load(spark: SparkSession, path: str) -> Index:
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in LAYOUT if t != "references"}
    tokens = tables["tokens"]
    if "refers" in tokens.columns:
        tables |= {"tokens": tokens.drop("refers"), "references": tokens.where("refers").drop("refers")}
    else:
        tables["references"] = spark.read.parquet(f"{path}/references")
    return Index(**tables)


def build(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Build, path: str | None = None) -> Index:
    """Build and store a snapshot at path, by default at its place in the shared folder."""
    place = path or f"{workdir.shared_dir(spark)}/trellis-index/{name}-{fingerprint(spark, sf_dir, tables)}"
    since = workdir.mark()
    scratch = workdir.fresh_path(spark, f"index-{name}")
    save(make(spark, sf_dir), scratch)
    p, fs = workdir.file_system(spark, place)
    fs.mkdirs(p.getParent())
    if path:
        fs.delete(p, True)
    if not fs.exists(p):  # else another builder was first
        fs.rename(workdir.file_system(spark, scratch)[0], p)
    workdir.release(since)
    return load(spark, place)


def opened(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Build) -> Index:
    """The stored snapshot of some tables, built where there is none yet."""
    print_ = fingerprint(spark, sf_dir, tables)
    place = f"{workdir.shared_dir(spark)}/trellis-index/{name}-{print_}"
    key = (spark.sparkContext.applicationId, place)
    if key not in _open:
        p, fs = workdir.file_system(spark, place)
        _open[key] = (place, load(spark, place) if fs.exists(p) else build(spark, sf_dir, name, tables, make))
    return _open[key][1]


def summary(ix: Index) -> DataFrame:
    """Rows of each table of a snapshot."""
    out = None
    for name in ("files", "tokens", "symbols", "references", "edges", "names"):
        one = getattr(ix, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
