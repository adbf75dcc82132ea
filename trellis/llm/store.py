"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import drop, forget, fresh_path, mark, release, shared_dir, stage  # noqa: F401

#: Edges (16 bytes each) that one task may contract at once.
ONE_TASK = 500_000

#: Rows of whole texts that are handed to Python at once.
BATCH_ROWS = 1000

_caches: dict[str, dict] = {}
_owner: str | None = None


def trim() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def trimmed(run):
    """run over batches; when a task's are done its worker, which waits for the next task, keeps no free memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def worker_cache(owner: str) -> dict:
    """This worker's cache for an operator; what another operator left in the same worker is released, also to the system."""
    global _owner
    if _owner != owner:
        for kept in _caches.values():
            kept.clear()
        gc.collect()
        trim()
        _owner = owner
    return _caches.setdefault(owner, {})


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_ROWS rows, so that a worker's memory stays bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_by_size(df: DataFrame, each: int) -> int:
    """Parts of about so many bytes of input each, by the size of the tables that are read (a projection would be guessed too small); at least as many as shuffles have."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n, size = shuffle_partitions(df.sparkSession), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return max(n, min(100_000, size // each)) if size < 10**15 else n


def parts_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / each))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges a - b but a component's smallest, with that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label
        low = np.minimum(label[x], label[y])
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _contract(batches):
    """A partition's edges as the stars of their components."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of edges (a long, b long): (id, root), root the smallest id; nodes without edges don't occur.

    Every partition first contracts its own edges. If at most one_task edges
    are left, which is counted, one task (never the driver) contracts those.
    Beyond, large-star and small-star steps alternate: each is a grouped minimum
    (combined map-side, so a node with very many edges is one row a task) and a
    join back, whose hot keys AQE may split. Rounds grow with the logarithm of
    the longest chain; each ends in a staged table.
    """
    both = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs, before = stage(both.mapInArrow(_contract, "u long, v long"), "cc"), None
    if pairs.count() <= one_task:
        done = stage(pairs.repartition(1).mapInArrow(_contract, "u long, v long"), "cc")
        forget(pairs)
        pairs, most_rounds = done, 0
    for _ in range(most_rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        done = stage(small, "cc")
        state = tuple(done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(pairs)
        pairs = done
        if state == before:
            break
        before = state
    else:
        if most_rounds:
            raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
