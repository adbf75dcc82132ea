"""The folder that the driver and all executors share, for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: str | None = None
_used: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a folder of our own only where driver and executors are one process."""
    global _fallback
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        _fallback = _fallback or tempfile.mkdtemp(prefix="trellis-")
        found = f"file://{_fallback}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own, removed when the driver ends."""
    path = f"{shared_dir(spark)}/trellis/{name}-{uuid.uuid4().hex[:12]}"
    _used.append((weakref.ref(spark), path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, **options) -> None:
    """Write df as Parquet; its shuffle files go when it is written, not when the driver happens to collect garbage."""
    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def forget(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trellis/" in f:
            drop(df.sparkSession, f)


def mark() -> int:
    """A point in the list of what was staged, for release."""
    return len(_used)


def release(since: int) -> None:
    """Remove what was staged since a mark."""
    for ref, path in _used[since:]:
        if spark := ref():
            drop(spark, path)
    del _used[since:]


@atexit.register
def _clean() -> None:
    if _fallback:
        shutil.rmtree(_fallback, ignore_errors=True)
    for ref, path in _used:
        try:
            if spark := ref():
                drop(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans up
            return
