"""Incremental maintenance by a stream of changed files: each micro-batch rewrites only its files' rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.lookup import first_by


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each file in a batch (file_path, version, ...)."""
    from pyspark.sql import functions as F

    return first_by(batch, ["file_path"], [F.desc("version")])


def merge(table: DataFrame, changed: DataFrame) -> DataFrame:
    """table with the files of changed replaced by it."""
    return table.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(changed, allowMissingColumns=True)


def follow(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Apply each micro-batch's latest files once; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: apply(latest(df), n)).start()
