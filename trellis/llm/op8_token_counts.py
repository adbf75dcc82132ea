"""Token counts without a pre-token shuffle: a broadcast table of frequent pre-tokens before worker caches.

A sentencepiece BPE piece never holds a space mark after another character, nor
a line feed, so merges never cross the places before a run of spaces or before
a line feed: the text's token count is the sum of its pre-tokens' counts.
Pass 1 counts pre-tokens in every task and keeps the task's heaviest (a bounded
summary); their merged top goes into the broadcast table. Pass 2 looks every
pre-token up there, then in the worker's bounded cache, and asks the library
for what neither holds. The table only saves work: counts are the library's.

Null text is the empty text and has 0 tokens. Repeated rows and ids give one
row each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MARK = "▁"
SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Heaviest pre-tokens that a task reports, and that the broadcast table holds (at most about 2 MB).
TASK_TOP, TABLE_TOP = 2048, 20_000
#: Pre-tokens that a task counts before it drops the light ones; entries of a worker's cache.
COUNTED, CACHED = 150_000, 600_000
#: Longer pre-tokens are never kept.
LONGEST_KEPT = 64


def keys(text: str) -> list[str]:
    """Pre-tokens: one that starts with a line feed stands as it is, any other lost its first space."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text:
        return [s[1:] if s[0] == " " else s for s in SEGMENT.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


@lru_cache(4)
def _library(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"{path}: piece {piece!r} crosses pre-tokens")
    return model


def length(model, key: str) -> int:
    if not key:
        return 1
    n = len(model.encode(key))
    return n - 1 if key[0] == "\n" else n


class Lengths(dict):
    """Pre-token lengths: the broadcast tier, then this worker's own."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.model, self.table = _library(path), table

    def __missing__(self, key: str) -> int:
        n = length(self.model, key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= CACHED:
                self.clear()
                self.update(self.table)
            self[key] = n
        return n


def frequent(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """The corpus' heaviest pre-tokens, from bounded summaries of all tasks."""

    def heavy(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(keys(t))
                    if len(seen) > COUNTED:
                        seen = Counter({k: n - 1 for k, n in seen.items() if n > 1} if len(seen) < 2 * COUNTED else dict(seen.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in seen.most_common(TASK_TOP) if len(k) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(heavy, "key string, n long")
    return {r.key: r.n for r in rows.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(TABLE_TOP).collect()}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    model = _library(model_path)
    table = spark.sparkContext.broadcast({k: length(model, k) for k in frequent(docs, text_col)})
    stamp = uuid.uuid4().hex

    def count(batches):
        kept = store.worker_cache("op8")
        if stamp not in kept:
            kept.clear()
            kept[stamp] = Lengths(model_path, table.value)
        get = kept[stamp].__getitem__
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [sum(map(get, keys(t))) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
