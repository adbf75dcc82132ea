"""Token ids in ORC: range-ordered files, integer run-length encoding, row indexes and Bloom filters on doc_id.

Documents are range-partitioned by id, so each file holds one range of ids in
order and its footer, stripe and row-group statistics prune by doc_id; the
Bloom filter prunes point lookups. Each row holds its ids as array<int> (ORC
encodes integers by run-length encoding v2), their number and the number of ids
before it in its file. Beside the files stands a side table of one small row a
file, with the ids before the file; it turns a place in a file into the place
among all documents, so that reads of a range open no other file. The number of
files follows the size of the input. Spark reads the files by stripes, in
parallel.

Null text is the empty text: its only id is the end id. Equal doc_ids are
ordered by a hash of the text, then by text, so that very many of one id are
dealt over several files; a null doc_id comes first. Empty tables give no rows.
Other columns are ignored. Very long texts are encoded whole.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

END_ID = 2
#: Entries of each of the two generations of a worker's word cache and piece cache; longer words are never kept.
CACHED, LONGEST_KEPT = 450_000, 64
#: Marks that end a word without joining what stands before (an apostrophe may).
STOPS = ".,;:!?"
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}


@lru_cache(1)
def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE gives each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """A cache in two generations: when the young one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Words:
    """Ids of white-space free words, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never matches across it, so a text's
    ids are its words' ids in order. A miss goes to the library: its normaliser
    and split rule, then its BPE model for each piece that is not in the piece
    cache; a word with a special token in it goes through the whole encoder.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model, self.normal = self.whole.model.tokenize, self.whole.normalizer.normalize_str
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        self.split = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        self.pieces = Recent(self.piece, cached).__getitem__
        self.get = Recent(self.word, cached).__getitem__

    def piece(self, p: str) -> bytes:
        spelt = p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()])
        return array("I", [t.id for t in self.model(spelt)]).tobytes()

    def word(self, w: bytes) -> bytes:
        if w.isalpha():
            return self.pieces(w.decode().lower())
        if b"<" in w and any(s in w for s in self.special):
            return array("I", self.whole.encode(w.decode(), add_special_tokens=False).ids).tobytes()
        text = w.decode()
        body, mark = (text[:-1], text[-1]) if text[-1] in STOPS else (text, "")
        # Latin letters below U+0250 are normal as they stand; U+0130 alone has a lower case of two characters
        if body.isalpha() and max(body) < "\u0250" and "\u0130" not in body:
            return self.pieces(body.lower()) + (self.pieces(mark) if mark else b"")
        return b"".join(map(self.pieces, self.split(text.lower() if w.isascii() else self.normal(text))))


#: Bytes of input for each file.
FILE_BYTES = 64 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, cached: int = CACHED) -> None:
    """Encode every text and write (doc_id, ids, n_before, n_tokens) files in ascending doc_id order, and their side table."""

    def run(batches):
        kept = store.worker_cache("op3")
        words = kept.get(tokenizer_path) or kept.setdefault(tokenizer_path, Words(tokenizer_path, cached))
        get, end, before = words.get, np.array([end_id], "<u4").tobytes(), 0
        for b in batches:
            rows = [b"".join(map(get, t.split())) + end if t else end for t in b.column(1).to_pylist()]
            n = np.array([len(r) // 4 for r in rows], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(before + offsets[:-1]), pa.array(n)], ["doc_id", "ids", "n_before", "n_tokens"])
            before += int(offsets[-1])

    spark = docs.sparkSession
    store.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranges = rows.repartitionByRange(store.parts_by_size(docs, FILE_BYTES), *order[:2]).sortWithinPartitions(*order)
    ranges.select("doc_id", "text").mapInArrow(store.trimmed(run), ROWS).write.options(**ORC).orc(path)
    # one row a file, each file a task's whole output: small at any size
    data = spark.read.schema(ROWS).orc(path)
    files = data.select(part().alias("part"), (F.col("n_before") + F.col("n_tokens")).alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    files.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("file_start")).write.parquet(side_table(path))


ROWS = "doc_id long, ids array<int>, n_before long, n_tokens long"


def part() -> Column:
    """The number of the file that a row is read from, by which files stand in order."""
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")


def side_table(path: str) -> str:
    return f"{path.rstrip('/')}-files"


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, ids, start (ids of all documents before it). low, high: only doc_ids within, pruned by ORC's indexes."""
    places = spark.read.schema("part int, n long, file_start long").parquet(side_table(path)).select("part", "file_start")
    rows = spark.read.schema(ROWS).orc(path).select("doc_id", "ids", "n_before", part().alias("part"))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.join(F.broadcast(places), "part").select("doc_id", "ids", (F.col("file_start") + F.col("n_before")).alias("start"))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""

    def check(batches):
        for b in batches:
            ids = b.column(2)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, cached: int = CACHED) -> DataFrame:
    """Write docs' ids, read the files back, and return each document's digest. cached: entries of a worker's caches, which bound its memory."""
    spark = docs.sparkSession
    path = path or store.fresh_path(spark, "tokens") + "/ids"
    write_tokens(docs, path, tokenizer_path, cached=cached)
    return digest(read_tokens(spark, path))
