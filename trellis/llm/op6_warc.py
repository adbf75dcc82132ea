"""WARC archives: written by Spark's own writer, read back by boundary-chain verification.

Writing: one record a page. Pages of equal payload are found by SHA-1; the one
with the smallest page_id is a response, the others are revisits, which carry
the HTTP head (with the payload's length) and no body. A record is one value
of the text writer and its separator is the blank line pair that ends a WARC
record, so files are plain WARC, committed by Spark's protocol on any storage.

Reading: the text reader splits files, in parallel, at every version line;
each piece is a candidate record, also where a payload merely holds that line.
Its byte offset is a running sum of the pieces before it: in its split of the
file, and of the splits before. Its header's Content-Length gives the offset of
its successor. Pointer jumping is done on two levels, each of bounded tasks:
within a split, every candidate learns where the chain from it leaves the
split; then (file, offset, exit) rows are jumped by joins, in rounds that grow
with the logarithm of a file's splits, from each file's first byte. So every
split knows where the true chain enters it, and keeps what is reached from
there. Only offsets, header fields and digests move, no payload: a payload is
measured and hashed where it is read. Payloads that hold version lines are put
together from their pieces, one record at a time.

Digest and length are those of the bytes that were read, for a revisit those of
the response that it refers to; `intact` tells whether the record's own header
says the same. A response that the archives lack leaves a revisit's header
figures, and intact null.

Null html is the empty payload. Rows that share a payload's smallest page_id
are all responses. A null page_id is the largest; where all are null, all are
responses. Empty tables give no rows; other columns are ignored; a very long
payload is one value of the reader, whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Fixed values of the formats.
VERSION = "WARC/1.1\r\n"
TAIL = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_RECORDS = 20_000
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr(F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> None:
    """Write pages as WARC records. Payloads of at least `least` bytes are written once and revisited after."""
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")) if url_col else F.lit("about:blank")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(url, r"[\r\n]", "").alias("url"), html.alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # digests of the payloads that occur more than once, each with its response: no payload is shuffled
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    groups = store.stage(groups, "digests")
    copies = groups.count()
    rows = rows.join(F.broadcast(groups) if copies <= BROADCAST_ROWS else groups, "digest", "left")
    record = F.when(F.col("first_id").isNull() | (F.col("page_id") == F.col("first_id")), F.lit("response")).otherwise(F.lit("revisit"))
    rows = rows.withColumn("type", record)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(TAIL))
    body = F.when(F.col("type") == "response", F.concat(head, F.col("html"))).otherwise(head)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    fields = F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.col("type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("type") == "revisit", F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("null")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(TAIL), body,
    )
    rows.select(fields.alias("value")).write.option("lineSep", TAIL).option("maxRecordsPerFile", FILE_RECORDS).text(path)


BROADCAST_ROWS = 500_000


def pieces(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """The text of the files between version lines, with its place: file, split, order in the split."""
    return spark.read.option("lineSep", version).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")


def field(name: str, head: Column) -> Column:
    """A header field, null if it is missing or empty."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), head, F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1), F.lit(""))


def parsed(df: DataFrame) -> DataFrame:
    """What a candidate's text (value) says: header fields, and length and digest of its payload if the text holds all of it."""
    head = F.substring_index("value", TAIL, 1)
    kind, length = field("WARC-Type", head), field("Content-Length", head).try_cast("long")
    df = df.select(
        *[c for c in df.columns if c != "value"], F.col("value").cast("binary").alias("bin"), F.octet_length("value").cast("long").alias("bytes"), (F.octet_length(head) + len(TAIL)).cast("long").alias("head"), F.when(F.col("value").contains(TAIL), length).alias("length"),
        kind.alias("type"), field("WARC-Record-ID", head).alias("record_id"), F.regexp_extract(field("WARC-Payload-Digest", head), "sha1:(.*)", 1).alias("said"), field("WARC-Refers-To", head).alias("refers"), field("Content-Type", head).alias("content_type"),
    )
    block = F.when(F.col("bytes") >= F.col("head") + F.col("length"), F.substring("bin", (F.col("head") + 1).cast("int"), F.col("length").cast("int")))
    df = df.withColumn("content", block).drop("bin")
    http = F.coalesce(F.col("content_type").startswith("application/http"), F.lit(False))
    inner = F.substring_index(F.col("content").cast("string"), TAIL, 1)
    payload = F.when(http, F.substring("content", F.octet_length(inner) + len(TAIL) + 1, 2**31 - 1)).otherwise(F.col("content"))
    said_bytes = F.when(http, field("Content-Length", inner).try_cast("long"))
    df = df.withColumns({"payload": payload, "said_bytes": said_bytes})
    whole = F.col("content").isNotNull()
    digest = F.when(whole & (F.col("type") != "revisit"), base32_sha1(F.col("payload")))
    return df.withColumns({"whole": whole, "payload_bytes": F.when(F.col("type") == "revisit", F.col("said_bytes")).otherwise(F.octet_length("payload").cast("long")), "digest": digest}).drop("content", "payload", "content_type")


def jumped(step: np.ndarray) -> np.ndarray:
    """Where the chain from each node ends: step[k] is the next node, k itself at an end."""
    while not np.array_equal(further := step[step], step):
        step = further
    return step


def _steps(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The next candidate of each among those of one split (offsets sorted), itself where there is none."""
    n = len(offset)
    at = np.minimum(np.searchsorted(offset, successor), n - 1)
    return np.where((offset[at] == successor) & (successor > offset), at, np.arange(n))


def reachable(offset: np.ndarray, successor: np.ndarray, start: int) -> np.ndarray:
    """Pointer jumping: which offsets (sorted) the chain from start visits."""
    n = len(offset)
    step = np.append(_steps(offset, successor), n)
    step[:n] = np.where(step[:n] == np.arange(n), n, step[:n])
    seen = np.zeros(n + 1, bool)
    seen[:n] = offset == start
    jump = step
    while True:  # after round k all records within 2^k steps of the start are seen
        more = seen.copy()
        more[jump[np.flatnonzero(seen)]] = True
        more[n] = False
        jump = jump[jump]
        if np.array_equal(more, seen):
            return seen[:n]
        seen = more


FIELDS = "i long, length long, type string, record_id string, said string, refers string, said_bytes long, whole boolean, payload_bytes long, digest string"
CHAINED = f"file string, block long, offset long, successor long, leaves long, {FIELDS}"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _leave(version_bytes: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        """The candidates of one split: their offsets, their successors, and where the chain from each leaves the split."""
        p = p.sort_values("i", ignore_index=True)
        size = p["bytes"].to_numpy(np.int64) + version_bytes
        starts = int(p["base"].iloc[0]) + np.cumsum(size) - size
        offset = starts - version_bytes
        successor = np.where(p["length"].notna(), starts + p["head"] + p["length"].fillna(0) + len(TAIL), -1).astype(np.int64)
        end = jumped(_steps(offset, successor))
        return p[["file", "block"]].assign(offset=offset, successor=successor, leaves=successor[end], **{c: p[c] for c in _NAMES})

    return run


def _mark(p: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one split, whether they are true, and the last true record at or before each (-1: in an earlier split)."""
    p = p.sort_values("offset", ignore_index=True)
    offset = p["offset"].to_numpy(np.int64)
    entry = p["entry"].iloc[0]
    true = np.zeros(len(p), bool) if pd.isna(entry) else reachable(offset, p["successor"].to_numpy(np.int64), int(entry))
    last = np.maximum.accumulate(np.where(true, offset, -1))
    return p.drop(columns=["entry", "leaves"]).assign(real=true, owner=last)


def chain(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """Every candidate of the files, with its offset, whether it is a true record (`real`), and the true record that holds it (`owner`)."""
    slim = store.stage(parsed(pieces(spark, path, version)), "candidates")
    splits = slim.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(version)).alias("size"))
    # one row a split
    base = splits.select("file", "block", (F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")).alias("base"))
    base = store.stage(base, "splits")
    chained = store.stage(slim.join(base, ["file", "block"]).groupBy("file", "block").applyInPandas(_leave(len(version)), CHAINED), "chained")
    # the second level: from a file's first byte, over the places where a chain leaves a split
    most = base.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    entry = chained.where("offset = 0").select("file", "offset")
    if most > 1:
        doors = chained.select("file", F.col("leaves").alias("offset")).distinct().unionByName(entry).distinct()
        jump = store.stage(chained.join(doors, ["file", "offset"]).select("file", "offset", F.col("leaves").alias("to")), "doors")
        for _ in range(math.ceil(math.log2(most))):
            entry = store.stage(entry.unionByName(entry.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "entries")
            onward = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
            jump = store.stage(jump.join(onward, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "doors")
    entry = chained.join(entry, ["file", "offset"]).groupBy("file", "block").agg(F.min("offset").alias("entry"))
    marked = chained.join(entry, ["file", "block"], "left").groupBy("file", "block").applyInPandas(_mark, CHAINED.replace("leaves long, ", "") + ", real boolean, owner long")
    marked = store.stage(marked, "marked")
    before = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = before.select("file", "block", F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    return marked.join(before, ["file", "block"]).withColumn("owner", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("earlier"))).drop("earlier")


def read(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact, record_id, file, offset of every true record."""
    every = chain(spark, path, version)
    fields = ["type", "record_id", "said", "refers", "said_bytes", "payload_bytes", "digest", "file", "offset"]
    records = every.where("real")
    whole = records.where("whole").select(*fields)
    # records whose text lies in several pieces: pieces are read again and put together, one record at a time
    torn = store.stage(records.where("not whole and length is not null").select("file", F.col("offset").alias("owner")), "torn")
    if torn.isEmpty():
        found = whole
    else:
        parts = every.join(torn, ["file", "owner"]).select("file", "block", "i", "owner", "offset")
        text = pieces(spark, path, version).join(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, ["file", "block", "i"])
        joined = text.groupBy("file", F.col("owner").alias("offset")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(text["offset"].alias("at"), "value"))), lambda x: x["value"]), version).alias("value"))
        found = whole.unionByName(parsed(joined).select(*fields))
    found = store.stage(found, "records")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    # the responses that revisits refer to: each once, however many do
    asked = found.where("type = 'revisit'").select(F.col("refers").alias("record_id")).distinct()
    named = found.where("type <> 'revisit'").join(asked, "record_id").groupBy(F.col("record_id").alias("refers")).agg(F.first("digest").alias("its"), F.first("payload_bytes").alias("its_bytes"))
    named = store.stage(named, "responses")
    out = found.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "refers", "left")
    digest, size = F.coalesce("digest", "its", "said"), F.coalesce(F.when(F.col("type") == "revisit", F.col("its_bytes")), F.col("payload_bytes"))
    known = F.coalesce("digest", "its")
    intact = (known == F.col("said")) & F.coalesce(size == F.col("said_bytes"), F.lit(True))
    return out.select(
        page("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), page("refers").alias("refers_to"), intact.alias("intact"), "record_id", "file", "offset",
    )


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages, read the archives back."""
    path = path or store.fresh_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
