import base64
import hashlib
import random

import numpy as np
import pytest

from trellis.llm import op6_warc as op6

EVIL = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(n=120):
    rng = random.Random(2)
    rows = [(1, "u", None), (2, "u", ""), (3, "u\r\nX: y", EVIL), (4, "u", EVIL * 3 + "tail"), (5, "u", "same"), (6, "u", "same"), (7, None, "ünï 漢字 \x00\r\n\r\n"), (None, "u", "same"), (8, "u", "\r\n\r\n"), (9, "u", "WARC/1.1\r\n")]
    rows += [(100 + i, "http://x", rng.choice(["dup a", "dup b", EVIL + str(i), "z" * rng.randrange(900)])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("split", ["64m", "700"])
def test_archives_round_trip(spark, split):
    rows = pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        docs = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
        got = {r.page_id: r for r in op6.archive(docs).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        h = h or ""
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == i else ("revisit", first[h]))
        assert r.intact


def test_files_are_plain_warc(spark, tmp_path):
    rows = pages(20)
    op6.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    data, seen = next((tmp_path / "w").glob("part-*")).read_bytes(), 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
        assert rest[length : length + 4] == b"\r\n\r\n"
        data, seen = rest[length + 4 :], seen + 1
    assert seen == len(rows)


def test_pointer_jumping_equals_walking():
    rng = np.random.default_rng(1)
    for _ in range(50):
        offset = np.unique(rng.integers(0, 500, 60)) + 0
        offset[0] = 0
        successor = np.where(rng.random(len(offset)) < 0.8, rng.choice(offset, len(offset)), 999)
        successor = np.where(successor > offset, successor, -1)
        at, want = 0, set()
        while at in set(offset.tolist()):
            want.add(at)
            at = int(successor[list(offset).index(at)])
        assert set(offset[op6.reachable(offset, successor, 0)].tolist()) == want


def test_empty(spark):
    assert op6.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    from trellis.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    want = sorted(c.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()['op6_warc_chain']})").fetchall())
    assert sorted(tuple(r) for r in queries.op6_warc_chain(spark, sf).select(*cols).collect()) == want


def test_damage_is_seen(spark, tmp_path):
    """A payload changed without a change of length: its record, and what refers to it, are not intact."""
    rows = [(1, "u", "some page"), (2, "u", "some page"), (3, "u", "other"), (4, "u", EVIL + "more")]
    op6.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*"))
    file.write_bytes(file.read_bytes().replace(b"some page", b"sOme page").replace(b"\r\n\r\nmore", b"\r\n\r\nmOre"))
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    got = {r.page_id: r for r in op6.read(spark, str(tmp_path / "w")).collect()}
    want = base64.b32encode(hashlib.sha1(b"sOme page").digest()).decode()
    assert {i: r.intact for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False}
    assert got[1].payload_digest == got[2].payload_digest == want and got[4].payload_bytes == len(EVIL) + 4


def record(name, body, version="WARC/1.0", kind="response", more=""):
    return f"{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


@pytest.mark.parametrize("split", ["64m", "300"])
def test_archives_of_others(spark, tmp_path, split):
    """Another version, no lengths in the HTTP heads, other types, revisits of what is not there."""
    http = "Content-Type: application/http; msgtype=response\r\n"
    text = "".join([
        record("a", "software: x\r\n", kind="warcinfo", more="Content-Type: application/warc-fields\r\n"), record("b", "HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello", more=http),
        record("c", "HTTP/1.1 200 OK\r\n\r\n" + record("no", "zz") * 9, more=http), record("d", "HTTP/1.1 200 OK\r\n\r\n", kind="revisit", more=http + "WARC-Refers-To: <gone>\r\nWARC-Payload-Digest: sha1:ABC\r\n"), record("e", "plain", kind="metadata"),
    ])
    (tmp_path / "x.warc").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.record_id: r for r in op6.read(spark, str(tmp_path / "x.warc"), "WARC/1.0\r\n").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    inner = record("no", "zz") * 9
    assert {k: (r.payload_bytes, r.payload_digest, r.intact) for k, r in got.items()} == {
        "<a>": (13, sha("software: x\r\n"), None), "<b>": (5, sha("hello"), None), "<c>": (len(inner), sha(inner), None), "<d>": (None, "ABC", None), "<e>": (5, sha("plain"), None),
    }


def test_a_third_of_all_pages_are_one(spark):
    rows = [(i, "u", "hot page" if i % 3 else f"page {i} {EVIL if i % 2 else ''}") for i in range(600)]
    got = op6.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert sum(r.record_type == "revisit" and r.refers_to == 1 for r in got) == 399 and all(r.intact for r in got) and len(got) == 600
