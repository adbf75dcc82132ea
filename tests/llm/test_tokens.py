import random
import zlib

import numpy as np
import public_tokenizers

from trellis.llm import op3_token_output as op3
from trellis.llm import op8_token_counts as op8

NASTY = [
    None, "", " ", "  ", "\n", "\n\n a", "a\nb", "a \nb", "a  b", " a ", "\ta　b c", "▁x▁▁y ▁", "<s> hi </s><unk>", "İstanbul ΣΑΣ ς", "é öx",
    "<|endoftext|>", "a<|startoftext|>b c", "don't we'll 12345 x2y ***!!,,", "漢字かな 😀😀 ‍", "\x00\x1c\x85", "word " * 3000, "x" * 5000, "'s's 'S", "Ünïcödé", "\r\n a\r\nb",
]


def rows(spark, texts=NASTY):
    return spark.createDataFrame([(i, t, i, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, start string")


def fuzz(n=300):
    rng = random.Random(5)
    letters = "ab cé\n  ▁'s1,.<|>ßΣ\t\x1c\xa0\x85İÉªſʰ̇"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = NASTY + fuzz()
    got = {r.doc_id: r for r in op8.count_tokens(rows(spark, texts), path, limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), repr(t)


def test_counts_of_nothing_and_repeats(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert op8.count_tokens(rows(spark, []), path).count() == 0
    twice = rows(spark, ["a b"]).union(rows(spark, ["a b"]))
    assert [r.n_tokens for r in op8.count_tokens(twice, path).collect()] == [2, 2]


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(op8, "CACHED", 3)
    lengths = op8.Lengths(public_tokenizers.path("piece_bpe_32k.model"), {"the": 1})
    words = [f"word{i}" for i in range(20)]
    assert [lengths[w] for w in words * 2] == [op8.length(lengths.model, w) for w in words * 2]


def test_ids_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = NASTY + fuzz()
    got = op3.encode_documents(rows(spark, texts), path).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)


def test_ids_ties_nulls_and_pruned_reads(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(7, "b"), (7, "a"), (None, "c"), (9, None)], "doc_id long, text string")
    op3.write_tokens(docs, str(tmp_path / "t"), path)
    back = op3.read_tokens(spark, str(tmp_path / "t"))
    assert [(r.doc_id, r.start, len(r.ids)) for r in back.orderBy("start").collect()] == [(None, 0, 2), (7, 2, 2), (7, 4, 2), (9, 6, 1)]
    assert [(r.doc_id, r.start) for r in op3.read_tokens(spark, str(tmp_path / "t"), low=8).collect()] == [(9, 6)]
    assert op3.encode_documents(rows(spark, []), path).count() == 0


def test_hot_ids_are_dealt_over_files_and_ranges_read_only_theirs(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, f"hot text {i}") for i in range(400)] + [(None, f"none {i}") for i in range(200)] + [(100 + i, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    op3.write_tokens(docs, str(tmp_path / "t"), path)
    back = op3.read_tokens(spark, str(tmp_path / "t"))
    found = sorted((r.start, r.doc_id, len(r.ids)) for r in back.collect())
    at = 0
    for start, _, n in found:
        assert start == at
        at += n
    ids = [-1 if i is None else i for _, i, _ in found]
    assert ids == sorted(ids) and len(ids) == 1000
    parts = spark.read.orc(str(tmp_path / "t")).where("doc_id = 5").select(op3.part().alias("p")).distinct().count()
    assert parts > 1
    some = op3.read_tokens(spark, str(tmp_path / "t"), low=100, high=120)
    assert sorted((r.start, r.doc_id, len(r.ids)) for r in some.collect()) == [x for x in found if x[1] is not None and 100 <= x[1] <= 120]
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "Aggregate" not in plan
