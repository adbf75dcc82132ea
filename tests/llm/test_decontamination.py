import random

import numpy as np

from trellis.llm import op10_decontamination as op10


def brute_align(item, words):
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            s = op10.MATCH if item[i - 1] == words[j - 1] else -op10.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - op10.GAP, h[i][j - 1] - op10.GAP)
            best = max(best, h[i][j])
    return best / (op10.MATCH * len(item))


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        assert op10.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute_align(a, b)


def build(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)] + ["the"] * 60 + ["of"] * 60
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.randrange(15, 60))) for i in range(12)]
    docs, truth = [], set()
    for d in range(250):
        body = text(rng.randrange(20, 400))
        if d % 5 == 0:
            i, item = rng.choice(items)
            copy = list(item)
            for _ in range(len(copy) // 10 if d % 2 else 0):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["edit"], [copy[at], "edit"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() if d % 3 == 0 else w for w in copy]
            truth.add((d, i))
        docs.append((d, " ".join(body)))
    # a third of all documents hold item 0
    for d in range(1000, 1150):
        docs.append((d, " ".join(text(20) + items[0][1] + text(20))))
        truth.add((d, 0))
    return items, docs, truth


def test_finds_planted_passages_and_no_others(spark):
    items, docs, truth = build()
    docs += [(5000, None), (5001, ""), (5002, "the of the"), (5002, "the of the")]
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, item_id int, score double")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "the of")], "item_id long, text string")
    got = op10.decontaminate(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    # brute force over every pair: the score of each row, and no other pair reaches the threshold
    want = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for k, item in items:
            if len(set(w) & set(item)) >= 0.5 * len(set(item)) and (s := brute_align(item, w)) >= op10.LEAST_SCORE:
                want[i, k] = s
    assert {(r.doc_id, r.item_id): r.score for r in got} == want


def found(spark, docs, items):
    got = op10.decontaminate(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.score for r in got.collect()}


def every_pair(docs, items):
    scores = {(i, k): brute_align(item, t) for i, t in docs for k, item in items}
    return {p: s for p, s in scores.items() if s >= op10.LEAST_SCORE}


def test_finds_an_edited_passage_that_a_third_of_all_documents_hold(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    item = text(30)
    edited = list(item)
    for at in (7, 15, 23):
        edited[at] = "edit"
    docs = [(i, text(20) + edited + text(20)) for i in range(50)] + [(i, text(60)) for i in range(50, 150)] + [(150, text(9) + item)]
    want = every_pair(docs, [(1, item)])
    assert set(want) == {(i, 1) for i in [*range(50), 150]} and want[0, 1] == 0.85
    assert found(spark, docs, [(1, item)]) == want


def test_no_pair_above_the_threshold_is_lost(spark):
    rng = random.Random(9)
    items = [(n, [rng.choice("abcdefghijklmnop") for _ in range(n)]) for n in range(5, 31)]
    docs = []
    for d in range(300):
        copy = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 2 * len(copy) // 3)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["x"], [copy[at], "y"], [copy[at], "z"]])
            copy = copy or ["x"]
        docs.append((d, ["q"] * rng.randrange(9) + copy + ["r"] * rng.randrange(9)))
    # an insertion after every second word leaves no three words together
    docs.append((300, [w for i, v in enumerate(items[-1][1]) for w in ([v, "y"] if i % 2 else [v])]))
    want = every_pair(docs, items)
    assert (300, 30) in want and len(want) > 100
    assert found(spark, docs, items) == want


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs, truth = build(5)
    monkeypatch.setattr(op10, "BLOCK_CHARS", 900)
    got = op10.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == truth


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op10.decontaminate(docs, none).count() == 0
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op10.decontaminate(docs.limit(0), bench).count() == 0
    assert [tuple(r) for r in op10.decontaminate(docs, bench).collect()] == [(1, 1, 1.0, 6)]
