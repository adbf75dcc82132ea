import bisect
import collections
import hashlib
import math
import random
import zlib

import pytest

from trellis.llm import op4_sharding as op4
from trellis.llm import op7_mixing as op7


def fits(sizes, capacity, shards):
    used, room = 0, 0
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


def smallest(sizes, shards):
    lo, hi = 0, sum(sizes)
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (lo, m) if fits(sizes, m, shards) else (m, hi)
    return hi


def in_order(rows):
    """Groups by brute force, in their order: text, size."""
    groups = collections.OrderedDict()
    for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "null")):
        groups.setdefault(t, 0)
        groups[t] += len((t or "").encode()) + 16
    return list(groups.items())


def stretches_of(groups, shards):
    """Stretches between groups that stand alone, and the shards left for them."""
    rest, left, alone = sum(s for _, s in groups), shards, set()

    def between(alone):
        out = [[]]
        for t, s in groups:
            if t in alone:
                out.append([])
            else:
                out[-1].append(s)
        return [x for x in out if x]

    for t, s in sorted(groups, key=lambda g: (-g[1], hashlib.md5(g[0].encode()).hexdigest() if g[0] is not None else "null")):
        if left == 1 or s * left <= rest or len(between({*alone, t})) > left - 1:
            break
        alone.add(t)
        rest, left = rest - s, left - 1
    return alone, between(alone), left


def needed(sizes, capacity):
    used, room = 0, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used


@pytest.mark.parametrize("shards,read,seed", [(40, 4096, 1), (7, 8, 2), (3, 4, 3)])
def test_shards_are_minimax(spark, monkeypatch, shards, read, seed):
    monkeypatch.setattr(op4, "READ", read)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(300))) for _ in range(400)]
    rows = [(i, rng.choice(texts)) for i in range(1000)] + [(2000 + i, "hot copy " * 5) for i in range(500)] + [(3000, None), (3001, ""), (3001, ""), (None, "x")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, size int")
    out = op4.assign(docs, shards).collect()
    assert len(out) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    text_of = {(i, zlib.crc32((t or "").encode())): t for i, t in rows}
    where = collections.defaultdict(set)
    for r in out:
        where[text_of[r.doc_id, r.text_crc32]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    groups = in_order(rows)
    shard_of = [min(where[t]) for t, _ in groups]
    assert shard_of == sorted(shard_of)  # every shard is a range of the order
    load = {s: sum(r.size for r in x) for s, x in by.items()}
    assert max(load.values()) == smallest([s for _, s in groups], shards)  # no cut of the order has a smaller largest shard
    alone, between, left = stretches_of(groups, shards)
    fewest = bisect.bisect_left(range(sum(s for _, s in groups) + 1), True, key=lambda c: sum(needed(x, c) for x in between) <= left)
    if fewest <= max(load.values()):
        assert max(v for s, v in load.items() if text_of[by[s][0].doc_id, by[s][0].text_crc32] not in alone) <= fewest
        assert all(len({r.text_crc32 for r in x}) == 1 for x in by.values() if text_of[x[0].doc_id, x[0].text_crc32] in alone)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_random_orders(spark, monkeypatch, seed):
    """Few and many shards, several large groups, in all places of the order."""
    monkeypatch.setattr(op4, "READ", 8)
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13] * 3 + [40, 90, 200]) for _ in range(rng.randrange(1, 60))]
    upto, groups = 0, []
    for s in sizes:
        upto += s
        groups.append((upto, s))
    df = spark.createDataFrame(groups, "upto long, bytes long").coalesce(1).cache()
    for shards in (1, 2, 7, 40):
        ends = op4.plan_cuts(df, upto, sorted(groups, key=lambda g: (-g[1], g[0]))[: shards + 1], shards)
        assert ends == sorted(set(ends)) and ends[-1] == upto and len(ends) <= shards and set(ends) <= {u for u, _ in groups}
        assert max(b - a for a, b in zip([0, *ends], ends)) == smallest(sizes, shards)


def test_sharding_small_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op4.assign(none).count() == 0
    one = op4.assign(spark.createDataFrame([(5, "a"), (5, "a")], "doc_id long, text string")).collect()
    assert sorted((r.shard, r.slot, r.law) for r in one) == [(one[0].shard, 0, "bytes"), (one[0].shard, 1, "bytes")]


def test_sharding_plan_is_native(spark, sf):
    plan = op4.assign(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_targets():
    got = op7.targets([("b", 100), ("a", 1000), (None, 50)])
    assert got["b"] == pytest.approx(200.0) and got[None] == pytest.approx(100.0) and got["a"] == pytest.approx(1725 - 300)
    assert op7.targets([]) == {} and op7.targets([("a", 0)]) == {"a": 0.0}


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["s1", "s2", "s3", None]), 1) for i in range(1500)]
    rows += [(2000 + i, "hot hot", "s2", 1) for i in range(700)] + [(9000, None, "s1", 1), (9001, " \n", None, 1), (9002, "a b", "s1", 1), (9002, "a b", "s1", 1), (None, "x y z", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = op7.mix(docs).collect()
    again = op7.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(out, key=key) == sorted(again, key=key) and len(out) == len(rows)
    size = collections.Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    goal = op7.targets(list(size.items()))
    source = {(r[0]): r[2] for r in rows}
    taken = collections.Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[source[r.doc_id]] and math.isclose(r.target, goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 60, (s, taken[s], g)


def test_rates_are_tilted(spark):
    """The dual's solution by brute force (bisection), source by source."""
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), "ab"[i % 3 == 0]) for i in range(300)]
    out = op7.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in out if r.source == s]
        mean = sum(r.size for r in mine) / len(mine)
        lo, hi = -50.0, 50.0
        for _ in range(200):
            m = (lo + hi) / 2
            lo, hi = (lo, m) if sum(r.size * 2 / (1 + math.exp(-r.size / mean * m)) for r in mine) > mine[0].target else (m, hi)
        assert all(abs(r.rate - 2 / (1 + math.exp(-r.size / mean * lo))) < 1e-5 for r in mine)


def test_apply_repeats_rows(spark):
    rows = [(i, "a b c d", "s", "x") for i in range(40)] + [(99, "q r", "s", "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = op7.apply(docs)
    assert out.columns == docs.columns
    assert abs(sum(len(r.text.split()) for r in out.collect()) - 1.5 * 168) <= 4
    assert op7.apply(docs.limit(0)).count() == 0


def test_apply_takes_columns_of_any_name_and_type(spark):
    rows = [(i, f"a b c {i}", "s" if i % 2 else None, {"k": i}, 5, 6, 7, 8, [{"x": "y"}]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, __n int, __key int, row int, s int, deep array<map<string,string>>")
    out = op7.apply(docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    want = {r[0]: r for r in rows}
    assert all(tuple(r) == want[r.doc_id] for r in got) and abs(len(got) - 45) <= 2


def test_alike_rows_share_what_they_take(spark):
    """A third of all rows are one row: only some of them get one more copy."""
    rows = [(1, "hot hot hot", "s")] * 200 + [(i, "a b c", "s") for i in range(2, 402)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    goal = op7.targets([("s", 1800)])["s"]
    for taken in (sum(r.taken for r in op7.mix(docs).collect()), sum(len(r.text.split()) for r in op7.apply(docs).collect())):
        assert abs(taken - goal) <= 3
    only = spark.createDataFrame(rows[:200], "doc_id long, text string, source string").repartition(3)
    assert op7.apply(only).count() == 300 and sorted(r.copies for r in op7.mix(only).collect()) == [1] * 100 + [2] * 100
