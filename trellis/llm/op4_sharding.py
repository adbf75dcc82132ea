"""Minimax contiguous partition of ordered atomic groups into shards, by DataFrame operations only.

Groups are rows of equal text, ordered by their smallest doc_id (null first),
then by digest; a group never crosses shards, and every shard is a contiguous
range of that order. The smallest feasible capacity is found by binary search,
each probe a greedy walk over the groups' prefix sums, and the sequence is cut
so that no shard exceeds it: the largest shard is as small as it can be.

Where single groups above the mean set that capacity, the others would be filled
up to it and shards left empty. So a group above the mean of the shards left
stands alone, largest first, as long as every stretch between such groups keeps
a shard; the search is then done again for the stretches together (all of them
in the shards left), and for each stretch with its number of shards, and the
stretch is cut greedily at the capacity found. If standing alone made any shard
larger than the first capacity, the cuts of the first search hold.

Prefix sums of all groups stay distributed. The driver knows a few thousand of
them at a time: on these a walk gives a sure yes (cuts only at known places)
and a sure no (cuts anywhere inside unknown blocks), and each round one
aggregate reads the places between the two answers more finely, until the
answers meet at exact neighbours. Rounds grow with the logarithm of the groups.

Null text is a group of its own with size `overhead`. Equal rows share a group
and get slots of their own. Groups of equal size are told apart by digest. Fewer
groups than shards leave shards empty. Very long texts count whole. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

SHARDS, OVERHEAD = 40, 16
#: Prefix sums that one round reads; groups of more rows than this part of all (so at most as many groups) are joined by broadcast.
READ, HOT_PART = 4096, 1000


Stretch = tuple[int, int]


class Places:
    """Known prefix sums of group sizes, each with the one before it where that is known."""

    def __init__(self, total: int):
        self.total = total
        self.before: dict[int, int | None] = {0: None, total: None}
        self.at = [0, total]

    def add(self, found: list[tuple[int, int]]) -> None:
        for upto, size in found:
            self.before[upto] = upto - size
            self.before.setdefault(upto - size, None)
        self.at = sorted(self.before)

    def sure(self, c: int, capacity: int, end: int) -> int:
        """The last known place within capacity of c."""
        return self.at[bisect_right(self.at, min(c + capacity, end)) - 1]

    def best(self, c: int, capacity: int, end: int) -> int:
        """No true place within capacity of c lies behind this."""
        t = c + capacity
        if t >= end:
            return end
        i = bisect_right(self.at, t)
        p, q = self.at[i - 1], self.at[i]
        return p if self.before[q] == p else t

    def walk(self, stretch: Stretch, capacity: int, most: int, step) -> list[int]:
        """Greedy cuts of a stretch, its end included, as far as `most` steps come."""
        (c, end), out = stretch, []
        while c < end and len(out) < most:
            if (n := step(c, capacity, end)) <= c:
                break
            out.append(c := n)
        return out

    def fits(self, stretches: list[Stretch], capacity: int, shards: int, step) -> bool:
        left = shards
        for s in stretches:
            cuts = self.walk(s, capacity, left, step)
            if not cuts or cuts[-1] < s[1]:
                return False
            left -= len(cuts)
        return True

    def bracket(self, stretches: list[Stretch], low: int, high: int, shards: int) -> tuple[int, int]:
        """The largest capacity known to fail and the smallest known to fit, between low (fails) and high (fits)."""
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if self.fits(stretches, m, shards, self.sure) else (m, b)
        high, a = b, low
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if self.fits(stretches, m, shards, self.best) else (m, b)
        return a, high

    def unknown(self, windows: list[Stretch]) -> list[Stretch]:
        """Of each window the span (p, q] of the blocks in it that may hold several groups; touching spans merged."""
        out: list[Stretch] = []
        for lo, hi in sorted(windows):
            i, span = max(0, bisect_left(self.at, lo) - 1), None
            while i + 1 < len(self.at) and self.at[i] <= hi:
                p, q = self.at[i], self.at[i + 1]
                if self.before[q] != p:
                    span = (span[0] if span else p, q)
                i += 1
            if span and out and span[0] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], span[1]))
            elif span:
                out.append(span)
        return out


def finer(blocks: list[tuple[int, int]], width: int) -> int:
    """The next width to read with: READ ranges in blocks, and at most half the last width, so that reading always gets on."""
    return max(1, min(width // 2, sum(q - p for p, q in blocks) // READ))


def read_places(groups: DataFrame, blocks: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The last prefix sum, with its group's size, of each range of width bytes in blocks."""

    def inside(a: int, b: int):  # a balanced tree, each node bounded by the span of its blocks
        bounds = (F.col("upto") > blocks[a][0]) & (F.col("upto") <= blocks[b - 1][1])
        return bounds if b - a == 1 else bounds & (inside(a, (a + b) // 2) | inside((a + b) // 2, b))

    found = groups.where(inside(0, len(blocks)) & (F.col("bytes") > 0)).groupBy(F.floor((F.col("upto") - 1) / F.lit(width)).alias("range")).agg(F.max(F.struct("upto", "bytes")).alias("m"))
    return [(r.m.upto, r.m.bytes) for r in found.collect()]


def smallest_capacity(groups: DataFrame, places: Places, stretches: list[Stretch], shards: int, largest: int) -> int:
    """The smallest capacity by which the groups (upto, bytes) of the stretches fit into shards; reads the places that it needs.

    largest: no group of the stretches is larger.
    """
    size = sum(b - a for a, b in stretches)
    low, high = -(-size // shards) - 1, max(b - a for a, b in stretches)
    width = max(1, size // READ)
    while True:
        low, high = places.bracket(stretches, low, high, shards)
        if high - low <= 1:
            return high
        windows = []
        for a, b in stretches:
            early = late = a
            for _ in range(shards):
                early = max(places.sure(early, low + 1, b), min(b, early + max(0, low + 1 - largest)))
                late = places.best(late, high, b)
                windows.append((early, late))
                if early >= b:
                    break
        blocks = places.unknown(windows)
        width = finer(blocks, width)
        places.add(read_places(groups, blocks, width))


def plan_cuts(groups: DataFrame, total: int, large: list[tuple[int, int]], shards: int) -> list[int]:
    """The end of each shard in use, in order. large: (upto, bytes) of the largest groups, at least as many as shards or all, the largest first."""
    places = Places(total)
    places.add(large)
    places.add(read_places(groups, [(0, total)], max(1, total // READ)))
    whole = [(0, total)]
    capacity = smallest_capacity(groups, places, whole, shards, large[0][1])
    plain = places.walk(whole[0], capacity, shards, places.sure)

    alone: list[Stretch] = []
    stretches, rest = whole, total
    for upto, size in large:
        left = shards - len(alone)
        if left == 1 or size * left <= rest:
            break
        tried = sorted([*alone, (upto - size, upto)])
        between = [(a, b) for a, b in zip([0, *(e for _, e in tried)], [*(s for s, _ in tried), total]) if b > a]
        if len(between) > left - 1:
            break
        alone, stretches, rest = tried, between, rest - size
    if not alone:
        return plain
    left, others = shards - len(alone), [size for upto, size in large if (upto - size, upto) not in alone]
    if not stretches:
        return [e for _, e in alone]
    largest = others[0] if others else 1
    shared = smallest_capacity(groups, places, stretches, left, largest)
    if shared > capacity:
        return plain
    # each stretch has the shards that it needs; more go where a shard holds most
    needs = [len(places.walk(s, shared, left, places.sure)) for s in stretches]
    for _ in range(left - sum(needs)):
        i = max(range(len(stretches)), key=lambda k: (stretches[k][1] - stretches[k][0]) / needs[k])
        needs[i] += 1
    ends = [e for _, e in alone]
    for s, n in zip(stretches, needs):
        ends += places.walk(s, smallest_capacity(groups, places, [s], n, largest), n, places.sure)
    return sorted(ends)


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    n_parts = store.shuffle_partitions(spark)
    text = F.col(text_col).cast("string")
    rows = store.stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("gkey"),
    ), "rows")
    ordered = [F.col("first_id").asc_nulls_first(), F.col("gkey")]
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    groups = store.stage(groups.repartitionByRange(n_parts, *ordered).withColumn("part", F.spark_partition_id()), "groups")
    sums = groups.agg(F.sum("bytes").alias("total"), F.sum("n").alias("n")).first()
    if not sums.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

    # two-level prefix sums: within each range part, then over the parts (one row a part)
    parts = groups.groupBy("part").agg(F.sum("bytes").alias("in_part")).select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    upto = groups.withColumn("upto", F.sum("bytes").over(Window.partitionBy("part").orderBy(*ordered))).join(F.broadcast(parts), "part").withColumn("upto", F.col("upto") + F.col("before"))
    upto = store.stage(upto.select("gkey", "n", "bytes", "upto"), "prefix-sums")
    large = [(r.upto, r.bytes) for r in upto.where("bytes > 0").orderBy(F.desc("bytes"), "gkey").limit(shards + 1).collect()]
    shard = F.lit(0)
    for c in plan_cuts(upto, sums.total, large, shards)[:-1] if large else []:
        shard = shard + (F.col("upto") > c).cast("int")
    shard_of = upto.select("gkey", "n", shard.cast("int").alias("shard"))

    hot = shard_of.where(F.col("n") > F.lit(sums.n // HOT_PART)).select("gkey", "shard")
    cold = shard_of.where(F.col("n") <= F.lit(sums.n // HOT_PART)).select("gkey", F.col("shard").alias("cold_shard"))
    tried = rows.join(F.broadcast(hot), "gkey", "left")
    done = tried.where("shard is not null").unionByName(tried.where("shard is null").drop("shard").join(cold, "gkey").withColumnRenamed("cold_shard", "shard"))

    # slots: number rows within range parts of (shard, doc_id), then add what earlier parts hold of the shard
    spread = done.drop("gkey").repartitionByRange(n_parts, "shard", F.col("doc_id").asc_nulls_first(), "text_crc32").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text_crc32")
    placed = store.stage(spread.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()), "placed")
    runs = placed.groupBy("part", "shard").agg(F.min("i").alias("first"), F.count("*").alias("rows"))
    runs = runs.select("part", "shard", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(runs), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("i") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
