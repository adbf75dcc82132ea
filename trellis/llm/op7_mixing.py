"""Mixing sources to target token counts by entropy balancing.

Targets: the sources in code-point order (null last) weigh 3, 1, 2, repeating,
and share 150 % of all tokens; what lies above twice a source's size is shared
again by weight among the others until nothing does.

Rates: among all rates r in (0, 2) whose tokens meet the targets, take those
nearest to one copy of each document in bounded relative entropy. The dual is
one number per source: r = 2 / (1 + exp(-z * tilt)), z the document's size by
the source's mean: exponentially tilted odds. Newton steps solve all sources
at once: each is one aggregate over the distributed (source, size) counts,
which are computed once, with the tilts joined on source.

Rounding: a rate is a sure number of copies and a part of one more. Every row
has a number by a hash of it and its part; the rows up to a threshold get the
one more. The threshold of a source is the one that brings its tokens nearest
to the target: a few rounds, each an aggregate over ranges of that number, half
as many bits at a time, find it exactly. So whether a row is repeated follows
from the row and one number of its source: nothing is shuffled but sums, a hot
source is spread over all tasks, and apply repeats whole rows in place. Rows
that are alike in all columns stand at one number; where that is the threshold,
as many of them get one more as the target asks. Reruns agree.

Null text has size 0 and takes 0 tokens. Repeated rows are documents of their
own. Sources of size 0 have target 0. Empty tables give no rows. Very long
texts count whole; one of a size above its source's target may be the whole
gap between target and what is taken. apply takes columns of any type and name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Bits of the number by which rows are chosen, and of them the bits that a round settles.
BITS, STEP = 48, 12
#: Parts into which rows alike in all columns are dealt where only some of them are repeated.
SALTS = 64
#: With more sources than this, per-source numbers are joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target tokens of each source, from (source, size)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    rest = share * sum(size.values())
    while free := [s for s in weight if s not in out]:
        total = sum(weight[s] for s in free)
        part = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if part[s] > most * size[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * size[s]
            rest -= out[s]
    return out


def rate(z: Column, tilt: Column, most: float = MOST) -> Column:
    return F.lit(most) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z * tilt))))


def balance(counts: DataFrame, sources: DataFrame, most: float = MOST, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Solve the dual. counts: (source, size, n); sources: (source, source_size, n_docs, target). Adds tilt.

    Each round is one distributed aggregate; a step that leaves the bracket
    known so far is replaced by its middle, so it always ends. Kept on the
    driver is one number a source, as in the tables of sources themselves.
    """
    spark = counts.sparkSession
    known = {r.source: r for r in sources.collect()}
    tilt, low, high, done = {}, {}, {}, {}
    for s, r in known.items():
        full = most * r.source_size
        if r.source_size == 0 or r.target <= 0:
            done[s] = -math.inf if r.source_size else 0.0
        elif r.target >= full * (1 - 1e-12):
            done[s] = math.inf
        else:
            tilt[s], low[s], high[s] = 0.0, -math.inf, math.inf
    mean = {s: r.source_size / max(1, r.n_docs) for s, r in known.items()}
    for _ in range(rounds):
        if not tilt:
            break
        now = spark.createDataFrame([(s, t, mean[s]) for s, t in tilt.items()], "s string, tilt double, mean double")
        z = F.col("size") / F.col("mean")
        r = rate(z, F.col("tilt"), most)
        sums = counts.join(F.broadcast(now) if len(tilt) <= BROADCAST_SOURCES else now, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.col("n") * F.col("size") * r).alias("tokens"), F.sum(F.col("n") * F.col("size") * z * r * (1 - r / most)).alias("slope"))
        for x in sums.collect():
            s, gap = x.s, x.tokens - known[x.s].target
            if abs(gap) <= tolerance * known[s].target + 1e-6:
                done[s] = tilt.pop(s)
                continue
            low[s], high[s] = (low[s], tilt[s]) if gap > 0 else (tilt[s], high[s])
            step = tilt[s] - gap / x.slope if x.slope > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else 2 * tilt[s] - math.copysign(1, gap)
            tilt[s] = step
    rows = [(s, float(x), mean[s]) for s, x in (done | tilt).items()]
    return spark.createDataFrame(rows, "s string, tilt double, mean double")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that Spark does not hash (maps, variants) by their JSON."""
    plain = lambda t: not any(x in t for x in ("map<", "variant"))
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return F.xxhash64(*[name(c) if plain(t) else F.to_json(F.struct(name(c).alias("x"))) for c, t in docs.dtypes])


def measure(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


class Plan:
    """What decides about rows: a small table of sources (s, source_size, target, tilt, mean, tau, take, tied), joined to rows by source."""

    def __init__(self, table: DataFrame, small: bool, most: float):
        self.table, self.small, self.most = table, small, most

    def join(self, rows: DataFrame, source: Column, table: DataFrame | None = None) -> DataFrame:
        table = self.table if table is None else table
        return rows.join(F.broadcast(table) if self.small else table, source.eqNullSafe(F.col("s")))

    def rate(self, size: Column) -> Column:
        tilted = rate(size / F.greatest(F.col("mean"), F.lit(1e-9)), F.col("tilt"), self.most)
        return F.when(size == 0, 1.0).when(F.col("tilt") == math.inf, self.most).when(F.col("tilt") == -math.inf, 0.0).otherwise(tilted)

    @staticmethod
    def number(size: Column, rate: Column, row_key: Column) -> Column:
        """Where a row stands among those that may get one more copy; null if it never does."""
        part = rate - F.floor(rate)
        u = (F.xxhash64(row_key).bitwiseAND((1 << BITS) - 1) + 0.5) / float(1 << BITS)
        ratio = u / part
        return F.when((size > 0) & (part > 0), F.floor(ratio / (1 + ratio) * float(1 << BITS)).cast("long"))


def thresholds(rows: DataFrame, plan: Plan) -> DataFrame:
    """Of each source: tau, the number up to which rows get one more copy; take, how many of the tied rows at tau do.

    rows: (source, size, row_key). Each round keeps the range in which the
    tokens wanted are reached, and what stands before it.
    """
    rows = plan.join(rows, F.col("source"))
    rated = rows.withColumn("rate", plan.rate(F.col("size"))).withColumn("number", plan.number(F.col("size"), F.col("rate"), F.col("row_key")))
    slim = store.stage(rated.select("source", "size", "target", F.floor("rate").cast("long").alias("base"), "number"), "numbers")
    sure = slim.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    at = sure.select(F.col("source").alias("s"), (F.col("target") - F.col("sure")).alias("wanted"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    at = store.stage(at, "thresholds")
    for left in range(BITS - STEP, -1, -STEP):
        inside = plan.join(slim.where("number is not null"), F.col("source"), at).where(F.shiftright("number", left + STEP) == F.col("prefix"))
        bins = inside.groupBy("s", F.shiftright("number", left).alias("bin")).agg(F.sum("size").alias("own"), F.count("*").alias("n"), F.first("wanted").alias("wanted"), F.first("before").alias("before"))
        order = Window.partitionBy("s").orderBy("bin")  # at most 2 ** STEP rows a source
        upto = bins.withColumn("upto", F.col("before") + F.sum("own").over(order)).withColumn("last", F.lead("bin").over(order).isNull())
        reached = F.col("last") | (F.col("upto") >= F.col("wanted"))
        found = upto.where(reached).groupBy("s").agg(F.min_by(F.struct("bin", "upto", "own", "n", "wanted"), "bin").alias("m"))
        at = store.stage(found.select("s", F.col("m.wanted").alias("wanted"), F.col("m.bin").alias("prefix"), (F.col("m.upto") - F.col("m.own")).alias("before"), F.col("m.own").alias("own"), F.col("m.n").alias("n")), "thresholds")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("wanted") - F.col("before")) / F.col("own")))
    return at.select(F.col("s").alias("source"), F.col("prefix").alias("tau"), F.round(share * F.col("n")).cast("long").alias("take"), F.col("n").alias("tied"))


def solve(sized: DataFrame, share: float = SHARE, most: float = MOST) -> Plan:
    """The plan for rows (source, size, row_key), staged."""
    spark = sized.sparkSession
    counts = store.stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    found = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")).collect()
    goal = targets([(r.source, r.source_size) for r in found], share, most)
    sources = spark.createDataFrame([(r.source, r.source_size, r.n_docs, float(goal[r.source])) for r in found], "source string, source_size long, n_docs long, target double")
    tilts = balance(counts, sources, most)
    table = sources.join(tilts, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "tilt", "mean")
    plan = Plan(store.stage(table, "plan"), len(found) <= BROADCAST_SOURCES, most)
    cut = thresholds(sized, plan)
    plan.table = store.stage(plan.table.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "plan")
    return plan


def decided(rows: DataFrame, plan: Plan, size: Column, row_key: Column) -> tuple[DataFrame, Column, Column]:
    """rows (already joined with the plan) with the columns that decide; their copies; whether only some rows like this one get one more."""
    r = plan.rate(size)
    number = plan.number(size, r, row_key)
    at_tau = F.coalesce(number == F.col("tau"), F.lit(False))
    more = F.coalesce(number < F.col("tau"), F.lit(False)) | (at_tau & (F.col("take") == F.col("tied")))
    return rows, (F.floor(r) + more.cast("int")).cast("int"), at_tau & (F.col("take") > 0) & (F.col("take") < F.col("tied"))


def share_out(tied: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Rows alike in `by` (source first) that stand at the threshold: (keep as kept, base, n, m), m of n of them get one more copy.

    They are counted in SALTS parts, so that very many alike are no one task's;
    running sums over the parts deal out `take` exactly.
    """
    parts = tied.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).groupBy(*by, "salt").agg(F.count("*").alias("n"), F.first("take").alias("take"), F.first("tied").alias("tied"), F.first("base").alias("base"), F.first(keep).alias("kept"))
    upto = F.sum("n").over(Window.partitionBy(by[0]).orderBy(*by[1:], "salt"))
    return parts.withColumn("upto", upto).withColumn("m", F.floor(F.col("take") * F.col("upto") / F.col("tied")) - F.floor(F.col("take") * (F.col("upto") - F.col("n")) / F.col("tied"))).select("kept", "base", "n", "m")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), measure(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("row_key"))
    rows = store.stage(rows, "sizes")
    plan = solve(rows.select("source", "size", "row_key"), share, most)
    joined, times, some = decided(plan.join(rows, F.col("source")), plan, F.col("size"), F.col("row_key"))
    every = joined.select("doc_id", "source", "size", "row_key", "source_size", "target", "take", "tied", plan.rate(F.col("size")).alias("rate"), times.alias("base"), some.alias("some"))
    out = ["doc_id", "source", "size", "source_size", "target", "rate"]
    whole = every.where(~F.col("some")).select(*out, F.col("base").alias("copies"))
    shared = share_out(every.where("some"), ["source", "row_key", "doc_id", "size"], F.struct(*out)).select("kept.*", "base", "m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return whole.unionByName(shared.select(*out, (F.col("base") + (F.col("i") <= F.col("m")).cast("int")).alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def apply(docs: DataFrame, text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; all columns stay, of whatever name and type.

    The texts are read twice, for their sizes and to repeat the rows in place; they are not shuffled.
    """
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(source_col).cast("string").alias("source"), measure(text_col).alias("size"), row_hash(docs).alias("row_key"))
    plan = solve(store.stage(rows.select("source", "size", "row_key"), "sizes"), share, most)
    joined, times, some = decided(plan.join(rows, F.col("source")), plan, F.col("size"), F.col("row_key"))
    every = joined.select("row", "source", "row_key", "take", "tied", times.alias("base"), some.alias("some"))
    again = F.explode(F.sequence(F.lit(1), F.col("times")))
    out = every.where(~F.col("some") & (F.col("base") > 0)).select("row", F.col("base").alias("times")).select("row", again.alias("i"))
    shared = share_out(every.where("some"), ["source", "row_key"], F.col("row")).select(F.col("kept").alias("row"), (F.col("base") * F.col("n") + F.col("m")).cast("int").alias("times")).where("times > 0").select("row", again.alias("i"))
    return out.unionByName(shared).select("row.*")
