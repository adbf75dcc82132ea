"""Benchmark decontamination: word pairs find passages, Smith-Waterman alignment scores them.

The filter loses nothing. A local alignment that reaches `least` of an item's
own score has at most e = MATCH * (1 - least) * n mismatches and gaps together
(n: the item's words), so it spans at most n + e words of the document and at
least n - e - 1 of its neighbouring words stand side by side in the item too.
Where that is at least one, the item's seeds are its word pairs (ASCII lower
case), otherwise its words, of which an alignment has at least least * n. A
passage is aligned if it holds so many seeds of an item within so many words,
however frequent they are, and so many of the item's words. score is the best
local alignment's part of the item's own score.

Every document is read once and judged alone. Items are a stated query set:
they are broadcast, in blocks of at most BLOCK_CHARS characters, each block
against all documents. Candidates are neither capped nor sampled.

Null or empty texts match nothing. Items of fewer than LEAST_ITEM words, and
null items, match nothing. A document that holds an item several times gives
its best passage; ties go to the first. Repeated rows each give their rows; an
empty table or benchmark gives none. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import Scan, chunks

LEAST_ITEM = 5
LEAST_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_CHARS = 16 << 20
#: So many (place, item) entries of whole documents are sorted at once.
ENTRIES = 1 << 20


@dataclass
class Items:
    """A block of benchmark items: their word hashes, and every seed with the items that hold it.

    need and span: an item's least seeds in a passage, and the most words between them.
    """

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    span: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Lengths of the seeds in words.
    sizes: tuple[int, ...] = ()

    @staticmethod
    def of(rows: list[tuple[int, str | None]], least: float = LEAST_SCORE) -> Items:
        s = Scan([t for _, t in rows], lower=True)
        h = s.hashes()
        grams = {k: s.grams(h, k) for k in (1, 2)}
        ids, words, seeds, item, need, span, sizes = [], [], [], [], [], [], set()
        for i, (a, b) in enumerate(zip(s.first[:-1], s.first[1:])):
            n = int(b - a)
            if n >= LEAST_ITEM:
                edits = spoiled(n, least)
                k = 2 if n - edits - 1 >= 1 else 1
                sizes.add(k)
                found = np.unique(grams[k][a : b - k + 1])
                seeds.append(found)
                item.append(np.full(len(found), len(ids)))
                ids.append(rows[i][0])
                words.append(h[a:b])
                need.append(n - edits - 1 if k == 2 else held(n, least))
                span.append(n + edits)
        if not ids:
            return Items()
        every, of = np.concatenate(seeds), np.concatenate(item)
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        return Items(ids, words, every[new], np.append(np.flatnonzero(new), len(every)), of, np.array(need), np.array(span), tuple(sorted(sizes)))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seed numbers of grams that are seeds."""
        if not len(self.seeds) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # most grams fail a small table of hash bits; only the rest are searched
        at = np.flatnonzero(self.sieve[grams & np.uint64(len(self.sieve) - 1)])
        place = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        hit = self.seeds[place] == grams[at]
        return at[hit], place[hit]

    def prepare(self) -> None:
        bits = max(10, int(len(self.seeds) * 16).bit_length())
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.seeds & np.uint64((1 << bits) - 1)] = True


def spoiled(n: int, least: float) -> int:
    """Most mismatches and gaps of an alignment that reaches least of the score of n words."""
    return int(MATCH * (1 - least) * n / min(MISMATCH, GAP) + 1e-9)


def held(n: int, least: float) -> int:
    """Least words that such an alignment matches."""
    return max(1, int(np.ceil(least * n - 1e-9)))


def places(s: Scan, h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and seed number of every seed of a batch, by text."""
    found = []
    for k in items.sizes:
        at, seed = items.find(s.grams(h, k))
        doc = np.searchsorted(s.first, at, side="right") - 1
        inside = at + k <= s.first[doc + 1]
        found.append((doc[inside], at[inside], seed[inside]))
    doc, at, seed = map(np.concatenate, zip(*found))
    order = np.argsort(doc, kind="stable")
    return doc[order], at[order], seed[order]


def passages(doc: np.ndarray, at: np.ndarray, seed: np.ndarray, items: Items):
    """(text, item, from, to) of words where enough seeds of an item stand close together, by text, item and place."""
    n = items.first[seed + 1] - items.first[seed]
    total = np.cumsum(n)
    x = 0
    while x < len(doc):
        y = int(np.searchsorted(total, (total[x - 1] if x else 0) + ENTRIES, side="right"))
        if y < len(doc) and (y := int(np.searchsorted(doc, doc[y]))) <= x:
            y = int(np.searchsorted(doc, doc[x], side="right"))
        m = n[x:y]
        entry = np.repeat(items.first[seed[x:y]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        of, pos, it = np.repeat(doc[x:y], m), np.repeat(at[x:y], m), items.item[entry]
        order = np.lexsort((pos, it, of))
        of, pos, it = of[order], pos[order], it[order]
        last = np.arange(len(pos)) + items.need[it] - 1
        there = np.minimum(last, len(pos) - 1)
        start = np.flatnonzero((last < len(pos)) & (of[there] == of) & (it[there] == it) & (pos[there] - pos <= items.span[it]))
        of, pos, it = of[start], pos[start], it[start]
        reach = items.span[it]
        # windows of one text and item that overlap are one passage
        new = np.ones(len(pos), bool)
        new[1:] = (of[1:] != of[:-1]) | (it[1:] != it[:-1]) | (pos[1:] - pos[:-1] > 2 * reach[1:])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(pos))[: len(a)] - 1
        yield from zip(of[a].tolist(), it[a].tolist(), (pos[a] - reach[a]).tolist(), (pos[b] + reach[b]).tolist())
        x = y


def holds(item: np.ndarray, words: np.ndarray, span: int, least: int) -> bool:
    """Whether some span words have at least so many that are the item's."""
    count = np.append(0, np.cumsum(np.isin(words, item)))
    return int((count[span:] - count[:-span]).max() if len(words) > span else count[-1]) >= least


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman of two word sequences, linear gaps: the best score by the item's own, and the end in words."""
    n = len(words)
    if not n or not len(item):
        return 0.0, 0
    slope = np.arange(n + 1) * GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, -MISMATCH), row[1:] - GAP)
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best / (MATCH * len(item)), end


def match(s: Scan, items: Items, least: float) -> list[tuple[int, int, float, int]]:
    """(text, item number, score, end word) of the items that the texts of a batch hold."""
    h = s.hashes()
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for doc, item, a, b in passages(*places(s, h, items), items):
        start = int(s.first[doc])
        a, b = max(a, start), min(b, int(s.first[doc + 1]))
        own = items.words[item]
        if not holds(own, h[a:b], int(items.span[item]), held(len(own), least)):
            continue
        score, end = align(own, h[a:b])
        if score >= least and score > best.get((doc, item), (0.0, 0))[0]:
            best[doc, item] = score, a - start + end
    return [(d, i, v, e) for (d, i), (v, e) in sorted(best.items())]


def blocks(bench: DataFrame, item_col: str, text_col: str, least: float = LEAST_SCORE):
    """The benchmark, in blocks of bounded size."""
    rows = bench.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        if (items := Items.of(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r)), least)).ids:
            items.prepare()
            yield items


SCHEMA = "doc_id long, item_id long, score double, end_word long"


def decontaminate(docs: DataFrame, bench: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """SCHEMA: a row for each document and item that it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [_one_block(rows, items, least) for items in blocks(bench, item_col, item_text, least)]
    out = spark.createDataFrame([], SCHEMA)
    for f in found:
        out = f if len(found) == 1 else out.unionByName(f)
    return out


def _one_block(rows: DataFrame, items: Items, least: float) -> DataFrame:
    spark = rows.sparkSession
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(items)

    def score(batches):
        store.worker_cache("op10")
        known = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for x, y in chunks(texts):
                out = match(Scan(texts[x:y], lower=True), known, least)
                doc, item, value, end = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(x, y - x).take(pa.array(doc, pa.int64())), pa.array([known.ids[i] for i in item], pa.int64()), pa.array(value, pa.float64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "end_word"]
                )

    return rows.mapInArrow(store.trimmed(score), SCHEMA)
