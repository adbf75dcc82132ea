"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning: priors are counted over all learnable rows, of every lang value;
n-gram counts come from a sample of at most about TRAIN_PER_LANG documents of
each, chosen by a hash of doc_id. The log-probability matrix (BUCKETS x
languages, float32, 64 KB a language) is broadcast in blocks of LANG_BLOCK
languages. Lang values are names of languages: more than MOST_LANGS raise an
error before anything is collected, and none is ever left out.

Scoring: the texts of a batch are one array of characters; their n-grams become
sorted (text, bucket) keys with counts, a sparse matrix. Block by block of
languages, the rows of log probabilities that it needs are gathered, weighted
and summed by text, and the best score and the sum of all are carried along.
Rows never leave their task, so nothing is shuffled.

A text is lower-cased, what is not a letter becomes one space, and its 1-, 2-
and 3-grams are hashed. Null text or text without a letter: `und`, score 0.
Equal scores: the first language in code-point order. Without a learnable row
every text is `und`. A null doc_id is neither held out nor learned from.
Repeated rows each give a row; other columns are ignored; a text longer than
BLOCK characters is counted in blocks, whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import chunks

BITS = 14
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
TRAIN_PER_LANG = 4000
#: Languages of one broadcast block (16 MB), and most in all (512 MB of matrix).
LANG_BLOCK, MOST_LANGS = 256, 8192
ALPHA = 0.5
BLOCK = 1 << 18
#: Entries of the sparse matrix, times languages, that are gathered at once.
GATHER = 1 << 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each character below 0x10000: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if c.size and c.max() >= 0x10000:
        out = np.where(c < 0x10000, _letters()[np.minimum(c, 0xFFFF)], c)
        for u in np.unique(c[c >= 0x10000]):
            if not chr(u).isalpha():
                out[c == u] = 32
        return out
    return _letters()[c]


def _grams(seq: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of a sequence of characters."""
    size = max(0, len(seq) - n + 1)
    g = seq[:size] + np.uint64(n)
    for j in range(1, n):
        g = g * _P + seq[j : j + size]
    return ((g * _MULT) >> np.uint64(64 - BITS)).astype(np.int64)


def long_profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one text, block by block."""
    low, total = text.lower(), np.zeros(BUCKETS, np.int64)
    seen = np.zeros(0, np.uint64)
    for a in range(0, len(low), BLOCK):
        codes = _codes((" " if a == 0 else "") + low[a : a + BLOCK] + (" " if a + BLOCK >= len(low) else ""))
        space = codes == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= not len(seen) or seen[-1] != 32
        seq = np.concatenate([seen, codes[keep].astype(np.uint64)])
        for n in ORDERS:
            total += np.bincount(_grams(seq[max(0, len(seen) - n + 1) :], n), minlength=BUCKETS)
        seen = seq[-(max(ORDERS) - 1) :]
    used = np.flatnonzero(total)
    return used, total[used]


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse matrix of a batch of texts: text, bucket and count of every entry, by text and bucket. Texts without a letter have none."""
    doc, bucket, count = [], [], []
    short = [i for i, t in enumerate(texts) if t and len(t) <= BLOCK]
    for i, t in enumerate(texts):
        if t and len(t) > BLOCK:
            if any(x.isalpha() for x in t):
                b, n = long_profile(t)
                doc.append(np.full(len(b), i))
                bucket.append(b)
                count.append(n)
    if short:
        # each text between two spaces of its own: a leading one, and one behind the text
        low = [texts[i].lower() for i in short]
        codes = _codes(" " + "  ".join(low) + " ")
        size = np.array([len(t) + 2 for t in low])
        of = np.repeat(np.arange(len(low)), size)
        space = codes == 32
        keep = ~space
        keep[1:] |= ~space[:-1] | (of[1:] != of[:-1])
        keep[0] = True
        letters = np.bincount(of[~space], minlength=len(low)) > 0
        keep &= letters[of]
        seq, of = codes[keep].astype(np.uint64), of[keep]
        keys = []
        for n in ORDERS:
            g = _grams(seq, n)
            inside = of[: len(g)] == of[n - 1 :] if len(g) else np.zeros(0, bool)
            keys.append(((of[: len(g)][inside] << BITS) | g[inside]).astype(np.int32 if len(low) < 1 << 31 - BITS else np.int64))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        key = key.astype(np.int64)
        doc.append(np.array(short)[key >> BITS])
        bucket.append(key & (BUCKETS - 1))
        count.append(n)
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, b, n = np.concatenate(doc), np.concatenate(bucket), np.concatenate(count)
    order = np.argsort(d, kind="stable")
    return d[order], b[order], n[order]


class Model:
    """Languages in code-point order, their log priors, and blocks of log probabilities (BUCKETS x languages)."""

    def __init__(self, langs: list[str], docs: list[int], counts: np.ndarray):
        self.langs = langs
        self.prior = np.log(np.array(docs, float) / max(1, sum(docs)))
        smooth = counts + ALPHA
        logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.blocks = [np.ascontiguousarray(logp[:, a : a + LANG_BLOCK]) for a in range(0, len(langs), LANG_BLOCK)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its probability."""
        return predict(texts, self.langs, self.prior, self.blocks)


def predict(texts: list[str | None], langs: list[str], prior: np.ndarray, blocks) -> tuple[list[str], np.ndarray]:
    """Sparse scoring of a batch: best score and log of the sum of all, over blocks of languages."""
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    doc, bucket, n = profiles(texts) if langs else (np.zeros(0, np.int64),) * 3
    if not len(doc):
        return out, score
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    some = doc[first]
    best, who, total = np.full(len(some), -np.inf), np.zeros(len(some), np.int64), np.zeros(len(some))
    a = 0
    for block in blocks:
        z = np.array(block.shape[1])
        s = np.empty((len(some), int(z)))
        step = max(1, GATHER // int(z))
        ends = np.append(first[1:], len(doc))
        x = 0
        while x < len(some):  # whole texts, of about so many entries together
            y = max(x + 1, int(np.searchsorted(ends, first[x] + step, side="right")))
            lo, hi = first[x], ends[y - 1]
            weighted = block[bucket[lo:hi]].astype(np.float64) * n[lo:hi, None]
            s[x:y] = np.add.reduceat(weighted, first[x:y] - lo, axis=0)
            x = y
        s += prior[a : a + int(z)]
        top, at = s.max(axis=1), s.argmax(axis=1)
        high = np.maximum(best, top)
        total = total * np.exp(best - high) + np.exp(s - high[:, None]).sum(axis=1)
        who = np.where(top > best, a + at, who)
        best, a = high, a + int(z)
    score[some] = 1 / total
    for i, k in zip(some.tolist(), who.tolist()):
        out[i] = langs[k]
    return out, score


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model:
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    priors = store.stage(learn.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("docs")), "langs")
    if (many := priors.count()) > MOST_LANGS:
        raise ValueError(f"{many} lang values; a model holds {MOST_LANGS}")
    found = {r.lang: r.docs for r in priors.collect()}
    if not found:
        return Model([], [], np.zeros((0, BUCKETS)))
    rate = priors.select(F.col("lang").alias("l"), (F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("docs")) * 1_000_000).cast("long").alias("rate"))
    sample = learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1_000_000)).alias("h"))
    sample = sample.join(F.broadcast(rate), F.col("lang") == F.col("l")).where("h < rate").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for x, y in chunks(texts):
                doc, bucket, n = profiles(texts[x:y])
                for i in np.unique(doc).tolist():
                    mine, lang = doc == i, langs[x + i]
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang][bucket[mine]] += n[mine]
        for lang, p in sums.items():
            used = np.flatnonzero(p)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(p[used])], ["lang", "bucket", "n"])

    # the sample is small: a few tasks sum it, so that few partial sums are shuffled
    store.small_batches(docs.sparkSession)
    rows = sample.repartition(8).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(found)
    counts = np.zeros((len(langs), BUCKETS))
    at = {x: i for i, x in enumerate(langs)}
    if rows.num_rows:
        counts[[at[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, [found[x] for x in langs], counts)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Without a model, one is learned from docs."""
    spark = docs.sparkSession
    model = model or fit(docs, id_col, text_col, lang_col)
    head, blocks = (model.langs, model.prior), [spark.sparkContext.broadcast(b) for b in model.blocks]
    store.small_batches(spark)

    def score(batches):
        store.worker_cache("op2")
        for b in batches:
            texts = b.column(2).to_pylist()
            for x, y in chunks(texts):
                langs, p = predict(texts[x:y], *head, (m.value for m in blocks))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(langs, pa.string()), pa.array(p, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
