"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate; content share decides.

Base figures come from one vectorised scan of each whole text. Each line that
has a word is a node of the chain; its features are cheap byte statistics.
Viterbi decoding gives the best state sequence; content share is the share of
word characters that stand in content lines, and a document is kept if that
share reaches a threshold and the base rules hold.

Training maximises the conditional likelihood of whole line sequences, by
forward and backward sums and quasi-Newton steps. The labels are of documents:
lines of good ones count as content, lines of bad ones as boilerplate, then two
rounds of logistic regression on single lines call those lines of bad documents
content that look like it; the chain is fitted to what then stands. The sample
has at most about SAMPLE documents of each class, chosen by a hash of doc_id,
and of each at most SAMPLE_LINES lines that follow one another, from a place
that a hash of the text gives. Without both classes the DEFAULT weights hold.
All else covers all rows and whole texts.

Null or empty text has no words, so the base rules reject it. Repeated rows
each give a row; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import Scan, chunks

SAMPLE, SAMPLE_LINES = 3000, 100
#: Characters that are scanned at once.
SCAN = 1 << 19
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
LEAST_SHARE = 0.5
WHITE = " \t\n\x0b\x0c\r"
FEATURES = ("bias", "log_words", "symbols", "upper", "exclaims", "stutter", "pipes", "digits", "stop", "word_size", "duplicate")
#: Used when the labels lack a class.
DEFAULT = (-3.0, -0.2, 4.0, 4.0, 3.0, 6.0, 4.0, 1.0, -0.5, 0.0, 1.0)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.int8)
    m[list(chars)] = 1
    return m


_SYMBOL, _PIPE, _BANG = _mask(b"#*$%&|<>"), _mask(b"|"), _mask(b"!")
_DIGIT, _UPPER, _STOP = _mask(b"0123456789"), _mask(bytes(range(65, 91))), _mask(b".!?:;")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
_WORD = np.ones(256, np.int8)
_WORD[[0x20, *range(9, 14), *range(0x80, 0xC0)]] = 0


def _sums(per_byte: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of per_byte between neighbouring cuts."""
    total = np.zeros(len(per_byte) + 1, np.int64)
    np.cumsum(per_byte, out=total[1:])
    return np.diff(total[cuts])


@dataclass
class Lines:
    """The scanned batch: figures of each text, features of each line with a word, first[i]:first[i + 1] the lines of text i."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    number: np.ndarray


def _repeated(grams: np.ndarray, n: int) -> int:
    """Words in windows that occur at least twice; grams: the windows' hashes."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def scan(texts: list[str | None]) -> Lines:
    s = Scan(texts)
    h, data, n = s.hashes(), s.data, len(s)
    word_char = _WORD[data]
    symbols = _SYMBOL[data]
    g = s.grams(h, WINDOW)
    repeats = [_repeated(g[a : b - WINDOW + 1], b - a) if b - a >= WINDOW else 0 for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist())]
    dup_lines, dup = [], []
    for t in texts:
        seen: set[str] = set()
        m = 0
        for line in (t or "").split("\n"):
            again = line in seen
            if again:
                m += 1
            elif line.strip(WHITE):
                seen.add(line)
            dup.append(again)
        dup_lines.append(m)
    # a line ends at its line feed, a text's last one at the space behind the text
    feed = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feed, s.offset[1:] - 1]))
    cuts = np.concatenate([[0], ends + 1])
    at = np.searchsorted(s.starts, cuts)
    words = np.diff(at)
    full = words > 0
    of = lambda lut: _sums(lut[data], cuts)[full]
    w, chars = words[full].astype(float), _sums(word_char, cuts)[full]
    letters = np.maximum(1, of(_LETTER))
    stutter = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        stutter[2:] = np.cumsum(h[1:] == h[:-1])
    inside = np.maximum(stutter[at[1:]] - stutter[np.minimum(at[:-1] + 1, len(h))], 0)[full]
    last = data[s.ends[at[1:][full] - 1] - 1] if len(h) else np.zeros(0, np.uint8)
    f = np.column_stack([
        np.ones(len(w)), np.log1p(w) / 4, np.minimum(2, _sums(symbols, cuts)[full] / w), of(_UPPER) / letters, np.minimum(2, of(_BANG) / w), inside / np.maximum(1, w - 1),
        np.minimum(1, of(_PIPE) / w), np.minimum(1, of(_DIGIT) / np.maximum(1, chars)), _STOP[last], np.minimum(2, chars / w / 10), np.array(dup, bool)[full],
    ]).astype(np.float64)
    first_line = np.searchsorted(ends, s.offset)
    kept_before = np.concatenate([[0], np.cumsum(full)])
    number = (np.arange(len(full)) - np.repeat(first_line[:-1], np.diff(first_line)))[full]
    return Lines(s.counts, _sums(word_char, s.offset), _sums(symbols, s.offset), np.array(dup_lines, np.int64), np.array(repeats, np.int64), f, chars, kept_before[first_line], number)


@dataclass
class Chain:
    """Node weights (log odds of boilerplate) and chain weights; state 0 is content, 1 boilerplate."""

    weights: list[float] = field(default_factory=lambda: list(DEFAULT))
    start: list[float] = field(default_factory=lambda: [0.0, -0.5])
    step: list[list[float]] = field(default_factory=lambda: [[0.0, -1.0], [-1.0, 0.0]])

    def decode(self, odds: list[float]) -> list[int]:
        """Viterbi: the states of highest total score."""
        (cc, cb), (bc, bb) = self.step
        back, c, b = [], 0.0, 0.0
        for i, o in enumerate(odds):
            if i:
                c0, c1, b0, b1 = c + cc, b + bc, c + cb, b + bb
                back.append((c1 > c0, b1 >= b0))
                c, b = (c1 if c1 > c0 else c0), (b1 if b1 >= b0 else b0) + o
            else:
                c, b = self.start[0], self.start[1] + o
        state, out = int(b > c), []
        for i in range(len(odds) - 1, -1, -1):
            out.append(state)
            if i:
                state = int(back[i - 1][state])
        return out[::-1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 12, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, g)
    return w


class Sequences:
    """Line sequences side by side, the longest first, for sums over all state sequences at once."""

    def __init__(self, features: list[np.ndarray], states: list[np.ndarray], weight: np.ndarray):
        order = np.argsort([-len(f) for f in features], kind="stable")
        self.x, self.y = [features[i] for i in order], [states[i] for i in order]
        self.weight = weight[order]
        n = np.array([len(f) for f in self.x])
        self.active = [int((n > t).sum()) for t in range(n.max())]
        # line t of every sequence that has one
        self.flat = [np.array([self.x[i][t] for i in range(m)]) for t, m in enumerate(self.active)]
        self.at = [np.array([self.y[i][t] for i in range(m)]) for t, m in enumerate(self.active)]

    def likelihood(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted log likelihood of the states and its gradient. p: node weights, start (2), step (4)."""
        k = len(p) - 6
        start, step = p[k : k + 2], p[k + 2 :].reshape(2, 2)
        odds = [f @ p[:k] for f in self.flat]
        m = np.exp(step - step.max())
        # forward, each line's vector scaled to sum 1
        alpha, scale = [], []
        for t, n in enumerate(self.active):
            a = np.exp(start - start.max())[None, :].repeat(n, 0) if t == 0 else alpha[-1][:n] @ m
            top = np.maximum(odds[t], 0)
            a = a * np.exp(np.column_stack([-top, odds[t] - top]))
            z = a.sum(axis=1)
            alpha.append(a / z[:, None])
            scale.append(np.log(z) + top + (start.max() if t == 0 else step.max()))
        total = 0.0
        grad = np.zeros(len(p))
        beta = None
        for t in range(len(self.active) - 1, -1, -1):
            n, w, y = self.active[t], self.weight[: self.active[t]], self.at[t]
            rest = np.ones((n, 2))
            if beta is not None:  # what follows line t, of the sequences that go on
                on = len(beta)
                top = np.maximum(odds[t + 1], 0)
                ahead = beta * np.exp(np.column_stack([-top, odds[t + 1] - top]))
                both = alpha[t][:on, :, None] * m[None] * ahead[:, None, :]
                both /= both.sum(axis=(1, 2), keepdims=True)
                seen = np.zeros((on, 2, 2))
                seen[np.arange(on), y[:on], self.at[t + 1]] = 1
                grad[k + 2 :] += (self.weight[:on, None, None] * (seen - both)).sum(axis=0).ravel()
                total += float(self.weight[:on] @ step[y[:on], self.at[t + 1]])
                back = ahead @ m.T
                rest[:on] = back / back.sum(axis=1, keepdims=True)
            node = alpha[t] * rest
            node /= node.sum(axis=1, keepdims=True)
            grad[:k] += (w * (y - node[:, 1])) @ self.flat[t]
            total += float(w @ (y * odds[t])) - float(w @ scale[t])
            if t == 0:
                grad[k : k + 2] += [float(w @ ((y == s) - node[:, s])) for s in (0, 1)]
                total += float(w @ start[y])
            beta = rest
        return total, grad


def maximise(f, p: np.ndarray, rounds: int = 60) -> np.ndarray:
    """BFGS with step halving: the maximum of a concave f, which gives value and gradient."""
    inverse = np.eye(len(p))
    value, g = f(p)
    for k in range(rounds):
        direction = inverse @ g
        if k == 0:
            direction = g / max(1.0, float(np.abs(g).max()))
        rate, slope = 1.0, float(g @ direction)
        while rate > 1e-8:
            new, ng = f(p + rate * direction)
            if new >= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = rate * direction, g - ng
        gain = new - value
        p, value, g = p + s, new, ng
        if (sy := float(s @ y)) > 1e-12:
            if k == 0:
                inverse *= sy / float(y @ y)
            left = np.eye(len(p)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return p


#: Prior variance of the weights, whose mean is 0.
VARIANCE = 10.0


def fit_chain(features: list[np.ndarray], states: list[np.ndarray], weight: np.ndarray, first: np.ndarray) -> Chain:
    """The chain of highest likelihood (with a Gaussian prior), from node weights to begin with."""
    sequences, k = Sequences(features, states, weight), features[0].shape[1]

    def target(p):
        value, g = sequences.likelihood(p)
        return value - float(p @ p) / (2 * VARIANCE), g - p / VARIANCE

    p = maximise(target, np.concatenate([first, np.zeros(6)]))
    return Chain(p[:k].tolist(), p[k : k + 2].tolist(), p[k + 2 :].reshape(2, 2).tolist())


def train(docs: list[tuple[int, np.ndarray]]) -> Chain:
    """docs: (1 if good else 0, features of neighbouring lines) of each labelled document."""
    docs = [(q, f) for q, f in docs if len(f)]
    if len({q for q, _ in docs}) < 2:
        return Chain()
    x = np.concatenate([f for _, f in docs])
    bad = np.concatenate([np.full(len(f), q == 0) for q, f in docs])
    y = bad.astype(float)
    for _ in range(3):
        share = y.mean()
        w = _logistic(x, y, np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)))
        y = (bad & (x @ w > 0)).astype(float)
        if not 0 < y.mean() < 1:
            return Chain()
    cut = np.cumsum([0, *(len(f) for _, f in docs)])
    states = [y[a:b].astype(int) for a, b in zip(cut[:-1], cut[1:])]
    good = sum(q for q, _ in docs)
    weight = np.array([len(docs) / 2 / (good if q else len(docs) - good) for q, _ in docs])
    return fit_chain([f for _, f in docs], states, weight, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Train on a bounded sample of documents (doc_id, text) with labels (doc_id, quality)."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("q"), F.max("quality").cast("int").alias("other")).where("q = other")
    count = {r.q: r["count"] for r in good.groupBy("q").count().collect()}
    rate = F.when(F.col("q") == 1, F.lit(int(min(1.0, sample / max(1, count.get(1, 0))) * 1e6))).otherwise(F.lit(int(min(1.0, sample / max(1, count.get(0, 0))) * 1e6)))
    chosen = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate).select("doc_id", "q")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("q", "text")

    def measure(batches):
        store.worker_cache("op1")
        for b in batches:
            for q, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = scan([t]).features
                a = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (max(0, len(f) - SAMPLE_LINES) + 1) if t else 0
                f = f[a : a + SAMPLE_LINES]  # neighbours, as the chain needs them
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([f.astype("<f4").tobytes()], pa.binary())], ["q", "f"])

    rows = texts.mapInArrow(store.trimmed(measure), "q int, f binary").collect()
    return train(sorted(((r.q, np.frombuffer(r.f, "<f4").reshape(-1, len(FEATURES)).astype(float)) for r in rows), key=lambda d: (d[0], d[1].tobytes())))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines array<int>"


def judge(texts: list[str | None], chain: Chain, least_share: float = LEAST_SHARE) -> list[pa.Array]:
    """The columns of SCHEMA after doc_id."""
    s = scan(texts)
    odds = (s.features @ np.array(chain.weights)).tolist()
    share, content = [], []
    chars, number, first = s.chars.tolist(), s.number.tolist(), s.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        states = chain.decode(odds[a:b])
        lines = [i for i, x in zip(range(a, b), states) if x == 0]
        content.append([number[i] for i in lines])
        share.append(sum(chars[i] for i in lines) / max(1, sum(chars[a:b])))
    failed = (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > MOST_REPEATED * s.n_words)
    kept = ~failed & (np.array(share) >= least_share)
    longs = [pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
    return [*longs, pa.array(failed), pa.array(kept), pa.array(np.array(share, float)), pa.array(content, pa.list_(pa.int32()))]


def rate(docs: DataFrame, chain: Chain, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row; content_lines are the numbers, from 0, of its content lines."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    store.small_batches(docs.sparkSession)

    def run(batches):
        store.worker_cache("op1")
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for a, z in chunks(texts, SCAN):
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), *judge(texts[a:z], shared.value, least_share)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(store.trimmed(run), SCHEMA)


def keep(docs: DataFrame, chain: Chain, least_share: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    store.small_batches(docs.sparkSession)

    def run(batches):
        store.worker_cache("op1")
        for b in batches:
            texts = b.column(at).to_pylist()
            for a, z in chunks(texts, SCAN):
                yield b.slice(a, z - a).filter(judge(texts[a:z], shared.value, least_share)[6])

    return docs.mapInArrow(store.trimmed(run), docs.schema)
