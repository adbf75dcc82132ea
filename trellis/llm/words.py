"""Vectorised scanning of whole texts: words, their hashes, n-grams.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 those
bytes never occur inside a longer character, so byte and character views agree.
Everything is O(bytes) numpy work on one batch; long texts are hashed in blocks
cut at word boundaries, so scratch memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 2**62, 32, dtype=np.int64)]
BLOCK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 4 * BLOCK:
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Scan:
    """Words of a batch of texts.

    data: all bytes, each text followed by one space. starts/ends: byte bounds
    of every word. first[i]:first[i + 1] are the words of text i, and
    offset[i]:offset[i + 1] - 1 its bytes.
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = False, table: np.ndarray | None = None):
        """lower: A-Z as a-z. table: what stands for each byte, a space where it belongs to no word."""
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.offset = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.offset[1:])
        self.data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
        self.raw = self.data
        if lower or table is not None:
            self.data = (_LOWER if table is None else table)[self.data]
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1 if len(space) else np.zeros(0, np.int64)
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offset)

    def __len__(self) -> int:
        return len(self.offset) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), U64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + BLOCK)))
            s, e = int(self.starts[a]), int(self.ends[b - 1])
            up, down = _power_tables(e - s + 1)
            sums = np.zeros(e - s + 1, U64)
            np.cumsum(_VALUE[self.data[s:e]] * up[: e - s], out=sums[1:])
            lo, hi = self.starts[a:b] - s, self.ends[a:b] - s
            out[a:b] = (sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64)
            a = b
        return mix(out)

    def grams(self, word_hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 words of the batch have none."""
        n = max(0, len(word_hashes) - k + 1)
        g = word_hashes[:n] * U64(_STEP[0])
        for j in range(1, k):
            g += word_hashes[j : j + n] * U64(_STEP[j])
        return mix(g)

    def shingle_sets(self, word_hashes: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Per text the sorted distinct k-word shingles; of fewer words, the whole sequence as one."""
        g = self.grams(word_hashes, k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield s
            elif b > a:
                w = word_hashes[a:b]
                with np.errstate(over="ignore"):
                    whole = (w * np.array(_STEP[: b - a], U64)).sum(dtype=U64) + U64(b - a)
                yield mix(np.array([whole], U64))
            else:
                yield np.zeros(0, U64)


def chunks(texts: list[str | bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text makes a range of its own."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and total + n > size:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def over(texts: Iterable[str | None], k: int) -> list[set]:
    """Brute force for tests: shingle sets as Python sets of tuples."""
    out = []
    for t in texts:
        w = (t or "").encode().translate(bytes(_LOWER)).split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out
