"""Vectorised view of whole texts: word bounds and 64-bit word hashes of an Arrow column."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def splitmix(n: int, seed: int = 1) -> np.ndarray:
    """``n`` well-spread 64-bit numbers made by the splitmix rule."""
    z = (np.arange(1, n + 1, dtype=np.uint64) + U(seed << 20)) * U(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


with np.errstate(over="ignore"):
    BYTE = splitmix(256, 7) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_power: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(n, U(b))
            p[0] = U(1)
            _power[k] = np.cumprod(p, dtype=U)
    return _power[0], _power[1]


class Words:
    """Words of consecutive documents: ``data`` bytes, ``offsets`` of documents,
    ``start``/``end`` byte positions, ``doc`` number and ``count`` per document."""

    def __init__(self, texts: pa.Array, part_of_word: np.ndarray | None = None):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        n = len(texts)
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        self.n, self.data, self.offsets = n, data, off - off[0]
        inside = ~SPACE[data] if part_of_word is None else part_of_word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def span_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hashes of byte spans."""
        with np.errstate(over="ignore"):
            power, inverse = powers(len(self.data) + 1)
            run = np.zeros(len(self.data) + 1, U)
            np.cumsum((BYTE_LOWER if lower else BYTE)[self.data] * power[: len(self.data)], dtype=U, out=run[1:])
            return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(U))

    def hashes(self, lower: bool = True) -> np.ndarray:
        return self.span_hash(self.start, self.end, lower)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word's number of each ``k``-word window that stays in its document."""
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        odd = splitmix(k, 11 + k) | U(1)
        with np.errstate(over="ignore"):
            g = np.zeros(len(at), U)
            for j in range(k):
                g += h[at + j] * odd[j]
            return mix(g + U(k)), at

    def shingles(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``k``-word shingles as (hash, doc), ordered by doc then hash.
        A document with fewer words has one shingle: its whole word sequence."""
        g, at = self.grams(h, k)
        doc = self.doc[at]
        for d in np.flatnonzero((self.count > 0) & (self.count < k)):
            own = h[self.first[d] : self.first[d + 1]]
            odd = splitmix(len(own), 911) | U(1)
            with np.errstate(over="ignore"):
                g = np.append(g, mix(np.array([np.sum(own * odd, dtype=U)]) + U(100 + len(own))))
            doc = np.append(doc, d)
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
            g, doc = g[new], doc[new]
        return g, doc


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text (a longer text is a piece alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column).cast(pa.binary())), 0)).astype(np.int64)
        run, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def together(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows with successive batches joined while their text stays below about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in pieces(batches, column, most):
        own = pa.compute.sum(pa.compute.binary_length(b.column(column))).as_py() or 0
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
