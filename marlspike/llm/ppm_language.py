"""Language identification by prediction by partial matching (operator 3).

For every language a tree of byte contexts is counted on a bounded sample of
labelled texts and then frozen. A context is the bytes before a byte, as many
as the tree knows of, up to ``ORDER``. In a context (method C) a byte seen
there gets n / (total + distinct); the others share distinct / (total +
distinct) in proportion to the next shorter context, bytes already seen
excluded; below the empty context all 256 bytes are alike. A text's code length
under a language is the exact sum of -log2 of its bytes' probabilities; the
shortest wins, and the score is its share of 2^-length over all languages.

The languages' trees are kept as one, whose nodes hold each language's code
length, so a byte is sought once for all languages: the node of its longest
known context and itself, or, where no language saw it there, that context's
escape and the next shorter one. Contexts of one byte and none are plain
tables, longer ones an open-addressing table of exact 64-bit keys.

Bounds, the same for every language however many there are: about ``MOST_DOCS``
texts and ``MOST_SAMPLE`` bytes of a language are learned from (of a very long
text, pieces spread evenly over it, see ``samples.py``); a language brings
``MOST_NODES`` nodes of two and more bytes of context into the common tree, its
rarest of the deepest order go first.

Defined cases: null texts and texts without a letter give ``und`` and score 0;
a text of any length is coded whole; if nothing can be learned from, all texts
are ``und``; ties go to the language that is first by code point; repeated rows
are scored alike; an empty table gives an empty result. Only the named columns
are read, so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .samples import bounded
from .textnum import U, pieces

ORDER = 4
MOST_DOCS, MOST_SAMPLE = 4000, 4 << 20
MOST_NODES = 1 << 17
_SPREAD = U(0x9E3779B97F4A7C15)


def _column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def _keys(data: np.ndarray) -> np.ndarray:
    """For each byte the ``ORDER`` bytes before it and itself, as one number; its low k + 1 bytes are the key of order k."""
    key = data.astype(U)
    for back in range(1, ORDER + 1):
        key[back:] |= data[:-back].astype(U) << U(8 * back)
    return key


def _depth(off: np.ndarray) -> np.ndarray:
    """How many bytes of its own text stand before each byte, up to ``ORDER``."""
    size = np.diff(off)
    return np.minimum(np.arange(off[-1]) - np.repeat(off[:-1], size), ORDER).astype(np.int8)


def _low(order: int) -> np.uint64:
    return U((1 << (8 * (order + 1))) - 1)


class _Index:
    """Open addressing from exact keys to 0, 1, 2, ..."""

    def __init__(self, keys: np.ndarray):
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift = U(64 - bits)
        self.key, self.row = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = todo[self.row[slot[todo]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.row[slot[first]] = first
            self.key[slot[first]] = keys[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.row) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ (keys >> U(29))) * _SPREAD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 where unknown."""
        slot = self._slot(keys)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.row) - 1)
            out[todo] = self.row[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[slot[todo]] != keys[todo])]
        return out


class PPM:
    """Frozen code lengths of all languages: ``short`` for contexts of none and one byte, ``nodes`` and ``escapes`` by longer context."""

    def __init__(self, langs: list[str], short: np.ndarray, nodes: list, escapes: list):
        self.langs, self.short, self.nodes, self.escapes = langs, short, nodes, escapes

    @classmethod
    def fit(cls, samples: dict[str, pa.Array], most_nodes: int = MOST_NODES) -> PPM:
        langs = sorted(samples, key=lambda s: s.encode())
        if not langs:
            return cls([], np.zeros((256 + 65536, 0), np.float32), [], [])
        counted = [_count(samples[x]) for x in langs]
        union, counts = [], []
        left = [most_nodes] * len(langs)
        for k in range(ORDER + 1):  # the shorter contexts first; of the deepest that fit in part the commonest
            own = []
            for i, c in enumerate(counted):
                keys = c[k][0]
                if k > 1:
                    if len(keys) > left[i]:
                        keys = keys[np.argsort(-c[k][1], kind="stable")[: left[i]]]
                    left[i] -= len(keys)
                own.append(keys)
            keys = np.unique(np.concatenate(own))
            n = np.zeros((len(keys), len(langs)))
            for i, c in enumerate(counted):
                own = np.isin(c[k][0], keys, assume_unique=True)
                n[np.searchsorted(keys, c[k][0][own]), i] = c[k][1][own]
            union.append(keys)
            counts.append(n)
        del counted
        short = np.zeros((256 + 65536, len(langs)), np.float32)
        nodes, escapes = [], []
        lower = np.full((256, len(langs)), 1 / 256)
        for k in range(ORDER + 1):
            if k:
                rows = np.searchsorted(union[k - 1], union[k] & _low(k - 1)) if k > 1 else (union[1] & U(255)).astype(np.int64)
                p, context, leave = _blend(union[k] >> U(8), counts[k], lower[rows])
            else:
                full = np.zeros((256, len(langs)))
                full[union[0].astype(np.int64)] = counts[0]
                p, _, _ = _blend(np.zeros(256, U), full, lower)
            if k == 0:
                short[:256] = -np.log2(p)
                lower = p
            elif k == 1:  # a whole table: bytes that nobody saw after another one are escapes to order 0
                table = np.tile(lower, (256, 1))
                for c, e in zip(context.astype(np.int64), leave):
                    table[c * 256 : c * 256 + 256] *= e
                table[union[1].astype(np.int64)] = p
                short[256:] = -np.log2(np.maximum(table, 1e-300))
                lower = p
            else:
                nodes.append((_Index(union[k]), -np.log2(np.maximum(p, 1e-300)).astype(np.float32)))
                escapes.append((_Index(context), -np.log2(np.maximum(leave, 1e-300)).astype(np.float32)))
                lower = p
        return cls(langs, short, nodes, escapes)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): code lengths in bits."""
        data, off = _column_bytes(texts)
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data) or not self.langs:
            return out
        key, depth = _keys(data), _depth(off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        step = max((1 << 21) // len(self.langs), 1 << 12)
        for a in range(0, len(data), step):
            part = slice(a, a + step)
            self._add(key[part], depth[part], doc[part], out)
        return out

    def _add(self, key: np.ndarray, depth: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
        """Add the bytes' code lengths to their documents' sums."""
        bits = np.empty((len(key), len(self.langs)), np.float32)
        todo = np.zeros(0, np.int64)
        for k in range(ORDER, 1, -1):
            todo = np.sort(np.concatenate([todo, np.flatnonzero(depth == k)]))
            own = key[todo] & _low(k)
            index, length = self.nodes[k - 2]
            row = index.find(own)
            known = row >= 0
            bits[todo[known]] = length[row[known]]
            todo, own = todo[~known], own[~known]
            index, leave = self.escapes[k - 2]
            row = index.find(own >> U(8))
            left = row >= 0
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(doc[todo[left]], leave[row[left], i], minlength=len(out))
        todo = np.concatenate([todo, np.flatnonzero(depth == 1)])
        bits[todo] = self.short[256 + (key[todo] & U(65535)).astype(np.int64)]
        todo = np.flatnonzero(depth == 0)
        bits[todo] = self.short[(key[todo] & U(255)).astype(np.int64)]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)


def _count(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each order."""
    parts: list[list] = [[] for _ in range(ORDER + 1)]
    for b in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        data, off = _column_bytes(b.column(0))
        key, depth = _keys(data), _depth(off)
        for k in range(ORDER + 1):
            parts[k].append(np.unique(key[depth >= k] & _low(k), return_counts=True))
    out = []
    for p in parts:
        keys, n = (np.concatenate(x) for x in zip(*p)) if p else (np.zeros(0, U), np.zeros(0, np.int64))
        names, at = np.unique(keys, return_inverse=True)
        out.append((names, np.bincount(at, n, minlength=len(names))))
    return out


def _blend(context: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each node for each language, and each context with what an unseen byte's shorter probability is multiplied by.

    ``context`` is sorted; ``n``: counts, ``lower``: probabilities in the next shorter context (nodes, languages).
    """
    start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros_like(n), context, np.zeros((0, n.shape[1]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))
    total, distinct = np.add.reduceat(n, start, axis=0), np.add.reduceat((n > 0).astype(float), start, axis=0)
    rest = 1 - np.add.reduceat(np.where(n > 0, lower, 0), start, axis=0)
    open_end = (distinct < 256) & (rest > 1e-9)  # else nothing is left to escape to
    distinct = np.where(open_end, distinct, 0)
    leave = np.where(total > 0, np.where(open_end, distinct / np.maximum(total + distinct, 1) / np.maximum(rest, 1e-9), 0), 1.0)
    p = np.where(n > 0, n / np.maximum(total + distinct, 1)[of], leave[of] * lower)
    return p, context[start], leave


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = MOST_DOCS) -> PPM:
    """Learn from ``docs`` (training rows only): texts with a language."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = bounded(rows, "lang", most, "doc_id", "text", MOST_SAMPLE)
    langs = pa.compute.unique(table["lang"]).to_pylist()
    return PPM.fit({x: table.filter(pa.compute.equal(table["lang"], x))["text"].combine_chunks() for x in langs})


def identify(docs: DataFrame, model: PPM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.short, model.nodes, model.escapes))  # MOST_NODES a language
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = rows.drop("text", "letters").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def run(batches):
        ppm = PPM(*sent.value)
        names = np.array([*ppm.langs, "und"], object)
        for b in pieces(batches):
            bits = ppm.lengths(b.column(1))
            letters = b.column(2).to_numpy(zero_copy_only=False) & bool(ppm.langs)
            best = np.full(len(letters), len(ppm.langs))
            score, low = np.zeros(len(letters)), np.zeros(len(letters))
            if ppm.langs:
                low = bits.min(1)
                share = 1 / np.exp2(-(bits - low[:, None])).sum(1)
                best, score = np.where(letters, bits.argmin(1), best), np.where(letters, share, 0.0)
            size = np.diff(_column_bytes(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(low / np.maximum(size, 1))], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, schema)


def language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Learn from the rows outside the held-out fold, then identify all."""
    model = fit(docs.where(~held_out(doc_id)), text, lang, doc_id)
    return identify(docs, model, text, doc_id).withColumn("held_out", held_out("doc_id"))
