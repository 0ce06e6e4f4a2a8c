"""Toxic spans by a linear-chain conditional random field (operator 1).

Words (runs of letters) get one of two tags, plain or toxic. Documents carry
labels, words don't, so training words are tagged from the documents' labels: a
word is toxic in a toxic document if it, or its first five bytes, is far
commoner in toxic than in other training documents. A first field is fitted to
these tags; in toxic documents its own marginals then tag words that the counts
alone were too few to show, and the field is fitted on. A chain is a line,
however long. Emission weights sit in a hashed table (the word, its first four
and five and last three bytes, its neighbours); transitions are learned with
them by stochastic gradient steps on the conditional likelihood of all chains
of the sample.

Scoring runs forward-backward over each chain, as a scan of 2 x 2 matrices in
blocks: all chains of a piece of text at once, exact for chains of any length.
A document's score is a logistic function, fitted on training documents held
back from the field, of its highest marginal, its expected number of toxic
words and its length; words whose marginal reaches one half are the offending
spans.

Bounds of the sample: ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, with
the bounds on their texts' bytes in ``samples.py``.

Defined cases: null texts and texts without a letter have no words and take the
score of "no evidence"; a text or line of any length is scored whole; without a
toxic training document every score is 0; a document labelled twice counts
twice, equal scores are no ties to break; repeated rows are scored alike; an
empty table gives an empty result. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches
from .samples import labelled_texts
from .textnum import LETTER, U, Words, pieces, splitmix

TABLE = 1 << 18
MOST_TOXIC, MOST_CLEAN = 2500, 4000
FEATURES = 6
#: Words a block of the scan.
STEPS = 32
_SALT = splitmix(FEATURES, 31)


def features(w: Words) -> np.ndarray:
    """(words, FEATURES) places in the weight table."""
    h = w.hashes()
    near = {1: np.zeros(len(h), U), -1: np.zeros(len(h), U)}
    if len(h):
        same = w.doc[1:] == w.doc[:-1]
        near[1][1:] = np.where(same, h[:-1], 0)
        near[-1][:-1] = np.where(same, h[1:], 0)
    start = [h, w.span_hash(w.start, np.minimum(w.end, w.start + 4)), w.span_hash(w.start, np.minimum(w.end, w.start + 5)), w.span_hash(np.maximum(w.start, w.end - 3), w.end), near[1], near[-1]]
    return np.stack([((x ^ s) * U(0x9E3779B97F4A7C15) >> U(46)).astype(np.int32) for x, s in zip(start, _SALT)], 1)


def chain_starts(w: Words) -> np.ndarray:
    """True for each word that opens a chain: the first of a line or document."""
    new = np.ones(len(w.start), bool)
    if len(new):
        line = np.cumsum(w.data == 10)[w.start]
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    return new


def _times(a, b):
    """Products of 2 x 2 matrices given as four arrays, scaled so that the largest entry is one."""
    out = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    top = np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
    return [x / top for x in out]


def _scan(m: list[np.ndarray], v0: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors v_t = v_{t-1} m_t for all t (each scaled to sum one), from ``v0``.

    Products run within blocks, all blocks side by side; the blocks' own products are scanned in the same way."""
    n = len(m[0])
    if n <= STEPS:
        x, y = np.empty(n), np.empty(n)
        a, b = v0
        for t in range(n):
            a, b = a * m[0][t] + b * m[2][t], a * m[1][t] + b * m[3][t]
            s = a + b
            a, b = a / s, b / s
            x[t], y[t] = a, b
        return x, y
    blocks = -(-n // STEPS)
    unit = (1.0, 0.0, 0.0, 1.0)
    grid = []
    for x, u in zip(m, unit):
        full = np.full(blocks * STEPS, u)
        full[:n] = x
        grid.append(np.ascontiguousarray(full.reshape(blocks, STEPS).T))
    run = [[g[0] for g in grid]]
    for k in range(1, STEPS):
        run.append(_times(run[-1], [g[k] for g in grid]))
    ends = run[-1]
    a, b = _scan([x[:-1] for x in ends], v0) if blocks > 1 else (np.zeros(0), np.zeros(0))
    a, b = np.concatenate([[v0[0]], a]), np.concatenate([[v0[1]], b])
    out = np.empty((2, STEPS, blocks))
    for k, p in enumerate(run):
        x, y = a * p[0] + b * p[2], a * p[1] + b * p[3]
        s = x + y
        out[0, k], out[1, k] = x / s, y / s
    return out[0].T.ravel()[:n], out[1].T.ravel()[:n]


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and the expected transitions, for emission scores of the toxic tag.

    ``first`` marks the words that open a chain. ``trans[i, j]``: score of tag j
    after tag i; row 2 holds the start scores. A chain's first matrix has equal
    rows, so that it forgets the chain before it.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((3, 2))
    em = np.clip(score, -200, 200)
    top = np.maximum(em, 0)
    off, on = np.exp(-top), np.exp(em - top)  # of the two tags, the larger is one
    e = np.exp(trans - trans.max())
    m = [np.where(first, e[2, 0], e[0, 0]) * off, np.where(first, e[2, 1], e[0, 1]) * on, np.where(first, e[2, 0], e[1, 0]) * off, np.where(first, e[2, 1], e[1, 1]) * on]
    a0, a1 = _scan(m)
    # backward: the same scan of the transposed matrices, from the end
    back = [x[:0:-1] for x in (m[0], m[2], m[1], m[3])]
    b0, b1 = _scan(back) if n > 1 else (np.zeros(0), np.zeros(0))
    b0, b1 = np.concatenate([b0[::-1], [0.5]]), np.concatenate([b1[::-1], [0.5]])
    total = a0 * b0 + a1 * b1
    p = a1 * b1 / total
    moves = np.zeros((3, 2))
    inner = np.flatnonzero(~first)
    if len(inner):
        before = (a0[inner - 1], a1[inner - 1])
        pair = [[before[i] * m[2 * i + j][inner] * (b1 if j else b0)[inner] for j in (0, 1)] for i in (0, 1)]
        whole = pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]
        for i in (0, 1):
            for j in (0, 1):
                moves[i, j] = (pair[i][j] / whole).sum()
    moves[2, 1] = p[first].sum()
    moves[2, 0] = first.sum() - moves[2, 1]
    return p, moves


def gradients(score: np.ndarray, first: np.ndarray, tag: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the tags' log-likelihood by the emission scores and by the transitions."""
    p, moves = forward_backward(score, first, trans)
    seen = np.zeros((3, 2))
    inner = ~first[1:]
    np.add.at(seen, (tag[:-1][inner].astype(int), tag[1:][inner].astype(int)), 1)
    np.add.at(seen[2], tag[first].astype(int), 1)
    return tag - p, seen - moves


class Field:
    """Weights, transitions and the document-level logistic."""

    def __init__(self, weight: np.ndarray, trans: np.ndarray, logit: np.ndarray | None):
        self.weight, self.trans, self.logit = weight, trans, logit

    def marginals(self, w: Words) -> np.ndarray:
        return forward_backward(self.weight[features(w)].sum(1, dtype=np.float64), chain_starts(w), self.trans)[0]

    def document_scores(self, w: Words, p: np.ndarray) -> np.ndarray:
        if self.logit is None:
            return np.zeros(w.n)
        return 1 / (1 + np.exp(-evidence(w, p) @ self.logit))


def evidence(w: Words, p: np.ndarray) -> np.ndarray:
    """(documents, 4): one, the log-odds of the highest marginal, logs of the expected toxic words and of all words."""
    high = np.zeros(w.n)
    np.maximum.at(high, w.doc, p)
    high = np.clip(high, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(w.n), np.log(high / (1 - high)) / 4, np.log1p(np.bincount(w.doc, p, minlength=w.n)), np.log1p(w.count) / 4], 1)


def _labelled(spans: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tag of each training word, from document labels; ``spans``: hashes of the words and of their first bytes."""
    tag = np.zeros(len(doc), bool)
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    for h, least, margin in zip(spans, (3, 8), (3.0, 3.5)):
        _, name = np.unique(h, return_inverse=True)
        once = np.unique(name.astype(np.int64) * len(toxic) + doc)
        k = int(name.max()) + 1 if len(name) else 0
        in_toxic = np.bincount(once // len(toxic), weights=toxic[once % len(toxic)], minlength=k)
        in_clean = np.bincount(once // len(toxic), minlength=k) - in_toxic
        odds = np.log((in_toxic + 0.1) / n1) - np.log((in_clean + 0.1) / n0)
        tag |= ((odds >= margin) & (in_toxic >= least))[name]
    return tag & toxic[doc]


def _parts(texts: pa.Array):
    """The texts' words, some texts at a time, with the number of the first text."""
    first = 0
    for b in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        yield first, Words(b.column(0), LETTER)
        first += b.num_rows


class _Fitting:
    """Stochastic steps over all chains of the training words."""

    def __init__(self, f: np.ndarray, first: np.ndarray, rate: float, seed: int):
        self.f, self.first, self.rate = f, first, rate
        self.weight, self.squares = np.zeros(TABLE), np.full(TABLE, 1e-8)
        self.trans, self.t_squares = np.zeros((3, 2)), np.full((3, 2), 1e-8)
        self.begin = np.append(np.flatnonzero(first), len(first))
        self.rng = np.random.default_rng(seed)

    def epoch(self, tag: np.ndarray, words: int) -> None:
        """One pass, some ``words`` words of whole chains at a step (fewer where that would be under 64 steps)."""
        n, words = len(self.begin) - 1, min(words, max(len(tag) // 64, 500))
        order = self.rng.permutation(n)
        size = np.diff(self.begin)[order]
        cut = np.searchsorted(np.cumsum(size), np.arange(words, size.sum() + words, words), "right")
        for batch in np.split(order, np.unique(cut[(cut > 0) & (cut < n)])):
            size = self.begin[batch + 1] - self.begin[batch]
            at = np.repeat(self.begin[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            places = self.f[at]
            gs, gt = gradients(self.weight[places].sum(1), self.first[at], tag[at], self.trans)
            flat = places.ravel()
            hit = np.unique(flat)
            g = np.bincount(flat, np.repeat(gs / len(batch), FEATURES), minlength=TABLE)[hit] - 2e-6 * self.weight[hit]
            self.squares[hit] += g * g
            self.weight[hit] += self.rate * g / np.sqrt(self.squares[hit])
            gt = gt / len(batch)
            self.t_squares += gt * gt
            self.trans += self.rate * gt / np.sqrt(self.t_squares)

    def marginals(self, per: int = 1 << 17) -> np.ndarray:
        out = np.zeros(len(self.first))
        cut = np.unique(np.append(self.begin[np.searchsorted(self.begin, np.arange(0, len(out), per))], len(out)))
        for a, b in zip(cut[:-1], cut[1:]):
            out[a:b] = forward_backward(self.weight[self.f[a:b]].sum(1), self.first[a:b], self.trans)[0]
        return out


def fit(texts: pa.Array, toxic: np.ndarray, epochs: int = 4, words: int = 20_000, rate: float = 0.3, seed: int = 5) -> Field:
    """Fit the field on two thirds of the documents and the logistic on the rest."""
    toxic = toxic.astype(bool)
    if not toxic.any():
        return Field(np.zeros(TABLE), np.zeros((3, 2)), None)
    third = np.arange(len(toxic)) % 3 == 2 if len(toxic) >= 60 else np.zeros(len(toxic), bool)
    learn = texts.filter(pa.array(~third))
    found = [(w.hashes(), w.span_hash(w.start, np.minimum(w.end, w.start + 5)), (w.doc + n).astype(np.int32), features(w), chain_starts(w)) for n, w in _parts(learn) if len(w.start)]
    if not found:
        return Field(np.zeros(TABLE), np.zeros((3, 2)), None)
    whole, heads, doc, f, first = (np.concatenate(x) for x in zip(*found))
    del found
    tag = _labelled([whole, heads], doc, toxic[~third])
    del whole, heads
    steps = _Fitting(f, first, rate, seed)
    for k in range(epochs):
        if k == epochs // 2:  # what the field itself has found in toxic documents by now
            tag |= (steps.marginals() >= 0.5) & toxic[~third][doc]
        steps.epoch(tag, words)
    field = Field(steps.weight.astype(np.float32), steps.trans, np.zeros(4))
    rest = texts.filter(pa.array(third)) if third.any() and toxic[third].any() else learn
    y = (toxic[third] if rest is not learn else toxic[~third]).astype(float)
    x = np.concatenate([evidence(w, field.marginals(w)) for _, w in _parts(rest)])
    b = np.zeros(4)
    for _ in range(50):  # Newton steps on the ridge-penalised logistic
        q = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (q * (1 - q))[:, None]) + 1e-2 * np.eye(4)
        b = b + np.linalg.solve(h, x.T @ (y - q) - 1e-2 * b)
    field.logit = b
    return field


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: tuple[int, int] = (MOST_TOXIC, MOST_CLEAN)) -> Field:
    """Fit on a bounded sample of ``docs`` (training rows only) that ``labels`` marks."""
    marks = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    table = labelled_texts(docs, marks, "label", {1: most[0], 0: most[1]}, doc_id, text)
    column = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    return fit(column, table["label"].to_numpy() == 1)


def score(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score, n_toxic_words and spans (start and end in code points, marginal) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((field.weight, field.trans, field.logit))  # TABLE numbers
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    schema = rows.drop("text").schema
    schema = schema.add("score", "double").add("n_toxic_words", "integer").add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("p", "double")))

    def run(batches):
        field = Field(*sent.value)
        for b in pieces(batches):
            w = Words(b.column(1), LETTER)
            p = field.marginals(w)
            hot = np.flatnonzero(p >= 0.5)
            chars = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum((w.data & 0xC0) != 0x80, out=chars[1:])
            base = chars[w.offsets[w.doc[hot]]]
            spans: list[list] = [[] for _ in range(w.n)]
            for d, s, e, q in zip(w.doc[hot].tolist(), (chars[w.start[hot]] - base).tolist(), (chars[w.end[hot]] - base).tolist(), p[hot].tolist()):
                spans[d].append({"start": s, "end": e, "p": q})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(field.document_scores(w, p)), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, span)], names=["doc_id", "score", "n_toxic_words", "spans"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from labels outside the held-out fold, then score all documents."""
    field = train(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs, field)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
