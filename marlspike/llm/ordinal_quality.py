"""Quality by ordinal cumulative-link regression on graded ratings (operator 4).

Documents are rated in ordered grades 0..K-1. One weight vector over hashed
features of the text gives a latent quality s; ordered thresholds t1 < t2 < ...
turn it into P(grade >= j) = logistic(s - tj), shared weights making the tails
consistent. The expected grade is the sum of the tails.

Features: the mean weight of the text's words, of their shapes (letters, capital
letters, digits and other characters, runs folded), plus one weight for the
step that each of a few ratios falls in (words, symbols, capitals, repeated
words, repeated lines).

Fitted on a bounded sample: ``MOST_DOCS`` rated documents of each grade, with
the bounds on their texts' bytes in ``samples.py``.

Defined cases: null and empty texts have only the step features; a text of any
length is scored whole; without rated training rows the expected grade is null
and kept is true; equal probabilities are no ties to break, each row has its
own; a document rated twice counts twice; repeated rows are scored alike; an
empty table gives an empty result. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .samples import labelled_texts
from .textnum import U, Words, mix, pieces

TABLE = 1 << 18
MOST_DOCS = 3000
STEPS = 16
_SHAPE = np.full(256, 3, np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2


def _shapes(w: Words) -> np.ndarray:
    """A hash of each word's shape: which kinds of characters it starts with, holds and ends with."""
    kind = _SHAPE[w.data]
    out = kind[w.start].astype(U) * U(64) + kind[w.end - 1].astype(U) * U(16)
    for k in range(4):
        run = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=run[1:])
        out |= (run[w.end] > run[w.start]).astype(U) << U(k + 8)
    return mix(out + U(1))


def _steps(w: Words, h: np.ndarray) -> np.ndarray:
    """(documents, 5) ratios in 0..STEPS-1."""
    kind = _SHAPE[w.data]
    size = np.maximum(np.diff(w.offsets), 1)
    words = np.maximum(w.count, 1)
    symbols = w.per_doc((kind == 3) & w.inside) / size
    capitals = w.per_doc(kind == 1) / size
    g, at = w.grams(h, 3)
    own = np.sort(mix(g ^ mix(w.doc[at].astype(U))))
    twice = own[1:][own[1:] == own[:-1]]
    repeated = np.zeros(w.n)
    if len(twice):
        np.add.at(repeated, w.doc[at[np.isin(mix(g ^ mix(w.doc[at].astype(U))), twice)]], 1)
    lines = w.per_doc(w.data == 10)
    ratios = [np.log2(words) / 16, symbols * 2, capitals * 2, repeated / words, np.minimum(lines / words * 4, 1)]
    return np.minimum(np.stack(ratios, 1) * STEPS, STEPS - 1).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the table, value) of the non-zero features."""
    w = Words(texts)
    h = w.hashes()
    place = np.concatenate([(mix(h ^ U(3)) % U(TABLE)), (_shapes(w) % U(TABLE))]).astype(np.int64)
    doc = np.concatenate([w.doc, w.doc])
    value = (1.0 / np.maximum(w.count, 1))[doc]
    steps = _steps(w, h)
    step_place = mix((steps + np.arange(steps.shape[1]) * STEPS + 1000).astype(U)) % U(TABLE)
    doc = np.concatenate([doc, np.repeat(np.arange(w.n), steps.shape[1])])
    return doc, np.concatenate([place, step_place.astype(np.int64).ravel()]), np.concatenate([value, np.full(steps.size, 0.5)])


class Ordinal:
    def __init__(self, weight: np.ndarray, cuts: np.ndarray):
        self.weight, self.cuts = weight, cuts

    def tails(self, texts: pa.Array) -> np.ndarray:
        """(documents, K - 1): P(grade >= 1), P(grade >= 2), ..."""
        doc, place, value = features(texts)
        s = np.bincount(doc, self.weight[place] * value, minlength=len(texts))
        return 1 / (1 + np.exp(-(s[:, None] - self.cuts)))

    @classmethod
    def fit(cls, texts: pa.Array, grade: np.ndarray, grades: int, epochs: int = 12, per: int = 256, rate: float = 0.5, seed: int = 3) -> Ordinal:
        """Adaptive gradient steps on the likelihood; thresholds stay ordered as a first one and positive gaps."""
        places, values, sizes = [], [], []
        for b in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):  # some texts at a time, kept compact
            doc, place, value = features(b.column(0))
            order = np.argsort(doc, kind="stable")
            places.append(place[order].astype(np.int32))
            values.append(value[order].astype(np.float32))
            sizes.append(np.bincount(doc, minlength=b.num_rows))
        place, value = np.concatenate(places), np.concatenate(values)
        del places, values
        limits = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        weight, squares = np.zeros(TABLE), np.full(TABLE, 1e-8)
        share = np.array([(grade >= j).mean() for j in range(1, grades)]).clip(0.02, 0.98)
        cuts = np.sort(np.log((1 - share) / share))
        raw = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        raw_squares = np.full(len(raw), 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // per)):
                size = limits[batch + 1] - limits[batch]
                at = np.repeat(limits[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                own = np.repeat(np.arange(len(batch)), size)
                cuts = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
                s = np.bincount(own, weight[place[at]] * value[at], minlength=len(batch))
                y = grade[batch]
                high = np.concatenate([np.ones((len(batch), 1)), 1 / (1 + np.exp(-(s[:, None] - cuts))), np.zeros((len(batch), 1))], 1)
                r = np.arange(len(batch))
                a, b = high[r, y], high[r, y + 1]
                p = np.maximum(a - b, 1e-9)
                da, db = a * (1 - a) / p, b * (1 - b) / p
                gs = (da - db) / len(batch)
                g = np.bincount(place[at], gs[own] * value[at], minlength=TABLE) - 1e-6 * weight
                squares += g * g
                weight += rate * g / np.sqrt(squares)
                gc = np.zeros(grades + 1)
                np.add.at(gc, y, -da / len(batch))
                np.add.at(gc, y + 1, db / len(batch))
                gc = gc[1:grades]
                gr = np.array([gc.sum(), *[np.exp(raw[i]) * gc[i:].sum() for i in range(1, len(raw))]])
                raw_squares += gr * gr
                raw += 0.1 * gr / np.sqrt(raw_squares)
        return cls(weight.astype(np.float32), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def train(docs: DataFrame, ratings: DataFrame, grades: int, text: str = "text", doc_id: str = "doc_id", most: int = MOST_DOCS) -> Ordinal | None:
    """Fit on a bounded sample of ``docs`` (training rows only) with ``ratings(doc_id, grade)``."""
    rated = ratings.where("grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    table = labelled_texts(docs, rated, "grade", most, doc_id, text)
    if not table.num_rows:
        return None
    return Ordinal.fit(table["text"].combine_chunks(), table["grade"].to_numpy().astype(np.int64), grades)


def score(docs: DataFrame, model: Ordinal | None, grades: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, expected_grade and p_ge_1..p_ge_{K-1} of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(None if model is None else (model.weight, model.cuts))  # TABLE numbers
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [f"p_ge_{j}" for j in range(1, grades)]
    schema = rows.drop("text").schema.add("expected_grade", "double")
    for n in names:
        schema = schema.add(n, "double")

    def run(batches):
        for b in pieces(batches):
            if sent.value is None:
                cols = [pa.nulls(b.num_rows, pa.float64())] * grades
            else:
                tails = Ordinal(*sent.value).tails(b.column(1))
                cols = [pa.array(tails.sum(1)), *(pa.array(tails[:, j]) for j in range(grades - 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "expected_grade", *names])

    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Grades from the labels: 0 low quality, 1 good but toxic, 2 good. Learns outside the held-out fold; ``kept``: P(grade >= 1) reaches ``least``."""
    graded = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = train(docs.where(~held_out()), graded.where(~held_out()), 3)
    out = score(docs, model, 3).withColumn("held_out", held_out())
    return out.withColumn("kept", F.coalesce(F.col("p_ge_1") >= least, F.lit(True)))
