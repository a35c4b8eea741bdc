"""Quality by ordinal regression on graded ratings: a cumulative-link model over hashed text features.

P(grade <= k) = sigmoid(threshold_k - z), with one z = weights . x for all grades and thresholds kept in
order (each is the one before plus an exponential). x holds the shares of a text's words that have each
hashed feature: the word (ASCII case folded), its shape (runs of capitals, letters and digits; marks as they
are), the pair of its and the next word's shape, whether it repeats the word before, and whether it stands in
a window of three words or in a line that the text has twice. The expected grade and the probability of a
grade at or above the wanted one follow; selection is by the latter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import U64, Block, blocks_of, mix, repeated, slices
from slotwise.llm.training import Adam, fit_on, labelled_sample, sigmoid

BITS = 18
#: Bounds of the training sample: rows of each grade, and bytes of a text.
PER_CLASS, MAX_BYTES = 2500, 60_000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("9")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word's every feature; the documents ascend within each kind."""
    ws, we = block.words()
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(block.n), block.per_text(ws))
    word = Block(_LOWER[block.buf], block.off).hashes(ws, we)
    shape = _SHAPE[block.buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[ws] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    form = Block(shape[keep], block.off).hashes(at[ws], at[we])
    mates = np.flatnonzero(doc[1:] == doc[:-1])
    again = mates[word[mates] == word[mates + 1]] + 1
    triples = np.flatnonzero(doc[2:] == doc[:-2])
    ls, le = block.lines()
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    full = first < last
    first, last = first[full], last[full]
    with np.errstate(over="ignore"):
        three = mix(word[triples] + mix(word[triples + 1] + mix(word[triples + 2] + mix(doc[triples].astype(U64)))))
        line = mix(block.hashes(ls[full], le[full]) + mix(doc[first].astype(U64)))
        pair = mix(form[mates] + U64(3) * form[mates + 1])
    twice = triples[repeated(three)[1]]
    dup = repeated(line)[0]
    in_dup = np.zeros(len(ws) + 1, np.int64)
    np.add.at(in_dup, first[dup], 1)
    np.add.at(in_dup, last[dup], -1)
    in_dup = np.flatnonzero(np.cumsum(in_dup[:-1]))
    shift = U64(64 - BITS)
    hashed = lambda h, kind: (mix(h + U64(kind)) >> shift).astype(np.int64)
    one = lambda n, kind: np.full(n, hashed(np.zeros(1, U64), kind)[0])
    docs = [doc, doc, doc[mates], doc[again], doc[twice], doc[in_dup]]
    with np.errstate(over="ignore"):
        feats = [hashed(word, 1), hashed(form, 2), hashed(pair, 3), one(len(again), 4), one(len(twice), 5), one(len(in_dup), 6)]
    return np.concatenate(docs), np.concatenate(feats)


class Model:
    """Shared weights and ordered thresholds (one fewer than grades)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, block: Block) -> np.ndarray:
        """P(grade > k) of each text (row) for each threshold k (column)."""
        doc, f = features(block)
        n = np.maximum(block.per_text(block.words()[0]), 1)
        z = np.bincount(doc, self.weights[f], block.n) / n
        return sigmoid(z[:, None] - self.thresholds[None, :])


def ordered(cut: np.ndarray) -> np.ndarray:
    """Thresholds from free parameters: the first, and the logarithms of the steps."""
    return np.cumsum(np.append(cut[:1], np.exp(cut[1:])))


def gradient(w: np.ndarray, doc: np.ndarray, column: np.ndarray, x: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted negative log likelihood of the grades by ``w`` (a weight a column, then the parameters of ``ordered``).

    ``doc``, ``column`` and ``x`` are the cells of the documents' features. P(grade) is the difference of the
    cumulative probabilities on its two sides.
    """
    top = int(grades.max())
    cut, n_docs, rows = w[-top:], len(grades), np.arange(len(grades))
    z = np.bincount(doc, x * w[column], n_docs)
    below = np.concatenate([np.zeros((n_docs, 1)), sigmoid(ordered(cut)[None, :] - z[:, None]), np.ones((n_docs, 1))], axis=1)
    slope = below * (1 - below)
    p = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-9)
    gz = weight * (slope[rows, grades + 1] - slope[rows, grades]) / p
    g_theta = np.zeros((n_docs, top + 2))
    g_theta[rows, grades + 1] -= weight * slope[rows, grades + 1] / p
    g_theta[rows, grades] += weight * slope[rows, grades] / p
    tail = np.cumsum(g_theta[:, 1 : top + 1].sum(0)[::-1])[::-1]  # every later threshold moves with an earlier one
    return np.append(np.bincount(column, gz[doc] * x, len(w) - top), tail * np.append(1.0, np.exp(cut[1:])))


def fit(texts: list[str], grades: np.ndarray, *, epochs: int = 80, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Weights and thresholds of least negative log likelihood over grades 0, 1, ... (the highest is that of the sample).

    Grades weigh alike, whatever their numbers of rows. Without rows, or with one grade only, the weights are 0.
    """
    top = int(grades.max(initial=1))
    n_features = 1 << BITS
    if not len(grades) or grades.min() == grades.max():
        return Model(np.zeros(n_features), np.arange(top, dtype=float))
    n_docs, parts = len(texts), []
    for at, block in blocks_of(texts):
        doc, f = features(block)
        cells, value = np.unique(doc * n_features + f, return_counts=True)
        doc = cells // n_features
        n_words = np.maximum(block.per_text(block.words()[0]), 1)
        parts.append(((doc + at).astype(np.int32), (cells % n_features).astype(np.int32), (value / n_words[doc]).astype(np.float32)))
    doc, f, x = (np.concatenate(c) for c in zip(*parts, strict=True))
    known, column = np.unique(f, return_inverse=True)
    weight = (len(grades) / np.maximum(np.bincount(grades, minlength=top + 1), 1))[grades]
    weight /= weight.sum()
    opt = Adam(len(known) + top, rate)
    for _ in range(epochs):
        opt.step(gradient(opt.w, doc, column, x, grades, weight) + decay * np.append(opt.w[: len(known)], np.zeros(top)))
    weights = np.zeros(n_features)
    weights[known] = opt.w[: len(known)]
    return Model(weights, ordered(opt.w[len(known) :]))


def train(docs: DataFrame, labels: DataFrame, grade: Column, *, id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of rated documents; ``grade`` is an expression over ``labels``."""
    return fit_on(labelled_sample(docs, labels, grade, per_class=per_class, max_bytes=MAX_BYTES, id_col=id_col), fit)


def grade(docs: DataFrame, model: Model, *, wanted: int = 1, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of a grade of ``wanted`` or more) and selected (that is at least ``threshold``).

    All columns of ``docs`` stay (those three names must be free). Null and empty texts have no features: their
    grade follows from the thresholds alone. Repeated rows each give a row, an empty table none. One pass,
    no shuffle; the model is of fixed size.
    """
    if not 1 <= wanted <= len(model.thresholds):
        raise ValueError("the wanted grade must be from 1 to the highest")
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2 ** BITS floats
    names = [*docs.columns, "expected_grade", "tail_probability", "selected"]
    if len(set(map(str.lower, names))) < len(names):
        raise ValueError("the input has repeated column names, or one of the result's")
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            batch = batch.rename_columns([str(k) for k in range(batch.num_columns)])
            for rows, block in slices(batch, str(text_at)):
                above = m.above(block)
                p = above[:, wanted - 1]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(above.sum(1)), pa.array(p), pa.array(p >= threshold)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", expected_grade double, tail_probability double, selected boolean"
    return docs.mapInArrow(run, schema)
