"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's score is a logistic function of hashed features of its words (the word, case folded, and its
first 4, 5 and 6 bytes). A document is toxic if any of its sentences is: noisy-or, 1 - prod(1 - p), joins the
sentence scores, and the weights are fitted on document labels through it. Fitted weights then locate the
offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import _BYTE, U64, Block, blocks_of, mix, places, slices
from slotwise.llm.training import Adam, fit_on, labelled_sample, sigmoid, softplus

BITS = 18
#: Bounds of the training sample: rows of each class, and bytes of a text.
PER_CLASS, MAX_BYTES = 3000, 100_000
PREFIXES = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]


def sentences(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends) and the sentence bounds: for each sentence its first byte and the number of its first word.

    Sentences end after ``. ! ?`` (with the marks that follow), at a line feed and at a text's end; those without a word do not count.
    """
    buf = block.buf
    starts, ends = block.spans(_LETTER[buf])
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = (buf == 46) | (buf == 33) | (buf == 63) | (buf == 10)
    seen = np.concatenate([[0], np.cumsum(stop)])
    new = np.ones(len(starts), bool)
    new[1:] = seen[starts[1:]] > seen[ends[:-1]]
    new[np.searchsorted(starts, block.off[:-1])[block.per_text(starts) > 0]] = True
    first = np.flatnonzero(new)
    return starts, ends, starts[first], first


def features(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word its 1 + len(PREFIXES) feature numbers; a word shorter than a prefix repeats none (-1)."""
    lens = ends - starts
    total, first = int(lens.sum()), np.cumsum(lens) - lens
    place = np.arange(total) - np.repeat(first, lens)
    out = np.full((len(starts), 1 + len(PREFIXES)), -1, np.int64)
    shift = U64(64 - BITS)
    with np.errstate(over="ignore"):
        v = _FOLD[block.buf[place + np.repeat(starts, lens)]] * places(int(lens.max(initial=1)))[place]
        out[:, 0] = (mix(np.add.reduceat(v, first)) >> shift).astype(np.int64)
        c = np.zeros(total + 1, U64)
        np.cumsum(v, out=c[1:])
        for k, n in enumerate(PREFIXES, 1):
            at = np.flatnonzero(lens >= n)
            out[at, k] = (mix(c[first[at] + n] - c[first[at]] + U64(n)) >> shift).astype(np.int64)
    return out


class Model:
    """Weights of the hashed features (the last, of the index -1, is always 0) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document scores, first byte, end byte and score of each sentence)."""
        starts, ends, first_byte, first = sentences(block)
        if not len(starts):
            return np.zeros(block.n), first_byte, first_byte, np.zeros(0)
        z = self.intercept + np.add.reduceat(self.weights[features(block, starts, ends)].sum(1), first)
        c = np.concatenate([[0], np.cumsum(softplus(z))])
        at = np.searchsorted(first_byte, block.off)
        return -np.expm1(-(c[at[1:]] - c[at[:-1]])), first_byte, ends[np.append(first[1:], len(starts)) - 1], sigmoid(z)


def _parts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Over runs of texts: the first text's number, the words' features, each word's sentence and each sentence's text (from 0 in the run)."""
    for at, block in blocks_of(texts):
        starts, ends, first_byte, first = sentences(block)
        of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
        yield at, features(block, starts, ends), of_word, np.searchsorted(block.off, first_byte, "right") - 1


def gradient(w: np.ndarray, sentence: np.ndarray, column: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of the mean negative log likelihood of the documents' labels by ``w`` (a weight a column, and the intercept).

    ``sentence`` and ``column`` pair each feature with its sentence, ``doc`` each sentence with its document. A
    document's probability of label 0 is exp(-s), s the sum of softplus(z) over its sentences.
    """
    z = w[-1] + np.bincount(sentence, w[column], len(doc))
    s = np.bincount(doc, softplus(z), len(labels))
    pull = np.where(labels == 1, -1 / np.expm1(np.clip(s, 1e-9, 500)), 1.0)
    gz = pull[doc] * sigmoid(z)
    return np.append(np.bincount(column, gz[sentence], len(w) - 1), gz.sum()) / len(labels)


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 80, rate: float = 0.1, decay: float = 3e-5, min_docs: int | None = None) -> Model:
    """Weights that make noisy-or of the sentence scores agree with the documents' labels (0 or 1).

    Features of fewer than ``min_docs`` of the sample's documents (by default a 250th of them, from 3 to 20)
    keep weight 0: they tell single documents apart, no more.
    """
    n, n_docs = 1 << BITS, len(texts)
    if not n_docs or labels.min() == labels.max():
        return Model(np.zeros(n + 1, np.float32), -20.0 if not n_docs or labels.max() == 0 else 20.0)
    min_docs = min_docs or max(3, min(20, n_docs // 250))
    frequency = np.zeros(n + 1, np.int64)
    for _, f, of_word, of_sentence in _parts(texts):
        doc = of_sentence[of_word]
        frequency += np.bincount(np.unique(np.where(f < 0, n, f) * n_docs + doc[:, None]) // n_docs, minlength=n + 1)
    common = frequency >= min_docs
    common[n] = False
    number = np.cumsum(common) - 1
    sentences_of, columns, docs, seen = [], [], [], 0
    for at, f, of_word, of_sentence in _parts(texts):
        rows, _ = np.nonzero(used := common[f] & (f >= 0))
        sentences_of.append((of_word[rows] + seen).astype(np.int32))
        columns.append(number[f[used]].astype(np.int32))
        docs.append(of_sentence + at)
        seen += len(of_sentence)
    sentence, column, doc = np.concatenate(sentences_of), np.concatenate(columns), np.concatenate(docs)
    known = np.flatnonzero(common)
    opt = Adam(len(known) + 1, rate)
    opt.w[-1] = -8.0
    for _ in range(epochs):
        opt.step(gradient(opt.w, sentence, column, doc, labels) + decay * np.append(opt.w[:-1], 0))
    weights = np.zeros(n + 1, np.float32)
    weights[known] = opt.w[:-1]
    return Model(weights, float(opt.w[-1]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, keep: Column | None = None, id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled documents (``keep``: a condition on ``id``)."""
    return fit_on(labelled_sample(docs, labels, F.col(label_col), per_class=per_class, max_bytes=MAX_BYTES, keep=keep, id_col=id_col), fit)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, *, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, and (with_spans) the offending sentences as first character, end and score.

    Those are the sentences whose own score reaches the threshold, and in a predicted document without one (its
    sentences reach it together) the sentence of the highest score, the first of equals.

    Null, empty and wordless texts score 0. Repeated rows each give a row, an empty table none; no column
    but the id and the text is read. One pass, no shuffle; the model is of fixed size.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast((np.append(model.weights[:-1], np.float32(0)), model.intercept))  # 2 ** BITS floats
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for rows, block in slices(batch, "text"):
                s, a, b, p = m.scores(block)
                s = np.clip(s, 0.0, 1.0)
                out = [rows.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                if with_spans:
                    chars = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
                    found: list[list[dict]] = [[] for _ in range(block.n)]
                    of = np.searchsorted(block.off, a, "right") - 1
                    best = np.lexsort((np.arange(len(p)), -p, of))
                    best = best[np.append(True, of[best][1:] != of[best][:-1])[: len(best)]]  # each text's highest
                    located = p >= threshold
                    located[best] |= s[of[best]] >= threshold
                    for k in np.flatnonzero(located):
                        d = int(of[k])
                        base = chars[block.off[d]]
                        found[d].append({"start": int(chars[a[k]] - base), "end": int(chars[b[k]] - base), "score": float(p[k])})
                    out.append(pa.array(found, span))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted"] + ["sentences"] * with_spans)

    schema = f"doc_id {id_type}, score double, predicted int" + ", sentences array<struct<start: bigint, end: bigint, score: double>>" * with_spans
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
