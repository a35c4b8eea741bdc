"""Language of a text: averaged hashed subword embeddings, a linear softmax, calibrated probabilities and rejection.

A text's subwords are the strings of 1 to 5 bytes within its words, each word with a mark before and after it (words are
runs of ASCII letters and of bytes from 128 on; capitals of ASCII and Latin-1 are folded). Each is hashed to a row of an
embedding table; the rows' average goes through a linear layer to one logit a language. Both are trained together by
stochastic gradient descent, on pieces of some hundred bytes of a bounded sample, so that short texts are met too.

A fifth of the sample's documents is left out of that. On them, whole and in pieces, the logits' scale is fitted as
exp(a + b log(number of subwords)), since the average of a long text is surer than that of a short one; then the least
score is found from which on at most ``max_error`` of the answers are wrong. Answers below it are not ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import U64, Block, blocks_of, mix, slices
from slotwise.llm.training import Adam, fit_on

#: Rows of the embedding table (as a power of 2), its width, and the longest subword in bytes.
BITS, DIM, LONGEST = 18, 16, 5
#: Bounds of the training sample: languages, rows of each (about), bytes of a text and of all texts.
MAX_LANGS, PER_LANG, MAX_BYTES, TOTAL_BYTES = 200, 400, 20_000, 8 << 20
#: Bytes of a training piece, and of a text that are looked at in one step.
PIECE, STEP = 400, 1 << 17
#: Pieces of a step of descent.
BATCH = 32
NONE = "und"

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_IN_WORD, np.arange(256), 0).astype(np.uint8)
_FOLD[65:91] += 32


def folded(block: Block) -> Block:
    """The texts with capitals folded, all else that is in no word as 0, and a 0 before and after each text."""
    n, size = block.n, np.diff(block.off)
    out = np.zeros(len(block.buf) + 2 * n, np.uint8)
    at = np.arange(len(block.buf)) + np.repeat(2 * np.arange(n) + 1, size)
    out[at] = _FOLD[block.buf]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[upper] += 0x20
    return Block(out, block.off + 2 * np.arange(n + 1))


def subwords(buf: np.ndarray, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(places from a to b where a subword of n bytes starts, the table rows of those) of a folded buffer."""
    b = min(b, len(buf) - n + 1)
    if b <= a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = buf[a : b + n - 1] > 0
    ok = np.ones(b - a, bool) if n > 2 else inside[: b - a] | inside[n - 1 : b - a + n - 1]
    for k in range(1, n - 1):
        ok &= inside[k : b - a + k]
    at = np.flatnonzero(ok) + a
    code = np.full(len(at), n, U64)
    for k in range(n):
        code = (code << U64(8)) | buf[at + k].astype(U64)
    return at, (mix(code) >> U64(64 - BITS)).astype(np.int64)


def average(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(average of the table's rows over each text's subwords, number of those); 0 for texts without any."""
    f = folded(block)
    sums, count = np.zeros((block.n, table.shape[1])), np.zeros(block.n, np.int64)
    for a in range(0, len(f.buf), STEP):
        for n in range(1, LONGEST + 1):
            at, rows = subwords(f.buf, n, a, a + STEP)
            cut = np.searchsorted(at, f.off)
            size = np.diff(cut)
            has = np.flatnonzero(size)
            if len(has):
                sums[has] += np.add.reduceat(table[rows], cut[has], axis=0, dtype=np.float64)
                count += size
    return sums / np.maximum(count, 1)[:, None], count


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf)) if z.shape[1] else z
    return p / p.sum(axis=1, keepdims=True)


class Model:
    """Languages, embeddings folded into logits a table row (or kept apart where there are more languages than dimensions), scale and threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, weights: np.ndarray, scale: tuple[float, float] = (0.0, 0.0), threshold: float = 0.0):
        fold = weights.shape[1] <= table.shape[1]
        self.langs, self.table, self.weights = langs, (table @ weights if fold else table).astype(np.float32), None if fold else weights
        self.scale, self.threshold = scale, threshold

    def logits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        z, count = average(block, self.table)
        return (z if self.weights is None else z @ self.weights), count

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(number of the likeliest language, its calibrated probability) of each text; of equally likely ones the first by name."""
        z, count = self.logits(block)
        p = softmax(z * scales(self.scale, count)[:, None])
        return p.argmax(axis=1), p.max(axis=1)


def scales(scale: tuple[float, float] | np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(scale[0] + scale[1] * np.log1p(count), 20.0))


def pieces(texts: list[str], y: np.ndarray, size: int = PIECE) -> tuple[list[str], np.ndarray]:
    """The texts cut at spaces into pieces of about ``size`` characters, each with its text's label."""
    out, label = [], []
    for t, k in zip(texts, y.tolist(), strict=True):
        a = 0
        while a < len(t):
            b = t.find(" ", a + size)
            b = len(t) if b < 0 else b
            out.append(t[a:b])
            label.append(k)
            a = b
    return out, np.array(label, np.int64)


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts' cells, table row, share of the text's subwords) for every distinct row of each text."""
    rows, share, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
    for _, block in blocks_of(texts, STEP):
        f = folded(block)
        found = [subwords(f.buf, n, 0, len(f.buf)) for n in range(1, LONGEST + 1)]
        doc = np.concatenate([np.searchsorted(f.off, at, "right") - 1 for at, _ in found])
        key, count = np.unique((doc << BITS) | np.concatenate([r for _, r in found]), return_counts=True)
        total = np.maximum(np.bincount(doc, minlength=block.n), 1)
        rows.append((key & ((1 << BITS) - 1)).astype(np.int32))
        share.append((count / total[key >> BITS]).astype(np.float32))
        size.append(np.bincount(key >> BITS, minlength=block.n))
    return np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))]).astype(np.int64), np.concatenate(rows), np.concatenate(share)


def gradients(table: np.ndarray, weights: np.ndarray, size: np.ndarray, rows: np.ndarray, share: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted sum of a batch's negative log likelihoods: for each cell's table row, and for the weights. ``size``: each text's (positive) number of cells."""
    hidden = np.add.reduceat(table[rows] * share[:, None], np.cumsum(size) - size, axis=0)
    error = softmax(hidden @ weights)
    error[np.arange(len(y)), y] -= 1
    error *= weigh[:, None]
    return np.repeat(error @ weights.T, size, axis=0) * share[:, None], hidden.T @ error


def descend(texts: list[str], y: np.ndarray, n_langs: int, *, epochs: int, rate: float, batch: int = BATCH, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and weights by stochastic gradient descent; the rate falls to nothing, languages weigh alike. Rows that no text has are 0."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, n_langs), np.float32)
    off, rows, share = cells(texts)
    met = np.zeros(1 << BITS, bool)
    met[rows] = True
    table[~met] = 0
    size = np.diff(off)
    full = np.flatnonzero(size)
    each = np.bincount(y[full], minlength=n_langs)
    weigh = (len(full) / np.maximum(each, 1) / max((each > 0).sum(), 1))[y].astype(np.float32)
    steps, step = epochs * -(-len(full) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(full)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            n = size[some]
            at = np.arange(n.sum()) + np.repeat(off[some] - np.cumsum(n) + n, n)
            g_rows, g_weights = gradients(table, weights, n, rows[at], share[at], y[some], weigh[some])
            now = rate * (1 - step / steps)
            np.subtract.at(table, rows[at], now * g_rows)
            weights -= now / len(some) * g_weights
            step += 1
    return table, weights


def calibrate(z: np.ndarray, count: np.ndarray, y: np.ndarray, *, steps: int = 300) -> tuple[float, float]:
    """The two parameters of ``scales`` of least negative log likelihood."""
    if not len(y):
        return 0.0, 0.0
    opt, depth = Adam(2, 0.05), np.log1p(count)
    for _ in range(steps):
        s = scales(opt.w, count)
        p = softmax(z * s[:, None])
        p[np.arange(len(y)), y] -= 1
        slope = (p * z).sum(axis=1) * s
        opt.step(np.array([slope.mean(), (slope * depth).mean()]) + 1e-3 * opt.w)
    return float(opt.w[0]), float(opt.w[1])


def rejection(score: np.ndarray, right: np.ndarray, max_error: float) -> float:
    """The least of the scores from which on at most ``max_error`` of the answers are wrong (above 1: there is none); 0 where all together are within it."""
    order = np.argsort(-score, kind="stable")
    s, wrong = score[order], np.cumsum(~right[order])
    last = np.append(s[1:] < s[:-1], True)[: len(s)]  # equal scores are accepted together
    ok = np.flatnonzero(last & (wrong <= max_error * np.arange(1, len(s) + 1)))
    if not len(s) or (len(ok) and ok[-1] == len(s) - 1):
        return 0.0
    return float(s[ok[-1]]) if len(ok) else 2.0


def fit(texts: list[str], y: np.ndarray, langs: list[str], *, epochs: int = 4, least_steps: int = 1200, rate: float = 1.0, max_error: float = 0.01) -> Model:
    """A model of the texts' languages (numbers into ``langs``); without texts all languages are equally likely.

    A small sample is gone through more often (at most 40 times) than ``epochs``, to make ``least_steps`` steps.
    """
    if not texts:
        return Model(langs, np.zeros((1 << BITS, DIM)), np.zeros((DIM, max(len(langs), 1))))
    aside = np.zeros(len(texts), bool)
    aside[4::5] = True
    pick = lambda m: ([t for t, x in zip(texts, m.tolist(), strict=True) if x], y[m])
    cut, label = pieces(*pick(~aside))
    table, weights = descend(cut, label, len(langs), epochs=max(epochs, min(40, least_steps * BATCH // max(len(cut), 1))), rate=rate)
    model = Model(langs, table, weights)
    held, label = pick(aside)
    some, some_label = pieces(held, label, 60)
    held, label = held + some[:: max(1, len(some) // 4000)], np.concatenate([label, some_label[:: max(1, len(some) // 4000)]])
    if not held:
        return model
    parts = [model.logits(b) for _, b in blocks_of(held)]
    z, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    model.scale = calibrate(z, count, label)
    p = softmax(z * scales(model.scale, count)[:, None])
    model.threshold = rejection(p.max(axis=1), p.argmax(axis=1) == label, max_error)
    return model


def train(docs: DataFrame, *, keep: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG, max_error: float = 0.01) -> Model:
    """A model from a bounded sample of the rows whose ``keep`` is true and whose id, text and language are not null.

    Rows of a language are taken by a hash of their id, with the chance that gives about ``per_lang`` of them; texts of over
    ``MAX_BYTES`` are passed over, and so are those, last by another hash, beyond ``TOTAL_BYTES`` in all. More than
    ``MAX_LANGS`` languages are an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} languages")
    counts = sorted((r["lang"], r["count"]) for r in counts)
    chances = [(lang, k, int(min(1.0, 1.2 * per_lang / n) * (1 << 30))) for k, (lang, n) in enumerate(counts)]
    chance = docs.sparkSession.createDataFrame(chances, "_lang string, y int, chance long")
    text = F.col(text_col).cast("string")
    some = rows.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("_lang")).where((F.octet_length("text") > 0) & (F.octet_length("text") <= MAX_BYTES))
    met = some.join(F.broadcast(chance), "_lang").where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 30)) < F.col("chance"))  # a row a language
    langs = [lang for lang, _ in counts]
    return fit_on(met.select("id", "text", "y"), lambda t, y: fit(t, y, langs, max_error=max_error), TOTAL_BYTES)


def detect(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the probability that it is right, calibrated) and accepted (the score reaches the model's threshold).

    lang_pred is ``und``, with score 0 and not accepted, where the text is null or empty or has no letter, or where no language was
    learnt. All columns of ``docs`` stay (those three names must be free). Whole texts of any length are read, in steps of fixed
    size. Repeated rows each give a row, an empty table none. One pass, no shuffle; the model is of fixed size.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    names = [*docs.columns, "lang_pred", "score", "accepted", "_text"]
    if len(set(map(str.lower, names))) < len(names):
        raise ValueError("the input has repeated column names, or one of the result's")
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS rows of at most DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names_ = np.array([*m.langs, NONE], object)
        for batch in batches:
            batch = batch.rename_columns([str(k) for k in range(batch.num_columns)])
            last = batch.num_columns - 1
            for rows, block in slices(batch, str(last - 1)):
                best, p = m.predict(block) if m.langs else (np.zeros(block.n, np.int64), np.zeros(block.n))
                none = ~np.asarray(rows.column(last)) | (len(m.langs) == 0)
                best[none], p[none] = len(m.langs), 0.0
                yield pa.RecordBatch.from_arrays([*rows.columns[: last - 1], pa.array(names_[best], pa.string()), pa.array(p), pa.array(~none & (p >= m.threshold))], names[:-1])

    text = F.col(f"`{text_col}`").cast("string")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, accepted boolean"
    return docs.select(*[f"`{c}`" for c in docs.columns], text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter")).mapInArrow(run, schema)
