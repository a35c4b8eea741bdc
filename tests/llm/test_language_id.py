import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slotwise.llm import language_id as lid
from slotwise.llm.queries import QUERIES
from slotwise.llm.textblock import mix, of_array

from ..conftest import SF

SYLLABLES = {"aa": "ka lo mi tu ren".split(), "bb": "sch ein ung ßer öt".split(), "cc": "ção ñez lhe qui eau".split()}


def sample(n, seed, words=(1, 60)):
    r, out = random.Random(seed), []
    for k in range(n):
        lang = sorted(SYLLABLES)[k % 3]
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(*words)))
        out.append((text.capitalize() + ".", k % 3))
    return out


def plain_rows(text):
    """The table rows of a text's subwords, string by string."""
    out, word = [], bytearray()
    b = bytearray(text.encode())
    for k, c in enumerate(b):
        if 65 <= c <= 90 or (k and b[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            b[k] = c + 32
    for c in [*b, 32]:
        if c > 127 or 97 <= c <= 122:
            word.append(c)
            continue
        if word:
            w = bytes([0, *word, 0])
            for n in range(1, lid.LONGEST + 1):
                out += [(n, w[i : i + n]) for i in range(len(w) - n + 1) if any(w[i : i + n]) and (n > 1 or w[i])]
            word = bytearray()
    codes = [int.from_bytes(bytes([n]) + g, "big") for n, g in out]
    return [int(mix(np.array([c & (1 << 64) - 1], np.uint64))[0] >> np.uint64(64 - lid.BITS)) for c in codes]


def test_subwords_are_those_of_a_plain_version():
    texts = ["", "a", "No, É n'est là 12 ×ÀŸ", "ab cd", "...", "x" * 9]
    table = np.random.default_rng(1).normal(size=(1 << lid.BITS, 3))
    old = lid.STEP
    try:
        for step in (old, 4):
            lid.STEP = step
            got, count = lid.average(of_array(pa.array(texts)), table)
            for k, t in enumerate(texts):
                rows = plain_rows(t)
                assert count[k] == len(rows)
                assert np.allclose(got[k], table[rows].mean(axis=0) if rows else 0)
    finally:
        lid.STEP = old


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    table, weights = rng.normal(size=(9, 4)), rng.normal(size=(4, 3))
    size, rows, share = np.array([2, 3, 1]), np.array([0, 4, 4, 5, 8, 2]), rng.random(6)
    y, weigh = np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0])

    def loss(t, w):
        p = lid.softmax(np.add.reduceat(t[rows] * share[:, None], np.cumsum(size) - size, axis=0) @ w)
        return -(weigh * np.log(p[np.arange(3), y])).sum()

    g_cells, g_weights = lid.gradients(table, weights, size, rows, share, y, weigh)
    g_table = np.zeros_like(table)
    np.add.at(g_table, rows, g_cells)
    for a, g, f in ((table, g_table, lambda x: loss(x, weights)), (weights, g_weights, lambda x: loss(table, x))):
        for i in np.ndindex(a.shape):
            d = np.zeros_like(a)
            d[i] = 1e-6
            assert abs((f(a + d) - f(a - d)) / 2e-6 - g[i]) < 1e-6


def test_held_out_texts_and_calibration():
    train, test = sample(300, 1), sample(300, 2)
    m = lid.fit([t for t, _ in train], np.array([y for _, y in train]), sorted(SYLLABLES))
    best, p = m.predict(of_array(pa.array([t for t, _ in test])))
    right = best == np.array([y for _, y in test])
    assert right.mean() >= 0.97
    assert abs(p.mean() - right.mean()) < 0.05
    assert (p[len("z")] > 0.5) and np.all((p > 0) & (p <= 1))


def test_calibration_and_rejection():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    z = np.zeros((4000, 2))
    z[np.arange(4000), y] = rng.normal(1, 1, 4000)  # the log odds are twice that
    a, b = lid.calibrate(z, np.full(4000, 50), y)
    assert abs(np.exp(a + b * np.log1p(50)) - 2) < 0.2
    score, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, False])
    assert lid.rejection(score, right, 0.0) == 0.9
    assert lid.rejection(score, right, 0.25) == 0.7
    assert lid.rejection(score, right, 0.5) == 0.0
    assert lid.rejection(score[:1], ~right[:1], 0.1) > 1
    assert lid.rejection(score[:0], right[:0], 0.1) == 0


def test_odd_texts(spark, odd_docs, no_docs):
    m = lid.train(spark.createDataFrame([(k, t, sorted(SYLLABLES)[y], None) for k, (t, y) in enumerate(sample(90, 4))], "doc_id long, text string, lang string, source string"))
    assert m.langs == sorted(SYLLABLES)
    odd = odd_docs.drop("score")
    rows = lid.detect(odd, m).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= {*odd.columns, "lang_pred", "score", "accepted"}
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in m.langs) if letter else (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        assert 0 <= r.score <= 1 and r.accepted == (letter and r.score >= m.threshold)
    assert lid.detect(no_docs, m).count() == 0
    nothing = lid.train(no_docs)
    assert {(r.lang_pred, r.score) for r in lid.detect(odd, nothing).collect()} == {("und", 0.0)}


def test_long_texts_are_read_to_the_end():
    train = sample(120, 5)
    m = lid.fit([t for t, _ in train], np.array([y for _, y in train]), sorted(SYLLABLES))
    text = "ka " * 5 + "scheinung " * 60_000
    assert m.predict(of_array(pa.array([text])))[0][0] == 1


def test_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op11_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    want = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: r.h for r in want}
