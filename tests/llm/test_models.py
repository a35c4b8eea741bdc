import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import quality_classifier, toxicity
from slotwise.llm.textblock import of_array
from slotwise.llm.training import fit_on, labelled_sample

from .conftest import prose


def toxic_docs(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        sentences = [prose(r, 9).capitalize() + "." for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.3
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " you " + r.choice(["scoundrel", "scoundrels", "knave"]) + "."
        out.append((" ".join(sentences), int(bad)))
    return out


def test_toxicity_on_held_out_documents():
    train, test = toxic_docs(1500, 1), toxic_docs(600, 2)
    m = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    p = m.scores(of_array(pa.array([t for t, _ in test])))[0] >= 0.3
    y = np.array([y for _, y in test]) == 1
    assert (p & y).sum() >= 0.97 * y.sum()
    assert (p & ~y).sum() <= 0.03 * (~y).sum()


def test_toxic_sentences_are_found(spark, odd_docs, no_docs):
    m = toxicity.fit(*(list(x) if k == 0 else np.array(x) for k, x in enumerate(zip(*toxic_docs(1500, 1), strict=True))))
    text = "É bien. All is well here. You are a knave and no more! Good day."
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first()
    assert row.predicted == 1
    assert [text[s.start : s.end] for s in row.sentences] == ["You are a knave and no more"]
    rows = toxicity.score(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, m).count() == 0


def test_noisy_or_joins_sentences():
    w = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    m = toxicity.Model(w, 0.0)
    assert np.allclose(m.scores(of_array(pa.array(["one. two. three.", "", "one"])))[0], [1 - 0.5**3, 0, 0.5])


def graded(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        y = r.randint(0, 2)
        text = prose(r, 80)
        if y == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if y == 1:
            text = text.replace("w1", "meh w1")
        out.append((text, y))
    return out


def test_ordinal_regression():
    train, test = graded(1200, 1), graded(400, 2)
    m = quality_classifier.fit([t for t, _ in train], np.array([y for _, y in train]))
    assert (np.diff(m.thresholds) > 0).all()
    above = m.above(of_array(pa.array([t for t, _ in test])))
    y = np.array([y for _, y in test])
    assert (above[:, 0] >= above[:, 1]).all()
    assert ((above[:, 0] >= 0.5) == (y >= 1)).mean() > 0.97
    expected = above.sum(1)
    assert expected[y == 0].mean() < expected[y == 1].mean() < expected[y == 2].mean()


def test_grades_of_odd_documents(odd_docs, no_docs):
    m = quality_classifier.fit([t for t, _ in graded(300, 1)], np.array([y for _, y in graded(300, 1)]))
    rows = quality_classifier.grade(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {"clash", None, "x"}
    assert all(0 <= r.expected_grade <= 2 and r.selected == (r.tail_probability >= 0.5) for r in rows)
    assert quality_classifier.grade(no_docs, m).count() == 0


def test_training_samples(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 0), (5, 1), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    m = toxicity.train(odd_docs, labels, keep=F.col("id") != 99)
    assert 0 <= toxicity.score(odd_docs, m).agg(F.max("score")).first()[0] <= 1
    assert toxicity.train(no_docs, labels.limit(0)).intercept < 0
    with pytest.raises(ValueError):
        labelled_sample(odd_docs, spark.range(30).selectExpr("id as doc_id", "id as y"), F.col("y"), per_class=3, max_bytes=9)


def test_samples_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(40)], "id long, text string").withColumn("y", F.lit(1))
    for limit, n in ((0, 0), (250, 2), (10_000, 40)):
        assert fit_on(docs, lambda texts, y: len(texts), limit) == n


def test_gradient_of_noisy_or():
    r = np.random.default_rng(3)
    doc, labels = np.sort(r.integers(0, 6, 20)), np.array([0, 1, 1, 0, 1, 0])
    sentence, column, w = r.integers(0, 20, 90), r.integers(0, 8, 90), r.normal(0, 0.7, 9)

    def loss(w):
        total = 0.0
        for d, y in enumerate(labels):
            none = 1.0
            for k in np.flatnonzero(doc == d):
                z = w[-1] + sum(w[c] for s, c in zip(sentence, column, strict=True) if s == k)
                none *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(1 - none if y else none)
        return total / len(labels)

    assert np.allclose(toxicity.gradient(w, sentence, column, doc, labels), by_differences(loss, w), atol=1e-6)


def by_differences(loss, w, h=1e-5):
    step = np.eye(len(w)) * h
    return np.array([(loss(w + s) - loss(w - s)) / (2 * h) for s in step])


def test_gradient_of_cumulative_links():
    r = np.random.default_rng(4)
    grades, weight = np.array([0, 2, 1, 3, 1, 0, 2]), r.random(7)
    doc, column, x, w = r.integers(0, 7, 40), r.integers(0, 6, 40), r.random(40), r.normal(0, 0.5, 9)

    def loss(w):
        cuts = [w[6], w[6] + math.exp(w[7]), w[6] + math.exp(w[7]) + math.exp(w[8])]
        total = 0.0
        for d, g in enumerate(grades):
            z = sum(v * w[c] for e, c, v in zip(doc, column, x, strict=True) if e == d)
            below = [0.0, *(1 / (1 + math.exp(z - c)) for c in cuts), 1.0]
            total -= weight[d] * math.log(below[g + 1] - below[g])
        return total

    assert np.allclose(quality_classifier.gradient(w, doc, column, x, grades, weight), by_differences(loss, w), atol=1e-6)


def plain_words(sentence):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", sentence)


def test_toxic_scores_against_a_plain_version(spark):
    """Every sentence by the words' and prefixes' weights, one at a time; noisy-or; and a located sentence in every predicted document."""
    texts, y = zip(*toxic_docs(1500, 1), strict=True)
    m = toxicity.fit(list(texts), np.array(y))
    weak = toxicity.Model(m.weights / 10, -2.0)  # scores that only add up

    def weight(word):
        block = of_array(pa.array([word]))
        return weak.weights[toxicity.features(block, np.array([0]), np.array([len(block.buf)]))].sum()

    docs = [(k, t) for k, (t, _) in enumerate(toxic_docs(60, 5))] + [(60, "One.\nTwo! ... three? "), (61, "?!"), (62, "")]
    rows = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), weak, 0.3).collect()}
    alone = 0
    for k, t in docs:
        z = [weak.intercept + sum(map(weight, w)) for s in re.split(r"[.!?\n]", t) if (w := plain_words(s))]
        p = [1 / (1 + math.exp(-v)) for v in z]
        assert abs(rows[k].score - (1 - math.prod(1 - v for v in p))) < 1e-5
        want = sum(v >= 0.3 for v in p)
        alone += rows[k].predicted and not want
        assert len(rows[k].sentences) == (want or rows[k].predicted)
        if rows[k].predicted and not want:
            assert abs(rows[k].sentences[0].score - max(p)) < 1e-5
    assert alone


def test_grades_against_a_plain_version(spark):
    """The words' shares of features by their hashes, one text at a time, through the cumulative links."""
    texts, y = zip(*graded(300, 1), strict=True)
    m = quality_classifier.fit(list(texts), np.array(y))
    docs = [(k, t) for k, (t, _) in enumerate(graded(30, 7))] + [(30, "a a a\nb c d\nb c d"), (31, None)]
    for r in quality_classifier.grade(spark.createDataFrame(docs, "doc_id long, text string"), m).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        doc, f = quality_classifier.features(of_array(pa.array([r.text or ""])))
        z = sum(float(m.weights[k]) for k in f) / max(len(words), 1)
        above = [1 / (1 + math.exp(t - z)) for t in m.thresholds]
        assert abs(r.expected_grade - sum(above)) < 1e-5 and abs(r.tail_probability - above[0]) < 1e-5
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        again = sum(triples[t] > 1 for t in zip(words, words[1:], words[2:], strict=False))
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        dup = sum(len(x.split()) for k, x in enumerate(lines) if x in lines[:k])
        repeats = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False))
        assert len(f) == 2 * len(words) + max(0, len(words) - 1) + repeats + again + dup
