import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import periodic_runs as runs
from slotwise.llm.textblock import of_array


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(ws, least=6, times=4):
    """Every maximal stretch by its least period, word by word."""
    n, out = len(ws), {}
    for q in range(1, n // times + 1):
        x = 0
        while x < n - q:
            s = x
            while x < n - q and ws[x] == ws[x + q]:
                x += 1
            if x > s and x - s + q >= max(least, times * q):
                out.setdefault((s, x + q), q)
            x += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def repetitive(r):
    t = []
    for _ in range(r.randint(0, 6)):
        p = [r.choice("ab c dé e".split()) for _ in range(r.randint(1, 5))]
        t += p * r.randint(1, 7) + p[: r.randint(0, len(p))]
    return " ".join(t) + r.choice(["", "\n", " ", "\x0b"])


def found(words):
    text, start, end, period = runs.find_runs(words)
    out = [[] for _ in range(len(words.off) - 1)]
    for t, s, e, q in zip(text.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        out[t].append((s - int(words.off[t]), e - s, q))
    return out


@pytest.mark.parametrize("pairs", [7, 1 << 17])
def test_runs_are_those_of_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    monkeypatch.setattr(runs, "COMPARED", 5 if pairs == 7 else 1 << 20)
    r = random.Random(pairs)
    for k in range(80):
        texts = [repetitive(r) for _ in range(r.randint(1, 8))] + [""] * (k % 2)
        assert found(runs.words_of(of_array(pa.array(texts)))) == [brute(split(t)) for t in texts]


def test_colliding_hashes_change_nothing():
    r = random.Random(9)
    for k in range(60):
        texts = [repetitive(r) for _ in range(4)]
        w = runs.words_of(of_array(pa.array(texts)))
        same = np.minimum(w.hashes, np.uint64(1 + k % 2) << np.uint64(62))
        block = of_array(pa.array(texts))
        assert found(runs.Words(block, w.start, w.end, w.off, same)) == [brute(split(t)) for t in texts]


def test_thue_morse_words_fool_no_hash():
    # sums of powers modulo 2 ** 64 are equal for such words and their opposites
    bits = [bin(k).count("1") & 1 for k in range(1 << 12)]
    text = " ".join("no yes".split()[b] for b in bits) + " " + " ".join("yes no".split()[b] for b in bits)
    assert found(runs.words_of(of_array(pa.array([text, text])))) == [[], []]


def contract(doc_id, text):
    ws = split(text)
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    all_ = brute(ws)
    gone = {i for s, n_, q in all_ for i in range(s + q, s + n_)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(all_, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    milli = (1000 * best[1] // best[2],) if best else (None,)
    return (doc_id, n, len(all_), *(best or (None,) * 3), *milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in all_)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)), len(gone))


def test_reports(spark, odd_docs, no_docs):
    r = random.Random(4)
    docs = spark.createDataFrame([(k, repetitive(r) + " " + " ".join(f"w{r.randint(0, 30)}" for _ in range(60))) for k in range(400)], "doc_id long, text string")
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, runs.runs_of(docs, key_col="doc_id").collect())) == key(contract(d.doc_id, d.text) for d in docs.collect())
    odd = runs.runs_of(odd_docs).collect()
    assert key((d.doc_id, d.n_words, d.n_runs) for d in odd) == key((d.doc_id, len(split(d.text)), len(brute(split(d.text)[:400]))) for d in odd_docs.collect())
    assert key(map(tuple, runs.runs_of(odd_docs.where("doc_id is not null"), key_col="doc_id").where("n_words < 3000").collect())) == key(contract(d.doc_id, d.text) for d in odd_docs.where("doc_id is not null").collect() if len(split(d.text)) < 3000)
    assert runs.runs_of(no_docs).count() == 0


def test_collapsed_texts(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "to  be or " + "not to " * 5 + "not é"), (2, None), (3, "so " * 7)], "doc_id long, text string")
    rows = {r.doc_id: r for r in runs.collapse(docs).collect()}
    assert rows[1].collapsed == "to be or not to é" and [tuple(x) for x in rows[1].runs] == [(3, 11, 2)]
    assert (rows[2].collapsed, rows[2].runs) == ("", [])
    assert rows[3].collapsed == "so"
    assert runs.collapse(docs, least=20).where("size(runs) > 0").count() == 0
    assert runs.collapse(odd_docs).count() == odd_docs.count() and runs.collapse(no_docs).count() == 0


def test_long_texts(spark):
    n = 200_000
    text = " ".join(f"v{k % 1000}" for k in range(n)) + " end"
    row = runs.runs_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_runs, row.start, row.length, row.period) == (n + 1, 1, 0, n, 1000)
