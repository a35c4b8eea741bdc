import hashlib
import random

import numpy as np
import pytest

from slotwise.llm import suffix_dedup
from slotwise.llm.suffix_dedup import remove_repeats


def brute(docs):
    first = {}
    for k, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, t in docs:
        raw = (t or "").encode()
        cover = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < k:
                cover[p : p + 50] = [True] * 50
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((k, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_factor_lengths_against_brute_force(seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab") for _ in range(400)).encode() if seed < 4 else b"a" * 400
    texts = []
    for _ in range(14):
        a, size = r.randint(0, 300), r.randint(50, 100)
        text = bytearray(base[a : a + size])
        if r.random() < 0.5:
            text[r.randrange(len(text))] = ord("c")
        texts.append((r.randint(0, 6), bytes(text)))
    texts += [texts[0], (7, texts[1][1]), (-1, texts[2][1])]
    buf, n = np.frombuffer(b"".join(t for _, t in texts), np.uint8), np.array([len(t) - 49 for _, t in texts])
    begin = np.cumsum(n + 49) - (n + 49)
    want = []
    for owner, t in texts:
        for p in range(len(t) - 49):
            longest = 0
            for other, u in texts:
                for q in range(len(u) - 49 if other < owner else 0):
                    k = 0
                    while k < min(len(t) - p, len(u) - q) and t[p + k] == u[q + k]:
                        k += 1
                    longest = max(longest, k if k >= 50 else 0)
            want.append(longest)
    owner = np.array([o for o, _ in texts])
    assert suffix_dedup.longest_previous_factor(buf, begin, n, owner).tolist() == want and any(want)
    assert suffix_dedup._sorted_factors(buf, begin, n, owner).tolist() == want


@pytest.mark.parametrize("hot", [0, 4096])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, hot):
    r = random.Random(seed)
    alphabet = "ab" if seed == 1 else "abcdé "
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(30, 300))) for _ in range(8)]
    docs = [(r.randint(0, 60) if seed == 2 else k, "".join(r.choice(base)[r.randint(0, 20) : r.randint(30, 300)] for _ in range(r.randint(0, 5)))) for k in range(40)]
    rows = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), block_docs=2, hot_blocks=hot).collect()
    assert sorted(tuple(x) for x in rows) == brute(docs)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 120)
    from slotwise.llm.textblock import of_array
    import pyarrow as pa

    whole = suffix_dedup.runs_of(of_array(pa.array(["abc" * 100, "x" * 49, "y" * 50])))
    assert whole.n.sum() == 251 + 1


def test_odd_documents(odd_docs, no_docs):
    rows = remove_repeats(odd_docs, with_text=True).collect()
    known = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is not null").collect()]
    assert sorted(tuple(r)[:5] for r in rows if r.doc_id is not None) == brute(known)
    assert [(r.n_removed, bytes(r.kept)) for r in rows if r.doc_id is None] == [(0, b"nobody's words")]
    assert remove_repeats(no_docs).count() == 0
