import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import collocations as col
from slotwise.llm.textblock import of_array

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, support, top=2000, longest=5):
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang or "und", *ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = {}
    for (lang, *ws), a in f.items():
        if len(ws) > 1 and a >= support:
            cuts = [(1000 * a * n[lang] // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k, f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws))]
            found[lang, tuple(ws)] = (a, *min(cuts))
    inside = set()
    for (lang, ws), (a, *_) in found.items():
        inside |= {(lang, ws[i : i + k]) for k in range(2, len(ws)) for i in range(len(ws) - k + 1) if 100 * a >= 100 * found[lang, ws[i : i + k]][0]}
    rows = [(lang, " ".join(ws), a, left, r, n[lang], s) for (lang, ws), (a, s, _, left, r) in found.items() if (lang, ws) not in inside]
    out = []
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], k, *r[1:]) for k, r in enumerate(mine, 1)]
    return sorted(out)


def texts(seed, n=120):
    r = random.Random(seed)
    vocab = ["the", "New", "York", "city", "é", "of", "à-la", "漢", "x" * 40]
    return [("".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t", ". ", "  ", "\n", "\x0b", "\x00"]) for _ in range(r.randint(0, 40))) + r.choice(["", " new york city hall"]), r.choice(["en", "en", "fr", None])) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(k, t, lang, "clash", 5) for k, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int")


@pytest.mark.parametrize(("support", "top", "held"), [(3, 2000, 1 << 18), (12, 7, 4), (200, 2000, 1 << 18)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, support, top, held):
    monkeypatch.setattr(col, "HELD_ROWS", held)
    docs = texts(support) + [(None, "en"), ("", "fr"), ("Alone", "de")]
    got = sorted(map(tuple, col.collocations(frame(spark, docs).repartition(3), support=support, top=top).collect()))
    assert got == brute(docs, support, top)
    assert got or support == 200


def test_repeated_rows_and_nothing(spark, no_docs):
    docs = texts(5, 40)
    assert sorted(map(tuple, col.collocations(frame(spark, docs * 2), support=4).collect())) == brute(docs * 2, 4)
    assert col.collocations(no_docs).count() == 0
    with pytest.raises(ValueError, match="longest"):
        col.collocations(no_docs, longest=1)


def test_few_buckets_lose_nothing(spark, monkeypatch):
    # phrases share buckets, so nearly all pass the filters: the exact counts decide
    docs = texts(8, 60)
    p = col.Phrases(of_array(pa.array([t for t, _ in docs])), np.zeros(len(docs), np.int64), col.seeds(["en"]).repeat(len(docs)))
    ok, h = p.level(2)
    at = np.flatnonzero(ok)
    first, n = p.counted(at, h[at], 2)
    clumped, m = p.counted(at, h[at] & np.uint64(3), 2)
    name = lambda x, c: dict(zip(p.strings(x, 2).to_pylist(), c.tolist(), strict=True))
    assert name(first, n) == name(clumped, m)
    assert name(first, n) == Counter(x for t, _ in docs for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(ASCII)) for ws in [re.findall(r"[^\x20\x09]+", piece)] for x in map(" ".join, zip(ws, ws[1:], strict=False)))


def test_bitmaps(spark):
    docs = [("a b c a b", "en"), ("a b d", "fr")]
    source = frame(spark, docs).select("lang", "text")
    found = col.one_pass(source, 1, 2, 2, None, None)
    full = col.bitmap(found, 2)
    p = col.Phrases(of_array(pa.array(["a b c"])), np.zeros(1, np.int64), col.seeds(["en"]))
    assert col.has(full, p.level(2)[1]).tolist() == [True, False]
    known = col.bitmap(col.marked(spark.createDataFrame([("en", "b c")], "lang string, phrase string"), 2), 2)
    assert col.has(known, p.level(2)[1]).tolist() == [False, True]


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    rows = [("en", "", big, 0), ("en", "a", 3 * 10**15, 1), ("en", "b", 2 * 10**15, 1), ("en", "a b", 10**15 + 7, 2)]
    got = col.scored(spark.createDataFrame(rows, "lang string, phrase string, a long, n_words int")).first()
    assert tuple(got) == ("en", "a b", 10**15 + 7, 3 * 10**15, 2 * 10**15, big, 1000 * (10**15 + 7) * big // (6 * 10**30))
