import random
from collections import defaultdict

import numpy as np
import pytest

from slotwise.llm import near_dedup
from slotwise.llm.components import components
from slotwise.llm.dart_minhash import signatures
from slotwise.llm.near_dedup import _block_links, classes
from slotwise.llm.textblock import U64, mix

from .conftest import prose


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    for _ in range(3):
        a = {int(x): float(w) for x, w in zip(r.integers(0, 1 << 60, 200), r.choice([0.3, 1, 2, 5, 9], 200), strict=True)}
        b = {x: w * (r.choice([0.5, 2]) if k % 5 == 0 else 1) for k, (x, w) in enumerate(a.items()) if k % 7}
        keys = set(a) | set(b)
        true = sum(min(a.get(x, 0), b.get(x, 0)) for x in keys) / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys)
        s = signatures(np.array([0] * len(a) + [1] * len(b)), mix(np.array([*a, *b], U64)), np.array([*a.values(), *b.values()]), 2, 2048)
        assert abs((s[0] == s[1]).mean() - true) < 0.05


def brute(docs, weighted=False):
    sets = {}
    for k, t in docs:
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        sets[k] = {g: grams.count(g) if weighted else 1 for g in set(grams)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            shared = sum(min(n, sets[b].get(g, 0)) for g, n in sets[a].items())
            if a < b and shared and shared >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_against_brute_force(spark, weighted):
    r = random.Random(5)
    docs = []
    for _ in range(6):  # families whose members are like one another in every degree
        base = prose(r, 150).split()
        for _ in range(14):
            words = list(base)
            for _ in range(r.randint(0, 7)):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            docs.append(" ".join(words))
    docs += ["", None, "two words", "two words", "  ", prose(r, 40), prose(r, 40)]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = {x.doc_id: x.class_id for x in classes(spark.createDataFrame(docs, "doc_id long, text string"), weighted=weighted).collect()}
    assert got == brute(docs, weighted)


def test_equal_blank_texts_are_one_class(spark):
    docs = [(k, "") for k in range(4)] + [(4, " \n"), (5, " \n"), (6, None), (7, None), (8, "word"), (9, "word"), (9, ""), (10, "")]
    got = {x.doc_id: x.class_id for x in classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 0}


def test_rows_that_share_an_id_have_the_links_of_each_text(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = [(5, one), (5, two), (3, one), (4, two + " more"), (9, one + " more"), (9, "words of its own that nobody has"), (7, "words of its own")]
    got = {x.doc_id: x.class_id for x in classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7}


@pytest.mark.parametrize("weighted", [False, True])
def test_small_cells_and_chunks(spark, monkeypatch, weighted):
    for name, value in (("BLOCK", 3), ("CHUNK", 100), ("HUB_CHUNK", 100), ("SLICE", 7)):
        monkeypatch.setattr(near_dedup, name, value)
    r, docs = random.Random(8), []
    for _ in range(3):
        base = prose(r, 40).split()
        for _ in range(12):
            words = list(base)
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(words)))
    got = {x.doc_id: x.class_id for x in classes(spark.createDataFrame(docs, "doc_id long, text string"), weighted=weighted).collect()}
    assert got == brute(docs, weighted)


def test_weighted_links_between_unlike_sets():
    member = lambda k, own: {"id": k, "component": k, "keys": np.array([1, *own], U64).tobytes(), "counts": np.array([1000] + [1] * len(own), np.int64).tobytes()}
    assert list(_block_links([member(1, range(10, 40))], [member(2, range(50, 80))], 0.8, True)) == [(1, 2)]
    assert list(_block_links([member(1, range(10, 40))], [member(2, range(50, 80))], 0.8, False)) == []


def test_odd_documents(odd_docs, no_docs):
    rows = classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    assert classes(no_docs).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7), (300, 200)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for k in sorted(near):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = want.get(k, k)
                todo += near[x]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
