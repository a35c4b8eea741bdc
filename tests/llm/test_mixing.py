import random
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import mixing
from slotwise.llm.queries import tokenizer_path
from slotwise.llm.textblock import of_array
from slotwise.llm.token_counts import encoder

from .conftest import prose

PATH = tokenizer_path()


def test_shortages_go_to_siblings_first():
    tokens = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}
    out = mixing.budgets(tokens, {}, 200, 1)
    assert out == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 100}  # a keeps its half: y takes over what x lacks
    out = mixing.budgets(tokens, {}, 400, 1)
    assert out == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 290}  # only what all of a lacks goes to b
    assert mixing.budgets(tokens, {("b",): 0}, 200, 1)[("b", "z")] == 0
    assert mixing.budgets({}, {}, 10, 1) == {}


def test_fill_shares_by_weight():
    got = mixing.fill(Fraction(100), {("a",): (Fraction(1), 1000), ("b",): (Fraction(3), 60), ("c",): (Fraction(1), 10)})
    assert got == {("a",): 30, ("b",): 60, ("c",): 10}


def poured(tokens, weights, total, epochs):
    """Budgets by pouring: every node's inflow is split by weight among the children under which a leaf can still take some, until the next leaf is full."""
    held = {leaf: Fraction(0) for leaf in tokens}
    left = Fraction(total)
    while left > 0:
        # a leaf can take some if it is not full and no weight above it is 0
        able = {leaf for leaf, n in tokens.items() if held[leaf] < n * epochs and all(weights.get(leaf[:k], 1) > 0 for k in range(1, len(leaf) + 1))}
        if not able:
            break
        rate = {}
        for leaf in able:
            share = Fraction(1)
            for k in range(len(leaf)):
                among = {x[: k + 1] for x in able if x[:k] == leaf[:k]}
                share *= Fraction(weights.get(leaf[: k + 1], 1)) / sum(Fraction(weights.get(c, 1)) for c in among)
            rate[leaf] = share
        step = min([left, *((tokens[x] * epochs - held[x]) / rate[x] for x in able)])
        for x in able:
            held[x] += step * rate[x]
        left -= step
    return held


def test_budgets_against_pouring():
    r = random.Random(6)
    for _ in range(60):
        tokens = {(d, s, str(k)): r.choice([0, 3, 50, 400]) for d in "ab" for s in "xyz" for k in range(r.randint(1, 3))}
        weights = {p: r.choice([0.0, 0.5, 1.0, 4.0]) for p in [("a",), ("b", "x"), ("a", "y"), ("b", "z", "0"), ("a", "x", "0")]}
        epochs, total = r.randint(1, 2), r.randint(0, 900)
        want, got = poured(tokens, weights, total, epochs), mixing.budgets(tokens, weights, total, epochs)
        assert all(int(want[leaf]) == got.get(leaf, 0) for leaf in tokens), (got, want)


def test_what_weighs_nothing_holds_no_share():
    tokens = {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 5000}
    out = mixing.budgets(tokens, {("a", "y"): 0}, 1000, 1)
    assert out == {("a", "x"): 100, ("a", "y"): 0, ("b", "x"): 900}


def test_weights_of_no_path():
    tokens = {("a", "0"): 5, (None, "1"): 5}
    assert mixing.checked({("a", 0): 2.0, (None,): 3.0}, tokens, 2, "error") == {("a", "0"): 2.0, (None,): 3.0}
    assert mixing.checked({("c",): 1.0}, tokens, 2, "ignore") == {("c",): 1.0}
    assert mixing.checked({("c",): 1.0}, {}, 2, "error") == {("c",): 1.0}
    for weights in ({("c",): 1.0}, {("a", "0", "z"): 1.0}, {(): 1.0}, {("a",): -1.0}):
        with pytest.raises(ValueError, match="path|levels"):
            mixing.checked(weights, tokens, 2, "error")


def test_against_a_plain_version(spark):
    r = random.Random(4)
    docs = [(k, prose(r, r.randint(0, 60)), r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", "s2"])) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 3.0, ("fr", "s1"): 4.0}
    got = mixing.mix_sources(df, levels, weights, PATH, share=0.9, max_epochs=3, seed=3).collect()
    tokens = dict(zip((d[0] for d in docs), encoder(PATH).counts(of_array(pa.array([d[1] for d in docs]))).tolist(), strict=True))
    leaf = {d[0]: (d[2], d[3]) for d in docs}
    sums = Counter()
    for k, n in tokens.items():
        sums[leaf[k]] += n
    given = mixing.budgets(dict(sums), weights, int(0.9 * sum(sums.values())), 3)
    hashes = {(x.doc_id, x.e): x.h for x in df.crossJoin(spark.range(4).toDF("e")).select("doc_id", "e", mixing.order(F.col("doc_id"), 3, F.col("e")).alias("h")).collect()}
    want = []
    for path, budget in given.items():
        mine = [k for k in tokens if leaf[k] == path]
        whole = budget // sums[path]
        want += [(k, e) for k in mine for e in range(whole)]
        used = 0
        for k in sorted(mine, key=lambda k: hashes[k, whole]):
            used += tokens[k]
            if used > budget - whole * sums[path]:
                break
            want.append((k, whole))
    # a document's epochs are numbered from 0: those of the prefix follow its whole ones
    assert sorted((x.doc_id, x.epoch) for x in got) == sorted(want)
    by = defaultdict(int)
    for x in got:
        by[leaf[x.doc_id]] += tokens[x.doc_id]
    assert all(by[p] <= b for p, b in given.items())


def test_leaves_of_few_documents(spark):
    """Cuts in any hash range, the lowest too: leaves of one document each, taken in full or not at all."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), (F.col("id") % 1500).cast("string").alias("source"))
    rows = mixing.mix_sources(df, {"source": F.col("source")}, {}, PATH, share=0.5, max_epochs=1).groupBy("source").count().collect()
    assert len(rows) == 1500 and {r["count"] for r in rows} == {1}


def test_odd_documents(odd_docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    rows = mixing.mix_sources(odd_docs, levels, {}, PATH, share=1.0, max_epochs=1).collect()
    assert len(rows) == odd_docs.count() and {r.epoch for r in rows} == {0}
    assert mixing.mix_sources(no_docs, levels, {}, PATH).count() == 0
