import random

import pytest

from slotwise.llm import line_dedup
from slotwise.llm.line_dedup import dedup_lines


def close(a, b, bound):
    if a == b:
        return True
    if not bound or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(docs, bound):
    seen, out = [], {}
    for k, t in docs:
        if t is None:
            out[k] = None
            continue
        kept = []
        for line in t.split("\n"):
            if len(line) < 16:
                kept.append(line)
                continue
            if not any(close(line, s, bound) for s in seen):
                kept.append(line)
            seen.append(line)
        out[k] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("seed", "bound", "bits"), [(0, 1, 64), (1, 1, 64), (2, 0, 64), (3, 1, 5)])
def test_against_brute_force(spark, monkeypatch, seed, bound, bits):
    monkeypatch.setattr(line_dedup, "KEY_BITS", bits)  # five bits: most keys collide
    r = random.Random(seed)
    alphabet = "ab" if seed else "aé漢b"
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(14, 19))) for _ in range(12)]

    def edit(line):
        for _ in range(r.choice([0, 1, 1, 2])):
            p, k = r.randint(0, len(line)), r.randint(0, 2)
            line = line[:p] + (r.choice(alphabet) if k else "") + line[p + (k != 1) :]
        return line

    docs = [(k, None if r.random() < 0.05 else "\n".join(edit(r.choice(base)) if r.random() < 0.8 else r.choice(["", "x", f"a line with number {r.randint(0, 30)}"]) for _ in range(r.randint(0, 7)))) for k in range(60)]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), bound=bound).collect()}
    assert got == brute(docs, bound)


def test_documents_are_told_apart_whatever_the_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "document_key", lambda i, t: F.lit(7).cast("bigint"))
    monkeypatch.setattr(line_dedup, "VARIANTS", 5)
    lines = [f"line number {c} of some length" for c in "abcdef"]
    docs = [(1, f"{lines[0]}\n{lines[1]}"), (2, f"{lines[2]}\n{lines[0]}"), (3, f"{lines[1]}\n{lines[3]}\nline number {'d'} of some lengths"), (4, "\n".join(lines)), (None, lines[4])]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), bound=0).collect()}
    assert got == {None: docs[4][1], 1: docs[0][1], 2: lines[2], 3: f"{lines[3]}\n{docs[2][1].splitlines()[2]}", 4: lines[5]}
    near = {x.doc_id: x.n_removed for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert near == {None: 0, 1: 2, 2: 2, 3: 3, 4: 6}  # all lines are one letter apart, and that of no id comes first


def test_tables_are_deleted(spark):
    import os

    from slotwise.llm import runtime

    runtime.discard(spark)
    before = set(os.listdir(runtime.shared_folder(spark)))
    assert dedup_lines(spark.createDataFrame([(1, "a line of some length"), (2, "a line of some lengths")], "doc_id long, text string")).count() == 2
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(runtime.shared_folder(spark))) - before} == {"removed-lines"}


def test_one_very_long_line(spark, monkeypatch):
    sizes = []
    whole = line_dedup.Lines.variants

    def watched(self, at, kinds):
        for x in whole(self, at, kinds):
            sizes.append(len(x[0]))
            yield x

    text = "".join(chr(97 + k * k % 23) for k in range(5000))
    block = line_dedup.Block(*(lambda b: (b, line_dedup.np.array([0, len(b)])))(line_dedup.np.frombuffer(text.encode(), line_dedup.np.uint8)))
    monkeypatch.setattr(line_dedup, "VARIANTS", 300)
    x = line_dedup.Lines(block, 0)
    got = list(watched(x, line_dedup.np.array([0]), line_dedup.np.array([3])))
    assert max(sizes) <= 2 * 300 + 300 and sum((r == 2).sum() for _, _, r in got) == 5000
    docs = [(1, text), (2, text[:2500] + "!" + text[2501:])]
    assert {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1: 0, 2: 1}


def test_short_lines_go_where_all_exact_repeats_do(spark):
    docs = [(1, "Les.\n\n  \na line of some length\nfifteen letters"), (2, "Les.\n\n  \na line of some lengths\nfifteen letterz\nx"), (3, "x\nLes"), (4, "x\nLes.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.text for x in dedup_lines(df, exact_all=True).collect()}
    assert got == {1: docs[0][1], 2: "\n  \nfifteen letterz\nx", 3: "Les", 4: ""}
    assert {x.doc_id: x.n_removed for x in dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_odd_documents(odd_docs, no_docs):
    rows = dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count() and rows[0].asDict().keys() >= {"score", "n_lines", "n_removed"}
    assert sum(r.n_removed for r in rows) == 0
    assert dedup_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(odd_docs.withColumnRenamed("score", "n_lines"))
