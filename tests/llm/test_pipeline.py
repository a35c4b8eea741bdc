import os
import re
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import line_dedup
from slotwise.llm.queries import ORACLE_SQL, QUERIES, WEIGHTS, levels, tokenizer_path
from slotwise.llm.textblock import of_array
from slotwise.llm.token_counts import encoder

from .test_line_dedup import close
from .test_mixing import poured

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


def plain_lines(docs):
    """Texts (by id) without the lines that an earlier one equals (if they have a word) or is one edit from (if they have 16 characters); None: the document goes."""
    seen, long, out = set(), defaultdict(list), {}
    for k, text in sorted(docs):
        kept, n = [], 0
        for line in text.split("\n"):
            near = len(line) >= 16 and any(close(line, x, 1) for m in (-1, 0, 1) for x in long[len(line) + m])
            gone = near or (line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line)))
            if len(line) >= 16 and line not in seen:
                long[len(line)].append(line)
            seen.add(line)
            n += gone
            kept += [] if gone else [line]
        text = "\n".join(kept)
        if not n or re.search(r"[^\x20\x09-\x0D]", text):
            out[k] = text
    return out


def plain_classes(docs):
    """The least id of each document's class, by the similarity of every pair's sets of five words."""
    sets = {}
    for k, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("blank", text)}
    home = {k: k for k in sets}

    def root(k):
        while home[k] != k:
            k = home[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {k: root(k) for k in ids}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    poor = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    assert kept.join(poor, "doc_id").count() <= 0.2 * max(poor.count(), 1)
    assert kept.join(good, "doc_id").count() >= 0.95 * good.count()
    lines = corpus_pipeline.lines(spark, kept, SF).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == plain_lines([(r.doc_id, r.text) for r in kept.collect()])
    near = corpus_pipeline.near_duplicates(spark, lines, SF).cache()
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(plain_classes([(r.doc_id, r.text) for r in lines.collect()]).values()))
    mixed = corpus_pipeline.mixture(spark, near, SF).cache()
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    rows = near.withColumn("domain", levels()["domain"]).collect()
    count = encoder(tokenizer_path())
    tokens = {r.doc_id: int(count.counts(of_array(pa.array([r.text])))[0]) for r in rows}
    leaf = {r.doc_id: (r.domain, r.lang, r.source) for r in rows}
    sums = Counter()
    for k, n in tokens.items():
        sums[leaf[k]] += n
    given = poured(sums, WEIGHTS, int(0.75 * sum(tokens.values())), 2)
    used, taken = Counter(), Counter(r.doc_id for r in mixed.collect())
    for k, n in taken.items():
        used[leaf[k]] += n * tokens[k]
    assert max(taken.values()) <= 2
    for path, n in sums.items():
        mine = [k for k in tokens if leaf[k] == path]
        assert used[path] <= given[path] and (used[path] == 2 * n or used[path] + max(tokens[k] for k in mine) > int(given[path]))
    packed = corpus_pipeline.sequences(spark, mixed, SF).collect()
    assert sum(p.length for p in packed) == sum(n * (tokens[k] + 1) for k, n in taken.items())
    places = defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for x in places.values():
        ends = [0, *accumulate(n for _, n in sorted(x))]
        assert [o for o, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048


def test_documents_of_one_id_are_told_apart_whatever_the_hash(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "document_key", lambda i, t: F.lit(7).cast("bigint"))
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (2, two, "en", "s", 1), (3, one + " end", "en", "s", 1), (4, three, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 2, 4]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "sequences"]
    assert os.path.exists(SF)


def test_stages_on_odd_documents(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF)
        rows = out.collect()
        assert name in ("quality", "mixture") or rows
        assert name == "sequences" or set(rows) <= set(odd_docs.select(*corpus_pipeline.COLUMNS).collect()) or name == "lines"
        assert stage(spark, no_docs, SF).count() == 0
    assert corpus_pipeline.quality(spark, odd_docs, SF).columns == list(corpus_pipeline.COLUMNS)
    packed = corpus_pipeline.sequences(spark, odd_docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == odd_docs.count()


def test_documents_that_lose_every_line_go(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nown words here"), (2, line), (3, f"{line}\n  "), (4, ""), (5, None), (6, "short"), (7, "short")]
    docs = spark.createDataFrame([(*r, "en", "src1", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 4: ("", 0), 5: (None, None), 6: ("short", 5)}


def test_near_duplicates_keeps_unlike_texts_of_one_id(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, one), (1, two), (1, one), (2, one + " end"), (None, two), (None, "nobody else's words"), (3, None), (4, None)]
    docs = spark.createDataFrame([(*r, "en", "src1", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (None, "nobody else's words"), (3, None), (4, None)], key=str)


def test_tables_between_stages_are_deleted(spark):
    from slotwise.llm import runtime

    runtime.discard(spark)
    at = runtime.shared_folder(spark)
    before = set(os.listdir(at))
    corpus_pipeline.run(spark, SF).count()
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(at)) - before}
    assert left == {"stage-mixture", "pieces"}
