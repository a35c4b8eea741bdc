"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

1. Texts become sets of five-word shingles (a text of fewer words is one shingle). Equal sets are one class
   from the start; each goes on through its least document. Equal texts without a word are one class too.
2. Signatures of ``K`` darts are cut into bands; documents that share a band's key form a group. In each
   group the document with the most partners over all its groups is the hub, and every member is
   compared with the hub on the whole sets: pairs grow with the members, not with their square. The members
   of a hub are dealt to chunks of about ``HUB_CHUNK`` shingles, and the hub's set goes once to each chunk.
3. Where that leaves a group in several components, the members outside the hub's component are compared
   with the whole group, in cells of about ``BLOCK`` documents (or ``CHUNK`` shingles) a side, inside a task;
   only links that join components leave it. So no link within a group is lost, and no group meets in one
   task. Groups of the same documents under several keys are compared once.
4. Connected components of the links give the classes.

Sets are made from the texts where they are compared, and never stored: each comparison reads the texts
through a filter of fixed size, so of the texts only those to be compared move. Joins on keys that may be
hot send the few that hold a large share of the rows as a broadcast (``runtime.join_hot``).

A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.components import components
from slotwise.llm.dart_minhash import bands, signatures
from slotwise.llm.textblock import U64, Block, give_back, mix, slices

WORDS, K, ROWS = 5, 125, 5
BLOCK, CHUNK, HUB_CHUNK = 192, 1 << 18, 1 << 16
#: Shingles of a cell that are counted at once.
SLICE = 1 << 14


def shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's distinct shingles, in order of text and hash."""
    ws, we = block.words()
    h, n = block.hashes(ws, we), block.per_text(ws)
    doc = np.repeat(np.arange(block.n), n)
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < words))
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - words + 1), U64)
        for j in range(words):
            acc = mix(acc * U64(3) + h[j : len(h) - words + 1 + j]) if len(acc) else acc
        inside = doc[: len(acc)] == doc[words - 1 :] if len(acc) else np.zeros(0, bool)
        whole = np.zeros(len(short), U64)
        for j in range(words - 1):
            has = n[short] > j
            whole[has] = mix(whole[has] * U64(3) + h[first[short[has]] + j] + U64(1))
    of, key = np.concatenate([doc[: len(acc)][inside], short]), np.concatenate([acc[inside], whole])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return of[at], key[at], np.diff(np.append(at, len(of)))


def _sketch(docs: DataFrame, weighted: bool) -> DataFrame:
    """id, two fingerprints of the shingle set, its size (or weight) and the band keys; a text without words has those of its bytes and no band, a null text no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in slices(batch, "text", 1 << 20):
                of, key, count = shingles(block)
                present = np.unique(of)
                blank = np.setdiff1d(np.flatnonzero(np.asarray(rows.column("text").is_valid())), present)
                if len(blank):
                    start, end = block.off[blank], block.off[blank + 1]
                    own = np.zeros(len(blank), U64)
                    own[end > start] = block.hashes(start[end > start], end[end > start])
                    with np.errstate(over="ignore"):
                        prints = [mix(own + U64(s)).view(np.int64) for s in (1, 2)]
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(blank) + 1), pa.int32()), pa.array([], pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(blank)), pa.array(prints[0]), pa.array(prints[1]), pa.array(np.zeros(len(blank), np.int64)), none], names)
                if not len(present):
                    continue
                with np.errstate(over="ignore"):
                    base = mix(key + count.astype(U64)) if weighted else key
                    start = np.searchsorted(of, present)
                    prints = [np.add.reduceat(mix(base + U64(s)), start).view(np.int64) for s in (1, 2)]
                weight = count.astype(float) if weighted else np.ones(len(of))
                b = bands(signatures(np.searchsorted(present, of), key, weight, len(present), K), ROWS).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, b.shape[1]), pa.int32()), pa.array(b.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(present)), pa.array(prints[0]), pa.array(prints[1]), pa.array(np.add.reduceat(weight, start).astype(np.int64)), flat], names)

    names = ["id", "f1", "f2", "size", "bands"]
    return docs.mapInArrow(run, "id bigint, f1 bigint, f2 bigint, size bigint, bands array<bigint>")


def _compared(docs: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """The rows of ``wanted`` (id and others) with the sorted shingle hashes of the id's texts (and, if weighted, their counts), a row a text."""
    others = [c for c in wanted.columns if c != "id"]
    some = runtime.possible(docs, wanted, "id").join(wanted.hint("merge"), "id").select("text", "id", *others)  # both sides grow with the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in slices(batch, "text"):
                of, key, count = shingles(block)
                off = np.searchsorted(of, np.arange(block.n + 1)) * 8
                pack = lambda x: pa.Array.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pack(key), *([pack(count.astype(np.int64))] if weighted else [])], ["id", *others, "keys"] + ["counts"] * weighted)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields[1:])
    return some.mapInArrow(run, schema + ", keys binary" + ", counts binary" * weighted)


def _similarity(ka: np.ndarray, ca: np.ndarray, kb: np.ndarray, cb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    hit = np.flatnonzero(kb[at] == ka) if len(kb) else np.zeros(0, np.int64)
    shared = np.minimum(ca[hit], cb[at[hit]]).sum()
    return float(shared / max(ca.sum() + cb.sum() - shared, 1))


def _set(keys: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(keys, U64)
    return keys, np.ones(len(keys), np.int64) if counts is None else np.frombuffer(counts, np.int64)


def _verified(members: DataFrame, docs: DataFrame, threshold: float, weighted: bool, total: int) -> DataFrame:
    """The pairs (a, b) of a hub and a member whose sets are at least that similar; ``members``: hub, id, size, ``total`` at least."""
    parts = members.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / HUB_CHUNK).cast("bigint").alias("chunks"))
    parts = runtime.materialize(parts, "parts")
    own = parts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = runtime.join_hot(members, parts.select("hub", "chunks", "n"), ["hub"], "n", total)
    dealt = dealt.select("id", "hub", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"))
    sets = _compared(docs, runtime.materialize(dealt.union(own), "dealt"), weighted)

    def run(t: pa.Table) -> pa.Table:
        give_back(t.nbytes)
        hub = t.column("hub")[0].as_py()
        rows = list(zip(t.column("id").to_pylist(), *(t.column(c).to_pylist() if c in t.column_names else [None] * t.num_rows for c in ("keys", "counts")), strict=True))
        hubs = [_set(k, c) for i, k, c in rows if i == hub]
        found = [i for i, k, c in rows if i != hub and any(_similarity(*_set(k, c), *h) >= threshold for h in hubs)]
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return sets.groupBy("hub", "chunk").applyInArrow(run, "a bigint, b bigint")


def _shared(sides: tuple[list[dict], list[dict]]) -> np.ndarray:
    """How many shingles each document of the one side has in common with each of the other."""
    key = [np.concatenate([np.frombuffer(m["keys"], U64) for m in x]) for x in sides]
    row = [np.repeat(np.arange(len(x)), [len(m["keys"]) // 8 for m in x]) for x in sides]
    common = np.intersect1d(*key)
    out = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for a in range(0, len(common), SLICE):
        some, grid = common[a : a + SLICE], []
        for k, r, x in zip(key, row, sides, strict=True):
            at = np.minimum(np.searchsorted(some, k), len(some) - 1)
            hit = some[at] == k
            g = np.zeros((len(x), len(some)), np.float32)
            g[r[hit], at[hit]] = 1
            grid.append(g)
        out += grid[0] @ grid[1].T
    return out


def _block_links(members_a: list[dict], members_b: list[dict], threshold: float, weighted: bool) -> Iterator[tuple[int, int]]:
    """Links between two blocks that join different components, one for each pair of components at most."""
    shared = _shared((members_a, members_b))
    size = [np.array([len(m["keys"]) // 8 for m in x], np.float32) for x in (members_a, members_b)]
    like = shared / np.maximum(size[0][:, None] + size[1][None, :] - shared, 1)
    if weighted:  # whatever the sets are like, no pair is more similar than its smaller total weight over the larger
        total = [np.array([np.frombuffer(m["counts"], np.int64).sum() for m in x], float) for x in (members_a, members_b)]
        bound = np.minimum(total[0][:, None], total[1][None, :]) / np.maximum(np.maximum(total[0][:, None], total[1][None, :]), 1)
        like = np.where(shared > 0, bound, 0)
    for i, j in zip(*np.nonzero(like >= threshold - 1e-4), strict=True):
        a, b = members_a[i], members_b[j]
        if a["component"] == b["component"]:
            continue
        if _similarity(*_set(a["keys"], a["counts"] if weighted else None), *_set(b["keys"], b["counts"] if weighted else None)) < threshold:
            continue
        yield a["id"], b["id"]
        old, new = a["component"], b["component"]
        for m in (*members_a, *members_b):
            if m["component"] == old:
                m["component"] = new


def _crossed(groups: DataFrame, docs: DataFrame, threshold: float, weighted: bool, total: int) -> DataFrame:
    """Links between components of one group; ``groups``: key, id, size, component, outside (of the hub's component), ``total`` rows."""
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / CHUNK), F.lit(1)).cast("bigint")
    out = lambda c: F.sum(F.when(F.col("outside"), c).otherwise(0))
    mark = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)]
    split = groups.groupBy("key").agg(F.count("*").alias("n"), blocks(F.count("*"), F.sum("size")).alias("right"), blocks(out(F.lit(1)), out(F.col("size"))).alias("left"), out(F.lit(1)).alias("n_out"), *mark)
    split = split.where("n_out > 0").groupBy("n", "m1", "m2").agg(F.min(F.struct("key", "left", "right")).alias("g"))  # groups of the same documents: once
    split = runtime.materialize(split.select("g.key", "g.left", "g.right", "n"), "split")
    rows = runtime.join_hot(groups, split, ["key"], "n", total)
    rows = rows.withColumn("lb", F.pmod(F.xxhash64("id", F.lit(1)), "left")).withColumn("rb", F.pmod(F.xxhash64("id", F.lit(2)), "right"))
    as_left = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("right") - 1), lambda r: F.col("lb") * F.col("right") + r)).otherwise(F.array().cast("array<bigint>"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("left") - 1), lambda x: x * F.col("right") + F.col("rb"))
    cells = rows.withColumn("cell", F.explode(F.array_distinct(F.concat(as_left, as_right))))
    cells = cells.select("id", "key", "cell", "component", (F.col("outside") & F.expr("cell div right = lb")).alias("is_left"), F.expr("cell % right = rb").alias("is_right"))
    sets = _compared(docs, runtime.materialize(cells, "cells"), weighted)

    def run(t: pa.Table) -> pa.Table:
        give_back(t.nbytes)
        rows = t.to_pylist()
        a, b = [r for r in rows if r["is_left"]], [r for r in rows if r["is_right"]]
        links = list(_block_links(a, b, threshold, weighted)) if a and b else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return sets.groupBy("key", "cell").applyInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text", weighted: bool = False) -> DataFrame:
    """doc_id and class_id (the least doc_id of its near-duplicate class) for each row of ``docs``.

    Similarity is Jaccard's over distinct five-word shingles, or (weighted) over their counts. Of texts without
    a word, equal ones (empty or blank) are one class, null ones classes of their own; a row with a null id has a null class; rows that
    share an id are one document, with the links of each of their sets. Ids are integers. An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    since = runtime.mark()
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    known = rows.where("id is not null")
    sketch = runtime.materialize(_sketch(known, weighted), "sketch")
    n_rows = sketch.count()
    blank = sketch.where("size = 0").join(sketch.where("size > 0").select("id"), "id", "left_anti")  # an id with words is no blank document
    blank = blank.groupBy("id").agg(F.min(F.struct("f1", "f2", "size", "bands")).alias("s")).select("id", "s.*")
    nodes = sketch.where("size > 0").union(runtime.materialize(blank, "blank"))
    first = nodes.groupBy("f1", "f2").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.first(F.struct("bands", "size")).alias("s"))  # equal sets have equal bands
    heads = runtime.materialize(first.select("f1", "f2", "head", "n", "s.bands", "s.size"), "heads")
    same = runtime.join_hot(nodes.select("id", "f1", "f2"), heads.where("n > 1").select("f1", "f2", "head", "n"), ["f1", "f2"], "n", n_rows).select(F.col("id").alias("a"), F.col("head").alias("b"))
    keyed = heads.select(F.col("head").alias("id"), "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = runtime.materialize(runtime.join_hot(keyed, shared, ["key"], "n", 25 * n_rows), "groups")
    n_groups = groups.count()
    degree = groups.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = groups.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("h"), F.count("*").alias("n")).select("key", (-F.col("h.minus")).alias("hub"), "n")
    hubs = runtime.materialize(hubs, "hubs")
    member_of = runtime.materialize(runtime.join_hot(groups.select("key", "id", "size"), hubs, ["key"], "n", n_groups).select("key", "id", "size", "hub"), "members")
    pairs = runtime.materialize(member_of.where("id <> hub").groupBy("hub", "id").agg(F.max("size").alias("size")), "pairs")
    links = runtime.materialize(_verified(pairs, known, threshold, weighted, n_groups), "links")
    found = components(links, "star")
    homes = hubs.join(found.select(F.col("id").alias("hub"), "component"), "hub", "left").select("key", F.coalesce("component", "hub").alias("home"), "n")
    placed = member_of.select("key", "id", "size").join(found, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    placed = runtime.join_hot(placed, homes, ["key"], "n", n_groups).select("key", "id", "size", "component", (F.col("component") != F.col("home")).alias("outside"))
    more = runtime.materialize(_crossed(runtime.materialize(placed, "placed"), known, threshold, weighted, n_groups), "more")
    every = components(links.union(more.select("a", "b")).union(same.where("a <> b")), "classes")
    runtime.discard(spark, since=since, keep=1)
    out = rows.select("id").join(every, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("class_id"))
