"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns (domain, language, source). A node's budget is its parent's, shared among
siblings by weight. A node can use no more than its tokens times ``max_epochs``; what it cannot use goes to
its siblings by their weights, and only what all of them cannot use leaves for the siblings of the parent. So
budgets are filled from the root down, each level by water-filling under the subtrees' capacities.

A leaf then gives whole epochs as far as its budget holds them, and of the next epoch the documents that
come first in that epoch's own order (a hash of id, seed and epoch) and fit. That prefix is the documents
whose hash does not exceed the leaf's cut, so no sort of a leaf is needed: token sums by hash range
find the range of the cut, those of its own ranges a finer one, and only the documents of that are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import slices
from slotwise.llm.token_counts import encoder

#: Hash ranges of a leaf and ranges within the one in which its budget ends (as powers of 2), and leaves of a tree (which the driver holds and broadcasts).
RANGE_BITS, MAX_LEAVES = (12, 12), 200_000

Path = tuple[str | None, ...]


def fill(budget: Fraction, children: dict[Path, tuple[Fraction, int]]) -> dict[Path, Fraction]:
    """Shares of ``budget`` for children of (weight, capacity): by weight, with what one cannot hold going to the others."""
    out = {c: Fraction(0) for c in children}
    open_ = {c: w for c, (w, cap) in children.items() if w > 0 and cap > 0}
    left = Fraction(budget)
    while open_ and left > 0:
        total = sum(open_.values())
        full = [c for c, w in open_.items() if left * w / total >= children[c][1]]
        if not full:
            for c, w in open_.items():
                out[c] = left * w / total
            break
        for c in full:
            out[c] = Fraction(children[c][1])
            left -= children[c][1]
            del open_[c]
    return out


def budgets(tokens: dict[Path, int], weights: dict[Path, float], total: int, max_epochs: int) -> dict[Path, int]:
    """Whole-token budgets of the leaves. ``weights`` has nodes by their path from the root; others weigh 1.

    A node can use what its children can that weigh more than 0: what lies below a weight of 0 is never given out, and nobody's share waits for it.
    """
    weigh = lambda node: Fraction(weights.get(node, 1)).limit_denominator(10**6)
    children: dict[Path, set[Path]] = {}
    for leaf in tokens:
        for k in range(1, len(leaf) + 1):
            children.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    capacity: dict[Path, int] = {leaf: n * max_epochs for leaf, n in tokens.items()}
    for node in sorted(children, key=len, reverse=True):
        capacity[node] = sum(capacity[c] for c in children[node] if weigh(c) > 0)
    out: dict[Path, int] = {}
    todo: list[tuple[Path, Fraction]] = [((), Fraction(min(total, capacity.get((), 0))))]
    while todo:
        node, budget = todo.pop()
        if node not in children:
            if node in tokens:
                out[node] = int(budget)
            continue
        below = {c: (weigh(c), capacity[c]) for c in children[node]}
        todo += fill(budget, below).items()
    return out


def checked(weights: dict[tuple, float], tokens: dict[Path, int], n_levels: int, unknown: str) -> dict[Path, float]:
    """The weights by paths of texts (a level's values are compared as texts, null is None). A path that is longer than the tree, a weight below 0 and, with ``unknown`` = ``error``, a path without a document raise."""
    out = {tuple(None if v is None else str(v) for v in path): w for path, w in weights.items()}
    known = {leaf[:k] for leaf in tokens for k in range(len(leaf) + 1)}
    for path, w in out.items():
        if not 1 <= len(path) <= n_levels or w < 0:
            raise ValueError(f"no weight of a tree of {n_levels} levels: {path}: {w}")
        if unknown == "error" and tokens and path not in known:
            raise ValueError(f"no document has the path {path}")
    return out


def counted(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens in place of the text."""
    runtime.ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            batch = batch.rename_columns([str(k) for k in range(batch.num_columns)])
            for rows, block in slices(batch, str(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(e.counts(block).astype(np.int64))], [*others, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + ", n_tokens bigint"
    return docs.select(*[f"`{c}`" for c in others], docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def order(id_col: Column, seed: int, epoch: Column) -> Column:
    """A document's place in an epoch's order."""
    return F.xxhash64(id_col, F.lit(seed).cast("bigint"), epoch.cast("bigint"))


def leaf_plan(sized: DataFrame, levels: dict[str, Column], weights: dict[Path, float], *, share: float, total: int | None, max_epochs: int, seed: int, id_col: str, unknown: str = "error") -> DataFrame:
    """(leaf, epochs, cut, budget): whole epochs of each leaf, and the last hash of the next epoch's prefix (null: none).

    ``sized`` must give the same rows each time it is read (a written table).
    """
    spark = sized.sparkSession
    leaf = leaf_of(levels)
    sums = sized.groupBy(leaf.alias("leaf"), *[c.cast("string").alias(n) for n, c in levels.items()]).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[n] for n in levels): int(r["n"] or 0) for r in sums}
    goal = int(share * sum(tokens.values())) if total is None else total
    given = budgets(tokens, checked(weights, tokens, len(levels), unknown), goal, max_epochs)
    rows = []
    for r in sums:
        path = tuple(r[n] for n in levels)
        whole = given[path] // tokens[path] if tokens[path] else 0
        rows.append((r["leaf"], whole, given[path] - whole * tokens[path], given[path]))
    plan = spark.createDataFrame(rows, "leaf string, epochs long, rest long, budget long")
    placed = sized.select(leaf.alias("leaf"), F.col(id_col).alias("id"), "n_tokens").join(F.broadcast(plan), "leaf").withColumn("h", order(F.col("id"), seed, F.col("epochs")))
    # the range of hashes in which the budget ends, and what is left for it; the ranges before fit whole. Then the same within that range, finer each time
    edge = plan.select("leaf", F.lit(0).cast("bigint").alias("range"), F.col("rest").alias("room"))
    bits = 0
    for more in RANGE_BITS:
        bits += more
        within = placed.withColumn("fine", _range(F.col("h"), bits)).withColumn("range", _range(F.col("h"), bits - more)).join(F.broadcast(edge), ["leaf", "range"])  # a row a leaf
        by_range = within.groupBy("leaf", "fine", "room").agg(F.sum("n_tokens").alias("n"))
        running = by_range.withColumn("end", F.sum("n").over(Window.partitionBy("leaf").orderBy("fine")))
        edge = running.where("end > room").groupBy("leaf").agg(F.min(F.struct("fine", (F.col("room") - F.col("end") + F.col("n")).alias("room"))).alias("e")).select("leaf", F.col("e.fine").alias("range"), "e.room")
        edge = runtime.materialize(edge, "mix-edge")
    within = placed.withColumn("range", _range(F.col("h"), bits)).join(F.broadcast(edge), ["leaf", "range"])  # a row a leaf
    fits = within.groupBy("leaf", "room", "h").agg(F.sum("n_tokens").alias("n")).withColumn("end", F.sum("n").over(Window.partitionBy("leaf").orderBy("h"))).where("end <= room").groupBy("leaf").agg(F.max("h").alias("last"))
    lowest = F.col("range") == 0  # no hash lies before the first range
    before = edge.select("leaf", "range", F.when(~lowest, F.shiftleft(F.col("range"), 64 - bits).bitwiseXOR(F.lit(-1 << 63))).alias("begins"))
    everything = F.lit((1 << 63) - 1)
    cut = F.when(F.col("rest") <= 0, None).when(F.col("range").isNull(), everything).otherwise(F.coalesce("last", F.col("begins") - 1))
    return plan.join(before, "leaf", "left").join(fits, "leaf", "left").select("leaf", "epochs", cut.alias("cut"), "budget")


def _range(h: Column, bits: int) -> Column:
    """The range of a hash, of 2 ** bits, in the order of (signed) hashes from 0 on."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-1 << 63)), 64 - bits) if bits else F.lit(0).cast("bigint")


def leaf_of(levels: dict[str, Column]) -> Column:
    """A leaf's name: its path as a JSON array, nulls and all."""
    return F.to_json(F.array(*[c.cast("string") for c in levels.values()]))


def select(docs: DataFrame, plan: DataFrame, levels: dict[str, Column], *, seed: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` as the plan takes them: a row for each epoch that has it, with ``epoch`` (from 0) beside its columns."""
    names = [f"`{c}`" for c in docs.columns]
    both = docs.withColumn("_leaf", leaf_of(levels)).join(F.broadcast(plan.select(F.col("leaf").alias("_leaf"), F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"))), "_leaf")  # at most MAX_LEAVES rows
    more = F.coalesce(order(F.col(id_col), seed, F.col("_epochs")) <= F.col("_cut"), F.lit(False))
    n = F.col("_epochs") + more.cast("long")
    return both.where(n > 0).select(*names, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("epoch"))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[Path, float], path: str, *, share: float = 0.75, total: int | None = None, max_epochs: int = 2, seed: int = 7, unknown: str = "error", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` mixed to the weights: rows of the selected documents, once an epoch, with ``epoch``.

    ``levels``: the tree from the root down, as columns by name; a null value is a node like any other. A weight of a path that
    no document has is an error, or (``unknown`` = ``ignore``) without effect.
    ``total`` tokens are to be given out, or ``share`` of what there is. A leaf never exceeds its budget; a
    document without tokens costs nothing and comes with the prefix. Rows of one id are taken together. Null
    and empty texts have no tokens. An empty table gives none. The name ``epoch`` must be free.
    """
    sized = runtime.materialize(counted(docs.select(docs[id_col].alias("_id"), *[c.alias(f"_{n}") for n, c in levels.items()], docs[text_col].alias("_text")), path, text_col="_text"), "sized")
    inner = {n: F.col(f"_{n}") for n in levels}
    plan = runtime.materialize(leaf_plan(sized, inner, weights, share=share, total=total, max_epochs=max_epochs, seed=seed, id_col="_id", unknown=unknown), "mix-plan")
    return select(docs, plan, levels, seed=seed, id_col=id_col)
