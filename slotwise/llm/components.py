"""Connected components of a graph given by its edges, without the graph ever meeting in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.runtime import discard, join_hot, mark, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id that ``edges`` (a, b) name; the component is its least id.

    Alternating large-star and small-star steps: each round points every node at the least of its
    neighbourhood, on edges pre-aggregated by node, until nothing changes; rounds grow with the logarithm
    of the largest component. Every round is a written table. Self-loops and nulls do not count.
    """
    spark, since = edges.sparkSession, mark()
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while True:
        n = 2 * state[0]
        # large star: neighbours above a node move to the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least, ["a"], "n", n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lower neighbours move to the least of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now, before = materialize(moved, name), state
        state = _state(now)
        if state == before:
            break
    discard(spark, since=since, keep=1)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of the (distinct) edges and two sums of their hashes: equal for equal sets of edges."""
    sums = [F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.select(F.count("*"), *sums).first())
