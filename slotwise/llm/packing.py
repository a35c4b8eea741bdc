"""Best-fit packing of token sequences with large-item matching.

Only the number of pieces of each length decides how they are packed, so the plan is made from a histogram
of at most ``capacity`` lengths, whatever the number of documents:

1. pieces above one third of the capacity (at most two fit in a sequence) are paired greedily: the longest
   left takes the longest partner that fits. That yields as many pairs as possible;
2. shorter pieces, longest first, go each into the fullest sequence that still has room (best fit), new
   sequences opening only where none has.

The plan is a list of patterns (lengths, how many sequences follow it), bounded by the number of lengths.
Pieces then take the places of their length by rank, which Spark computes per (length, salt) group: a
length that a third of all pieces share is spread over the salts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import slices
from slotwise.llm.token_counts import encoder

#: A length's pieces are ranked in groups of at most this part of a task's fair share.
SALT_SHARE = 4
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as token sequences cut to ``capacity``: doc_id, piece, start, length, ids_crc32, row_key.

    A document is its ids and then ``end_id``; null and empty texts are just that. ``row_key`` tells equal ids
    (repeated rows, null ids) apart: partition and row within the scan's order.
    """
    runtime.ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for rows, block in slices(batch, "text"):
                ids, off = e.encode(block)
                row, number, start, length, crc = [], [], [], [], []
                for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        row.append(r), number.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                keep = rows.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(2), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row_key"))
    return rows.mapInArrow(run, f"doc_id {id_type}, row_key bigint, {PIECE}")


class _Gaps:
    """Open sequences by the room they have: room -> groups of (pattern, how many)."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, pattern: tuple[int, ...], count: int) -> None:
        if not self.by[room]:
            insort(self.rooms, room)
        self.by[room].append((pattern, count))

    def take(self, size: int) -> tuple[int, tuple[int, ...], int] | None:
        """A group of the least room that holds ``size``."""
        k = bisect_left(self.rooms, size)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        pattern, count = self.by[room].pop()
        if not self.by[room]:
            self.rooms.pop(k)
        return room, pattern, count


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence in order, number of sequences) that place every piece of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece's length must be from 1 to the capacity")
    gaps = _Gaps()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            gaps.add(capacity - a, (a,), left[a])
            large.pop()
            continue
        b = large[k]
        if a == b:
            if left[a] > 1:
                gaps.add(capacity - 2 * a, (a, a), left[a] // 2)
            if left[a] % 2:  # the odd one takes the next shorter partner, if there is one
                left[a] = 1
                if k and (b := large[k - 1]):
                    gaps.add(capacity - a - b, (a, b), 1)
                    left[b] -= 1
                    if not left[b]:
                        large.remove(b)
                else:
                    gaps.add(capacity - a, (a,), 1)
            large.remove(a)
            continue
        n = min(left[a], left[b])
        gaps.add(capacity - a - b, (a, b), n)
        for x in (a, b):
            left[x] -= n
            if not left[x]:
                large.remove(x)
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[size]
        while n:
            room, pattern, count = gaps.take(size) or (capacity, (), -1)
            each = room // size
            used = -(-n // each) if count < 0 else min(count, -(-n // each))
            full = used if used * each <= n else used - 1
            if full:
                gaps.add(room - each * size, pattern + (size,) * each, full)
            n -= full * each
            if used > full:
                gaps.add(room - n * size, pattern + (size,) * n, 1)
                n = 0
            if count > used:
                gaps.add(room, pattern, count - used)
    return [g for room in sorted(gaps.by) for g in gaps.by[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its ranks' runs begin, and each run's first sequence, number of places a sequence, and offset.

    Neighbouring places of one length within a sequence form one run: rank r of it lies in sequence
    ``first + r // each`` at ``offset + (r % each) * length``.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        at = k = 0
        while k < len(pattern):
            size, each = pattern[k], 1
            while k + each < len(pattern) and pattern[k + each] == size:
                each += 1
            out[size].append((rank[size], sequence, each, at))
            rank[size] += each * count
            at += each * size
            k += each
        sequence += count
    return {size: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for size, runs in out.items()}


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` (with length, and doc_id, piece, row_key to order them) with sequence_id and offset.

    ``items`` must give the same rows each time it is read (a written table): it is read twice. Pieces of
    one length take its places in the order of (salt, row_key, piece). An empty table packs into nothing.
    """
    runtime.ship(items.sparkSession)
    counts = items.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in counts}
    where = places(plan(histogram, capacity))
    parts = SALT_SHARE * runtime.tasks(items.sparkSession)
    salts = {n: max(1, c * parts // sum(histogram.values())) for n, c in histogram.items()}
    if max(salts.values(), default=1) > 1:
        n_salts = F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), F.col("length"))
        salted = items.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece"), n_salts.cast("bigint")))
    else:
        salted = items.withColumn("salt", F.lit(0).cast("bigint"))
    first = salted.groupBy("length", "salt").count()
    first = first.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key", "piece"))
    ranked = salted.withColumn("own", own).join(first, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                begin, seq, each, off = where[int(size)]
                k = np.searchsorted(begin, rank[at], "right") - 1
                r = rank[at] - begin[k]
                sequence[at], offset[at] = seq[k] + r // each[k], off[k] + r % each[k] * size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema).drop("rank")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The texts are read and encoded once; the pieces are written to the shared folder and only they are
    shuffled. Every sequence holds at most ``capacity`` tokens, without gaps from offset 0. Null and empty
    texts give one piece of the end id, repeated rows a piece each; an empty table gives none.
    """
    made = runtime.materialize(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(made, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
