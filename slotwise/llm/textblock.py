"""Vectorised text work on Arrow string columns: byte buffers, words, lines and 64-bit hashes.

A block is a run of texts as one byte buffer with offsets. Everything here costs a fixed number of
numpy passes over the bytes; no Python object is made per word. Nulls are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a numpy pass then needs some tens of MB.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): one step of its public constants."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = stream(11, 256)
_place = stream(23, 4096) | U64(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers for the first n positions of a span; grown when a longer span comes."""
    global _place
    if len(_place) < n:
        _place = stream(23, max(n, 2 * len(_place))) | U64(1)
    return _place


class Block:
    """Texts as ``buf`` (uint8) with ``off`` (n + 1 offsets)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def spans(self, inside: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where ``inside``, cut at texts' bounds and where ``split[i]`` (before byte i)."""
        n = len(self.buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        np.not_equal(inside[1:], inside[:-1], out=cut[1:n])
        if split is not None:
            cut[1:n] |= split[1:]
        cut[self.off] = True
        at = np.flatnonzero(cut)
        keep = inside[at[:-1]]
        return at[:-1][keep], at[1:][keep]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of bytes other than space and 0x09-0x0D."""
        return self.spans(~_SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The \\n-split lines of each text, empty ones included (an empty text has one)."""
        nl = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.off[:-1], nl + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.off[1:], nl]), kind="stable")
        return starts, ends

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """How many of the (ascending, non-empty) spans each text has."""
        return np.diff(np.searchsorted(starts, self.off))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each non-empty span; spans ascend and do not overlap."""
        if not len(starts):
            return np.zeros(0, U64)
        lens = ends - starts
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        place = np.arange(total) - np.repeat(first, lens)
        with np.errstate(over="ignore"):
            if total == len(self.buf):
                v = _BYTE[self.buf]
            else:
                v = _BYTE[self.buf[place + np.repeat(starts, lens)]]
            v *= places(int(lens.max()))[place]
            return mix(np.add.reduceat(v, first) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))

    def text(self, a: int, b: int) -> str:
        return self.buf[a:b].tobytes().decode("utf-8", "replace")


def of_array(arr: pa.Array) -> Block:
    """A block over an Arrow string (or binary) array; nulls become empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not (wide or pa.types.is_string(arr.type) or pa.types.is_binary(arr.type)):
        arr = arr.cast(pa.large_string())
        wide = True
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return Block(data[off[0] : off[-1]], off - off[0])


#: Bytes that a worker handles before it gives memory that it no longer uses back to the machine.
HELD_BYTES = 8 << 20
_handled = 0
_libc = ctypes.CDLL(None)


def give_back(n: int) -> None:
    """Note ``n`` more bytes handled, and now and then return freed memory: workers live on between tasks, and several share an executor."""
    global _handled
    _handled += n
    if _handled > HELD_BYTES:
        _handled = 0
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The batch in runs of rows of about ``limit`` bytes of text, each with its block. A longer text stands alone."""
    give_back(batch.nbytes)
    whole = of_array(batch.column(column))
    at, n = 0, whole.n
    while at < n:
        to = max(at + 1, int(np.searchsorted(whole.off, whole.off[at] + limit, "right")) - 1)
        a, b = whole.off[at], whole.off[to]
        yield batch.slice(at, to - at), Block(whole.buf[a:b], whole.off[at : to + 1] - a)
        at = to


def blocks_of(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """(number of the first text, block) over runs of texts."""
    at = 0
    for rows, block in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), "text", limit):
        yield at, block
        at += rows.num_rows


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key earlier, has an equal key anywhere else) for each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    earlier, other = np.empty(len(k), bool), np.empty(len(k), bool)
    earlier[order] = same[:-1]
    other[order] = same[:-1] | same[1:]
    return earlier, other


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each pair of neighbouring offsets."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def same_bytes(buf: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, step: int = BLOCK_BYTES) -> np.ndarray:
    """Whether the non-empty spans a and b have the same bytes, pair by pair; about ``step`` bytes are compared at once."""
    size = a_end - a
    out = size == b_end - b
    todo = np.flatnonzero(out & (a != b))
    total, k = np.cumsum(size[todo]), 0
    while k < len(todo):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + step, "right")))
        some = todo[k:to]
        n = size[some]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        differ = buf[place + np.repeat(a[some], n)] != buf[place + np.repeat(b[some], n)]
        out[some] = np.add.reduceat(differ, first, dtype=np.int64) == 0
        k = to
    return out
