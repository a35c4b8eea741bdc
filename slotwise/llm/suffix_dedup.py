"""Exact removal of repeated passages: longest-previous-factor arrays over the places where a repeat can be.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. All work is in
blocks of documents (by a hash of the id); texts are shuffled once, by block.

1. Each 50-byte window is named by the least hash of its 24-byte strings, a function of the window alone:
   equal windows have equal names, wherever they are. Neighbouring windows of one name form a run. The names
   of each block, once each, are dealt out by name.
2. Names that occur in one document only are done with. The others are sent back to their blocks.
3. Blocks send the runs of those names (text of the run; equal runs once a block, with the least id), again
   by name. What was common within a block is thus joined before it moves, so a passage that a third of
   all documents share is one row a block. Names in more than ``HOT_BLOCKS`` blocks are dealt window by window.
4. The runs of a name are texts in which only windows start. Their suffixes are sorted; the common prefixes of
   neighbours and the previous and next smaller owners in that order give each window its longest previous
   factor: the longest string from there on, within the run, that also starts in a run of a smaller id. Where
   it has 50 bytes or more the window goes; the places of such windows go back to the blocks.
5. Blocks do the same among their own runs (step 4 has seen equal runs of a block once), unite the windows of each
   text to spans and drop the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import _BYTE, U64, Block, give_back, mix, of_array

LENGTH, GRAM = 50, 24
#: Most documents and (about) bytes of a block, bytes of text for each bucket of names, and windows sorted at once.
BLOCK_DOCS, BLOCK_BYTES, BUCKET_BYTES, WINDOWS = 512, 1 << 20, 16 << 20, 200_000
#: Names that more blocks share are dealt window by window.
HOT_BLOCKS = 4096
PIECE = 1 << 21
_NAME = U64(0xFFFFFFFFFFFF0000)
_R = U64(0x9E3779B97F4A7C15)


def _inverse(r: int) -> int:
    return pow(r, -1, 1 << 64)


_RI = U64(_inverse(int(_R)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0][0]) < n + 1:
        size = max(n + 1, PIECE + 4096)
        with np.errstate(over="ignore"):
            _powers[0] = tuple(np.cumprod(np.append(U64(1), np.full(size - 1, b, U64))) for b in (_R, _RI))
    return _powers[0]


class Runs:
    """The runs of windows of some texts: text number, first window, number of windows, name, hash of the run's bytes."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray, name: np.ndarray, key: np.ndarray):
        self.doc, self.start, self.n, self.name, self.key = doc, start, n, name, key

    def pick(self, at: np.ndarray) -> Runs:
        return Runs(self.doc[at], self.start[at], self.n[at], self.name[at], self.key[at])

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        empty = Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64)))
        return Runs(*(np.concatenate([getattr(p, f) for p in [empty, *parts]]) for f in ("doc", "start", "n", "name", "key")))


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, text numbers, first byte of each in the piece) over the bytes; a text that is cut overlaps by LENGTH - 1."""
    k, n = 0, len(off) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(off, off[k] + PIECE, "right")) - 1)
        if j > k + 1 or off[k + 1] - off[k] <= PIECE:
            yield int(off[k]), int(off[j]), np.arange(k, j), off[k:j] - off[k]
        else:
            at = int(off[k])
            while at + LENGTH <= off[k + 1]:
                to = min(at + PIECE, int(off[k + 1]))
                yield at, to, np.array([k]), np.zeros(1, np.int64)
                at = to - LENGTH + 1
        k = j


def _sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _power(len(buf))
    s = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=s[1:])
    return s


def _span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(s))
    with np.errstate(over="ignore"):
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64))


def runs_of(block: Block) -> Runs:
    """All runs of a block, in order."""
    out = []
    for a, b, docs, first in _pieces(block.off):
        buf = block.buf[a:b]
        n = len(buf) - LENGTH + 1
        if n < 1:
            continue
        s = _sums(buf)
        _, down = _power(len(buf))
        m = len(buf) - GRAM + 1
        with np.errstate(over="ignore"):
            h = mix((s[GRAM:] - s[:m]) * down[:m]) & _NAME
        width, have = LENGTH - GRAM + 1, 1
        while 2 * have <= width:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        name = np.minimum(h[:n], h[width - have : width - have + n])
        bounds = np.append(first, len(buf))
        doc_at = np.repeat(np.arange(len(docs)), np.diff(bounds))[:n]
        inside = np.arange(n) + LENGTH <= bounds[doc_at + 1]
        new = np.ones(n, bool)
        new[1:] = (name[1:] != name[:-1]) | (doc_at[1:] != doc_at[:-1])
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        new[at[0]] = True
        edge = np.append(at[new[at]], -1)[:-1]
        count = np.diff(np.append(np.flatnonzero(new[at]), len(at)))
        out.append(Runs(docs[doc_at[edge]], edge + a - block.off[docs[doc_at[edge]]], count, name[edge], _span_hash(s, edge, edge + count + LENGTH - 1)))
    return Runs.joined(out)


def _narrow(names: np.ndarray) -> bytes:
    """The six high bytes of each name."""
    return names.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(U64)


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: equal high bytes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _loosened(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deal(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, bounds of the buckets in it)."""
    of = (mix(names) % U64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_NAMES = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
_BACK = pa.schema([("g", pa.int64()), ("names", pa.binary()), ("hot", pa.binary())])
_TEXTS = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("name", pa.binary()), ("key", pa.binary()), ("id", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
_FOUND = pa.schema([("g", pa.int64()), ("name", pa.binary()), ("key", pa.binary()), ("size", pa.binary()), ("mask", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _names_of(block: Block, ids: np.ndarray, g: int, buckets: int) -> list[tuple]:
    """Step 1 for one block."""
    r = runs_of(block)
    if not len(r.name):
        return []
    order = np.lexsort((ids[r.doc], r.name))
    name, who = r.name[order], ids[r.doc][order]
    at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    more = who[at] != who[np.append(at[1:], len(name)) - 1]
    name = name[at]
    order, bounds = _deal(name, buckets)
    name, more = name[order], more[order]
    return [(b, g, _narrow(name[x:y][~more[x:y]]), _narrow(name[x:y][more[x:y]])) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]


def _common(rows: list[tuple[int, bytes, bytes]], hot_blocks: int) -> list[tuple]:
    """Step 2 for the names of one partition: (g, once, more) in, (g, names, hot names) out."""
    parts = [(_wide(once), _wide(more)) for _, once, more in rows]
    names = np.concatenate([x for p in parts for x in p])
    sure = np.concatenate([np.full(len(x), k) for p in parts for k, x in enumerate(p)]).astype(bool)
    of = np.concatenate([np.full(len(p[0]) + len(p[1]), g) for p, (g, _, _) in zip(parts, rows, strict=True)])
    order = np.argsort(names, kind="stable")
    names, sure, of = names[order], sure[order], of[order]
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    size = np.diff(np.append(at, len(names)))
    group = np.repeat(np.arange(len(at)), size)
    keep = (size > 1)[group] | sure
    hot = (size > hot_blocks)[group]
    names, of, hot = names[keep], of[keep], hot[keep]
    order = np.argsort(of, kind="stable")
    names, of, hot = names[order], of[order], hot[order]
    cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
    return [(int(of[x]), _narrow(names[x:y][~hot[x:y]]), _narrow(names[x:y][hot[x:y]])) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _windows(block: Block, r: Runs) -> Runs:
    """The runs window by window; the key is the window's hash."""
    doc, start = np.repeat(r.doc, r.n), np.repeat(r.start, r.n) + np.arange(int(r.n.sum())) - np.repeat(np.cumsum(r.n) - r.n, r.n)
    key = np.zeros(len(doc), U64)
    where = block.off[doc] + start
    for a in range(0, len(where), 1 << 16):
        w = where[a : a + (1 << 16)]
        grid = block.buf[w[:, None] + np.arange(LENGTH)]
        up, _ = _power(LENGTH)
        with np.errstate(over="ignore"):
            key[a : a + len(w)] = mix((_BYTE[grid] * up[:LENGTH]).sum(1, dtype=U64) + U64(LENGTH))
    return Runs(doc, start, np.ones(len(doc), np.int64), np.repeat(r.name, r.n), key)


def _texts_of(block: Block, ids: np.ndarray, g: int, names: np.ndarray, hot: np.ndarray, buckets: int) -> list[tuple]:
    """Step 3 for one block: its runs of the names, equal ones once with the least id."""
    every, out = runs_of(block), []
    for is_hot, wanted in ((False, names), (True, hot)):
        r = every.pick(np.flatnonzero(np.isin(every.name, wanted)))
        if is_hot and len(r.name):
            r = _windows(block, r)
        if not len(r.name):
            continue
        who = ids[r.doc]
        order = np.lexsort((who, r.n, r.key))
        r, who = r.pick(order), who[order]
        at = np.flatnonzero(np.append(True, (r.key[1:] != r.key[:-1]) | (r.n[1:] != r.n[:-1])))
        r, who = r.pick(at), who[at]
        order, bounds = _deal(r.key if is_hot else r.name, buckets)
        r, who = r.pick(order), who[order]
        body, end = _bodies(block.buf, block.off[r.doc] + r.start, r.n)
        press = zstandard.ZstdCompressor(level=3)
        out += [(b, g, _squeezed(r.name[x:y]), _squeezed(r.key[x:y]), _squeezed(who[x:y]), _squeezed(r.n[x:y].astype(np.int32)), press.compress(body[end[x] : end[y]].tobytes())) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
    return out


def _bodies(buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs (first byte, number of windows) one after another, and where each starts (and the last ends)."""
    size = n + LENGTH - 1
    where = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return buf[where], np.append(0, np.cumsum(size))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each number; equal numbers have equal ranks."""
    order = np.argsort(keys)
    new = np.append(False, keys[order][1:] != keys[order][:-1])
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _window_ranks(buf: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The rank of each window (first byte in ``buf``) by its bytes. Windows of one hash are ranked once, if they are equal indeed."""
    grid = lambda at: buf[at[:, None] + np.arange(LENGTH)]
    key = _span_hash(_sums(buf), where, where + LENGTH)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    for a in range(0, len(where), 1 << 16):
        one = where[first[number[a : a + (1 << 16)]]]
        other = np.flatnonzero(one != where[a : a + (1 << 16)])
        if len(other) and (grid(one[other]) != grid(where[a : a + (1 << 16)][other])).any():
            first, number = np.arange(len(where)), np.arange(len(where))  # a collision of hashes
            break
    words = np.zeros((len(first), -(-LENGTH // 8) * 8), np.uint8)
    for a in range(0, len(first), 1 << 16):
        words[a : a + (1 << 16), :LENGTH] = grid(where[first[a : a + (1 << 16)]])
    columns = words.view(">u8").T
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank[number]


def _like(body: np.ndarray, end: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each text the first of those equal to it, byte for byte, which has their least owner."""
    key = _span_hash(_sums(body), end[:-1], end[1:])
    order = np.lexsort((owner, n, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (n[order][1:] != n[order][:-1]))
    first = np.empty(len(n), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    copies = np.flatnonzero(first != np.arange(len(n)))
    size = np.diff(end)[copies]
    if len(copies):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = body[np.repeat(end[copies], size) + within] == body[np.repeat(end[first[copies]], size) + within]
        unlike = copies[~np.logical_and.reduceat(same, np.cumsum(size) - size)]
        first[unlike] = unlike  # a collision of hashes
    return first


def longest_previous_factor(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, owner: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each window of each run (first byte in ``buf``, windows, owner) the length of its longest previous factor.

    That is the longest string that starts there, ends in the run, and also starts in a run of a smaller owner;
    0 where it is shorter than a window. Equal runs have equal suffixes, so one of them, with the least owner, is
    sorted for all: those of greater owners have their whole rest before them. ``group`` tells runs apart that are
    known to have no window in common.
    """
    if not len(n):
        return np.zeros(0, np.int64)
    body, end = _bodies(buf, begin, n)
    first = _like(body, end, n, owner)
    own = np.flatnonzero(first == np.arange(len(n)))
    if group is not None:
        _, of = np.unique(group[own], return_inverse=True)
        own = own[np.bincount(of)[of] > 1]  # a run alone in its group meets no other
    lengths = _sorted_factors(body, end[:-1][own], n[own], owner[own])
    at = np.cumsum(n[own]) - n[own]
    place = np.full(len(n), -1)
    place[own] = at
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    from_ = np.repeat(place[first], n)
    out = np.where(from_ >= 0, np.append(lengths, 0)[np.where(from_ >= 0, from_ + within, -1)], 0)
    return np.where(np.repeat(owner > owner[first], n), np.repeat(n, n) - within + LENGTH - 1, out)


def _sorted_factors(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``longest_previous_factor`` by suffix order.

    Windows are ranked by their bytes, and their suffixes by the ranks of windows that follow one another, twice as
    many at each step; the ranks of all steps also give the common prefix of neighbours. The previous and the next
    smaller owner in suffix order are found by jumping over neighbours that are not smaller, which carries the least
    common prefix on the way.
    """
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = (np.arange(total) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    left = (n[run] - at).astype(np.int32)  # windows from here to the run's end
    levels = [_window_ranks(buf, begin[run] + at)]
    far = 1
    while far < left.max() and levels[-1].max() + 1 < total:
        pair = levels[-1].astype(U64) << U64(32)
        has = np.flatnonzero(left > far)
        pair[has] += (levels[-1][has + far] + 1).astype(U64)
        levels.append(_ranks(pair))
        far *= 2
    order = np.argsort(levels[-1], kind="stable")
    # windows that neighbours have in common, from the longest step down
    a, b, same = order[:-1].copy(), order[1:].copy(), np.zeros(total + 1, np.int32)
    room = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = np.flatnonzero(room >= step)
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]  # equal ranks of a step mean as many equal windows, where both have them
        same[1:-1][ok] += step
        room[ok] -= step
        more = ok[room[ok] > 0]
        a[more] += step
        b[more] += step
    who, best = owner[run][order], np.zeros(total, np.int32)
    for step in (-1, 1):
        to = np.arange(total) + step
        low = (same[:-1] if step < 0 else same[1:]).copy()
        while True:
            look = np.flatnonzero(low > 0)
            pass_ = look[who[to[look]] >= who[look]]
            if not len(pass_):
                break
            beyond = to[pass_]
            low[pass_], to[pass_] = np.minimum(low[pass_], low[beyond]), to[beyond]
        best = np.maximum(best, low)
    out = np.empty(total, np.int64)
    out[order] = np.where(best > 0, best + LENGTH - 1, 0)
    return out


def _factors(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, name: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, factor lengths of their windows) over the runs whose name has several owners, whole names at once."""
    order = np.lexsort((owner, name))
    first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    several = owner[order][first] != owner[order][first + size - 1] if len(order) else np.zeros(0, bool)
    first, size = first[several], size[several]
    until = np.append(0, np.cumsum(n[order]))
    windows = until[first + size] - until[first]
    total, x = np.append(0, np.cumsum(windows)), 0
    while x < len(first):
        y = max(x + 1, int(np.searchsorted(total, total[x] + WINDOWS, "right")) - 1)
        some = order[np.repeat(first[x:y], size[x:y]) + np.arange(int(size[x:y].sum())) - np.repeat(np.cumsum(size[x:y]) - size[x:y], size[x:y])]
        yield some, longest_previous_factor(buf, begin[some], n[some], owner[some], name[some])
        x = y


def _judge(rows: list[tuple]) -> list[tuple]:
    """Step 4 for the runs of one bucket: rows of ``_TEXTS`` in, of ``_FOUND`` out."""
    arrays: dict[str, list[np.ndarray]] = {k: [] for k in ("g", "name", "key", "id", "n", "body")}
    loose = zstandard.ZstdDecompressor()
    for _, g, name, key, who, size, body in rows:
        name = _loosened(name, U64)
        for k, v in (("g", np.full(len(name), g)), ("name", name), ("key", _loosened(key, U64)), ("id", _loosened(who, np.int64)), ("n", _loosened(size, np.int32)), ("body", np.frombuffer(loose.decompress(body), np.uint8))):
            arrays[k].append(v)
    g, name, key, who, n, body = (np.concatenate(arrays[k]) for k in arrays)
    n = n.astype(np.int64)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    runs, masks = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for some, length in _factors(body, begin, n, name, who):
        goes = length >= LENGTH
        any_ = np.logical_or.reduceat(goes, np.cumsum(n[some]) - n[some])
        runs.append(some[any_])
        masks.append(goes[np.repeat(any_, n[some])])
    run, mask = np.concatenate(runs), np.concatenate(masks)
    begin = np.cumsum(n[run]) - n[run]
    order = np.argsort(g[run], kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, g[run][order][1:] != g[run][order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    out, press = [], zstandard.ZstdCompressor(level=1)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        some = order[x:y]
        size = n[run[some]]
        at = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out.append((int(g[run[some[0]]]), _squeezed(name[run[some]]), _squeezed(key[run[some]]), _squeezed(size.astype(np.int32)), press.compress(np.packbits(mask[at]).tobytes())))
    return out


def _flagged(block: Block, ids: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Step 5: (text number, first byte) of every window of a block that an earlier document has."""
    r = runs_of(block)
    docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some, length in _factors(block.buf, block.off[r.doc] + r.start, r.n, r.name, ids[r.doc]):
        run = np.repeat(some, r.n[some])
        at = r.start[run] + np.arange(len(run)) - np.repeat(np.cumsum(r.n[some]) - r.n[some], r.n[some])
        goes = length >= LENGTH
        docs.append(r.doc[run][goes])
        starts.append(at[goes])
    if found:
        press = zstandard.ZstdDecompressor()
        name, key, size = (np.concatenate([_loosened(f[k], t) for f in found]) for k, t in ((1, U64), (2, U64), (3, np.int32)))
        size = size.astype(np.int64)
        mask = np.concatenate([np.unpackbits(np.frombuffer(press.decompress(f[4]), np.uint8), count=int(_loosened(f[3], np.int32).sum())) for f in found]).astype(bool)
        where = np.cumsum(size) - size
        single = np.flatnonzero(size == 1)  # a run of one window, or a window of a hot run
        hot = _windows(block, r.pick(np.flatnonzero(np.isin(r.name, name[single]) & (r.n > 1))))
        order = np.lexsort((size, key))
        key, size, where = key[order], size[order], where[order]
        for x in (r, hot):
            if not len(x.key):
                continue
            at = np.searchsorted(key, x.key)  # the sizes of one key: few, as it is a hash of the run
            for _ in range(int(np.bincount(np.unique(key, return_inverse=True)[1]).max())):
                near = np.minimum(at, len(key) - 1)
                hit = np.flatnonzero((at < len(key)) & (key[near] == x.key) & (size[near] == x.n))
                n = x.n[hit]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                goes = mask[np.repeat(where[near[hit]], n) + within]
                docs.append(np.repeat(x.doc[hit], n)[goes])
                starts.append((np.repeat(x.start[hit], n) + within)[goes])
                at = at + 1
    return np.concatenate(docs).astype(np.int64), np.concatenate(starts).astype(np.int64)


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """The union of the windows at these places."""
    s = np.unique(starts)
    if not len(s):
        return []
    new = np.flatnonzero(np.append(True, s[1:] > s[:-1] + LENGTH))
    return list(zip(s[new].tolist(), (s[np.append(new[1:], len(s)) - 1] + LENGTH).tolist(), strict=True))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and (with_text) spans and the bytes kept.

    Ids are integers. Null and empty texts lose nothing; a row with a null id neither gives nor loses; rows
    that share an id do not count as earlier than one another. An empty table gives none; other columns are
    not read. Bytes are removed without regard to characters, so the bytes kept need not be valid UTF-8.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    parts = runtime.tasks(spark)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    all_docs, all_bytes = rows.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(4 * parts, all_docs // block_docs, all_bytes // block_bytes)
    buckets = int(max(parts, all_bytes // BUCKET_BYTES))  # a partition each, so what a task holds does not grow
    placed = rows.where("id is not null").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).repartition(parts, "g")

    def one_block(t: pa.Table) -> tuple[np.ndarray, Block]:
        give_back(4 * t.nbytes)
        return t.column("id").to_numpy(), of_array(t.column("text"))

    def step1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            g, out = t.column("g").to_numpy(), []
            order = np.argsort(g, kind="stable")
            cut = np.append(np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])), len(g))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                ids, block = one_block(t.take(pa.array(order[a:b])))
                out += _names_of(block, ids, int(g[order[a]]), buckets)
            return _batch(_NAMES, out)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 64 << 20:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    def step2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        if rows:
            yield _batch(_BACK, _common(rows, hot_blocks))

    def step3(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _TEXTS)
        ids, block = one_block(left)
        names, hot = (np.concatenate([_wide(x) for x in right.column(c).to_pylist()]) for c in ("names", "hot"))
        return pa.Table.from_batches([_batch(_TEXTS, _texts_of(block, ids, left.column("g")[0].as_py(), names, hot, buckets))])

    def step4(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield _batch(_FOUND, _judge(rows))

    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())] * with_text)

    def step5(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], kept)
        ids, block = one_block(left)
        doc, start = _flagged(block, ids, list(zip(*(right.column(f.name).to_pylist() for f in _FOUND), strict=True)) if right.num_rows else [])
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[order], np.arange(block.n + 1))
        out = []
        for k in range(block.n):
            raw = block.buf[block.off[k] : block.off[k + 1]].tobytes()
            spans = _spans(start[order[at[k] : at[k + 1]]])
            if spans:
                bounds = [0, *(x for s in spans for x in s), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            else:
                rest = raw
            out.append((int(ids[k]), len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *([spans, rest] if with_text else [])))
        return pa.Table.from_batches([_batch(kept, out)])

    names = placed.mapInArrow(step1, _ddl(_NAMES)).repartitionById(buckets, F.col("bucket")).mapInArrow(step2, _ddl(_BACK))
    texts = placed.groupBy("g").cogroup(names.groupBy("g")).applyInArrow(step3, _ddl(_TEXTS))
    found = texts.repartitionById(buckets, F.col("bucket")).mapInArrow(step4, _ddl(_FOUND))
    more = ", spans array<array<bigint>>, kept binary" if with_text else ""
    out = placed.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(step5, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + more)
    text = F.coalesce("text", F.lit(""))
    nobody = rows.where("id is null").select(F.col("id").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), *([F.array().cast("array<array<bigint>>").alias("spans"), text.cast("binary").alias("kept")] if with_text else []))
    return out.union(nobody)
