"""Periodic runs of words: maximal stretches that repeat a period at least four times, and texts without the repetitions.

For a period q let x match if the words at x and x + q are equal. A run of period q and length L >= 4 q is a maximal stretch
of L - q >= 3 q matches, so it holds a multiple of 3 q. The harmonic grid has these multiples for every period up to a quarter
of the text, about n ln(n) / 3 pairs of period and point. Where the words at a point match, the stretch around it
is found for all pairs at once: a binary search of the longest common extension to either side compares
prefix hashes (sums of word hashes times powers, modulo 2 ** 64). Hashes of equal words are equal, so an extension is
never too short; the words of each stretch are then compared byte by byte, and where one differs
the stretch is found anew, word by word. Stretches that several periods give (multiples of the least) keep the least.

All texts of a block are searched together; pairs go in groups of at most ``PAIRS``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import BLOCK_BYTES, U64, Block, same_bytes, slices

#: Pairs of period and grid point that are searched at once, and bytes of words that are compared at once.
PAIRS, COMPARED = 1 << 17, 1 << 20
#: A run has this many words at least, and this many periods.
LEAST, TIMES = 6, 4
#: The odd base of the prefix hashes.
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n - 1, modulo 2 ** 64."""
    out = np.ones(max(n, 1), U64)
    done, step = 1, _BASE
    while done < n:
        m = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + m] = out[:m] * U64(step)
        done, step = done + m, step * step % (1 << 64)
    return out


class Words:
    """The words of a block's texts: places of their bytes (``start``, ``end``), bounds of the texts in words (``off``), hashes."""

    def __init__(self, block: Block, start: np.ndarray, end: np.ndarray, off: np.ndarray, hashes: np.ndarray):
        self.buf, self.start, self.end, self.off, self.hashes = block.buf, start, end, off, hashes
        n = len(hashes)
        self.power = powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * self.power[:n], out=self.prefix[1:])

    def same(self, x: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of the ``length`` words from x and from x + q are equal."""
        with np.errstate(over="ignore"):
            left = (self.prefix[x + length] - self.prefix[x]) * self.power[q]
            return left == self.prefix[x + q + length] - self.prefix[x + q]

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the words x and y have the same bytes."""
        return same_bytes(self.buf, self.start[x], self.end[x], self.start[y], self.end[y], COMPARED)


def extend(words: Words, x: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of matches around each matching x: its first place, and the place after it. The text's words go from ``first`` to ``last``."""
    low, high = np.ones(len(x), np.int64), last - q - x + 1  # matches from x on: at least low, fewer than high
    while (wide := high - low > 1).any():
        middle = (low + high) >> 1
        ok = words.same(x, q, np.where(wide, middle, 1))
        low, high = np.where(wide & ok, middle, low), np.where(wide & ~ok, middle, high)
    end = x + low
    low, high = np.zeros(len(x), np.int64), x - first + 1  # matches before x
    while (wide := high - low > 1).any():
        middle = np.where(wide, (low + high) >> 1, 0)
        ok = words.same(x - middle, q, middle)
        low, high = np.where(wide & ok, middle, low), np.where(wide & ~ok, middle, high)
    return x - low, end


def grid(off: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, point) of the harmonic grid, in groups. Periods go up to a ``times``-th of the text, points lie as many words apart as a run has matches at least."""
    size = np.diff(off)
    periods = np.where(size >= least, size // times, 0)
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    # a run has max(least, times * period) - period matches in a row, so one of them is a multiple of that
    stride = np.maximum((times - 1) * period, least - period)
    points = (size[text] - period - 1) // stride + 1
    total, a = np.cumsum(points), 0
    while a < len(text):
        before = int(total[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        n = points[a:b]
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for c in range(0, len(number), PAIRS):  # one period of a long text may have more points
            k = np.repeat(np.arange(a, b), n)[c : c + PAIRS]
            yield text[k], period[k], off[text[k]] + number[c : c + PAIRS] * stride[k]
        a = b


def stretch_by_words(words: Words, x: int, q: int, first: int, last: int) -> tuple[int, int]:
    """As ``extend`` for one pair, word by word."""
    def ends(step: int, limit: int) -> int:
        at, n = x, 64
        while at != limit:
            some = np.arange(at, at + step * min(n, abs(limit - at)), step)
            ok = words.equal(some, some + q)
            if not ok.all():
                return at + step * int(np.argmin(ok))
            at, n = at + step * len(some), 2 * n
        return at

    return ends(-1, first - 1) + 1, ends(1, last - q)


def find_runs(words: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after it, least period) of every run, in the order of text, start and period."""
    found = [np.zeros((0, 4), np.int64)]
    for text, q, x in grid(words.off, least, times):
        ok = np.flatnonzero(words.hashes[x] == words.hashes[x + q])
        text, q, x = text[ok], q[ok], x[ok]
        first, last = words.off[text], words.off[text + 1]
        a, b = extend(words, x, q, first, last)
        length = b - a + q
        long = np.flatnonzero((length >= least) & (length >= times * q))
        found.append(distinct(np.stack([text[long], a[long], b[long] + q[long], q[long]], axis=1)))
    return verified(words, distinct(np.concatenate(found)), least, times)


def distinct(runs: np.ndarray) -> np.ndarray:
    """The rows (text, start, end, period) in order, each stretch once: with its least period, which divides the others."""
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 1:3] != runs[:-1, 1:3]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1]))]  # words of all texts are numbered together, so texts ascend


def verified(words: Words, runs: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """The runs whose words are as their hashes say; the texts of others are searched again with words in place of hashes."""
    wrong, a = np.zeros(len(runs), bool), 0
    total = np.cumsum(runs[:, 2] - runs[:, 1] - runs[:, 3])
    while a < len(runs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARED, "right")))
        n = runs[a:b, 2] - runs[a:b, 1] - runs[a:b, 3]
        x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - runs[a:b, 1], n)
        differ = ~words.equal(x, x + np.repeat(runs[a:b, 3], n))
        wrong[a:b] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) > 0
        a = b
    if wrong.any():
        bad = np.unique(runs[wrong, 0])
        runs = np.concatenate([runs[~np.isin(runs[:, 0], bad)], *[by_words(words, t, least, times) for t in bad.tolist()]])
        runs = distinct(runs)
    return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def by_words(words: Words, text: int, least: int, times: int) -> np.ndarray:
    """The runs of one text without hashes: for texts whose hashes agree where words do not."""
    a, b = int(words.off[text]), int(words.off[text + 1])
    found: dict[tuple[int, int], int] = {}
    for _, periods, points in grid(np.array([a, b]), least, times):
        match = words.equal(points, points + periods)
        for q, x in zip(periods[match].tolist(), points[match].tolist(), strict=True):
            start, end = stretch_by_words(words, x, q, a, b)
            if end - start + q >= max(least, times * q):
                found[start, end + q] = min(q, found.get((start, end + q), q))
    return np.array([(text, s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 4)


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def planted(key: str, n: int) -> tuple[int, int] | None:
    """(a, p) if the words i >= a of this key's text stand for the words a + (i - a) % p, else None."""
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def words_of(block: Block, keys: list[str] | None = None) -> Words:
    """The block's words; with ``keys`` (a text's id as a string) those of some texts repeat, see ``planted``."""
    start, end = block.words()
    off = np.searchsorted(start, block.off)
    hashes = block.hashes(start, end)
    if keys is not None:
        at = np.arange(len(start))
        for k, key in enumerate(keys):
            n = int(off[k + 1] - off[k])
            if key is not None and (found := planted(key, n)):
                a, p = found
                at[off[k] + a : off[k + 1]] = off[k] + a + np.arange(n - a) % p
        start, end, hashes = start[at], end[at], hashes[at]
    return Words(block, start, end, off, hashes)


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each text's kept words, a space after each."""
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, np.uint8)
    place = np.arange(to[-1]) - np.repeat(to[:-1], size)
    inside = place < np.repeat(size - 1, size)
    out[inside] = words.buf[(place + np.repeat(start, size))[inside]]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out, to[kept[words.off]]


_LONG, _TEXT = ("bigint", pa.int64()), ("string", pa.string())
FIELDS = {"n_words": _LONG, "n_runs": _LONG, "start": _LONG, "length": _LONG, "period": _LONG, "exponent_milli": _LONG, "runs_sha256": _TEXT, "collapsed_sha256": _TEXT, "n_dropped": _LONG}
_RUNS = ("array<struct<start: bigint, length: bigint, period: bigint>>", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))


def report(words: Words, least: int, times: int) -> list[list]:
    """A list for each of ``FIELDS``, with a value for each text."""
    text, start, end, period = find_runs(words, least, times)
    gone = dropped(len(words.start), start, end, period)
    buf, off = joined(words, ~gone)
    bounds = np.searchsorted(text, np.arange(len(words.off)))
    lost = np.concatenate([[0], np.cumsum(gone)])[words.off]
    out: list[list] = [[] for _ in range(9)]
    for k in range(len(words.off) - 1):
        a, b, first = int(bounds[k]), int(bounds[k + 1]), int(words.off[k])
        runs = list(zip((start[a:b] - first).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True))
        best = None
        for run in runs:  # by start and period, so the first of the greatest stays
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        kept = buf[off[k] : max(off[k], off[k + 1] - 1)]
        row = [int(words.off[k + 1]) - first, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
        row += [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), int(lost[k + 1] - lost[k])]
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def runs_of(docs: DataFrame, *, key_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_runs, the run of the greatest length / period (start, length, period, exponent_milli;
    null without a run; of equals the first by start, then by period), runs_sha256, collapsed_sha256 and n_dropped.

    Words are runs of anything but space and 0x09-0x0D. ``key_col``: rows whose key says so repeat words, see ``planted`` (null: none).
    A null or empty text has no word and no run; a null id stays null; repeated rows each give a row, an empty table none, other columns
    are not read. One pass, no shuffle. Memory follows the longest text (about 100 bytes a byte of it).
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    return _mapped(docs, key_col, id_col, text_col, FIELDS, lambda w: report(w, least, times))


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: its id, ``collapsed`` (the words that lie in no run after its first period, joined by a space; empty for a
    null text) and ``runs`` (start, length and period of each, by start and period, in words). Odd rows fare as in ``runs_of``."""
    def found(words: Words) -> list[list]:
        text, start, end, period = find_runs(words, least, times)
        buf, off = joined(words, ~dropped(len(words.start), start, end, period))
        bounds = np.searchsorted(text, np.arange(len(words.off)))
        raw, runs = buf.tobytes(), []
        for k in range(len(words.off) - 1):
            s = slice(int(bounds[k]), int(bounds[k + 1]))
            runs.append([{"start": a - int(words.off[k]), "length": b - a, "period": q} for a, b, q in zip(start[s].tolist(), end[s].tolist(), period[s].tolist(), strict=True)])
        return [[raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], runs]

    return _mapped(docs, None, id_col, text_col, {"collapsed": _TEXT, "runs": _RUNS}, found)


def _mapped(docs: DataFrame, key_col: str | None, id_col: str, text_col: str, fields: dict[str, tuple[str, pa.DataType]], columns: Callable[[Words], list[list]]) -> DataFrame:
    runtime.ship(docs.sparkSession)
    key = docs[key_col].cast("string") if key_col else F.lit(None).cast("string")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, (t, _) in fields.items())
    kinds = [t for _, t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in slices(batch, "text", BLOCK_BYTES // 2):
                made = columns(words_of(block, rows.column(1).to_pylist() if key_col else None))
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, made, kinds)], ["doc_id", *fields])

    return docs.select(docs[id_col].alias("doc_id"), key.alias("key"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
