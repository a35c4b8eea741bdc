"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

Line rules (parameters of ``LineRules``):

* punctuation: a line of at least ``min_prose_words`` words that does not end in a terminal mark, or a line of ``min_marked_words`` words or more with as many of ``# * $ % & !`` as ``marks_percent`` of its words;
* navigation: a line with ``nav_separators`` or more of ``| > <`` that has as many of them as ``nav_percent`` of its words;
* boilerplate: a line that holds one of the phrases (ASCII case folded).

Lines without a word are kept as they are: they carry no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from slotwise.llm import runtime
from slotwise.llm.textblock import U64, Block, mix, repeated, slices, sums

#: Phrases of boilerplate lines, in the four languages of the corpora that the defaults are for.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our newsletter", "click here", "sign up now", "log in to", "share this",
    "todos los derechos reservados", "haga clic", "aviso legal", "acepte las cookies", "alle rechte vorbehalten", "hier klicken", "cookies akzeptieren", "cliquez ici", "accepter les cookies", "tous droits",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; the defaults are those in production."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_prose_words: int = 8
    nav_separators: int = 3
    nav_percent: int = 25
    min_marked_words: int = 4
    marks_percent: int = 30
    max_lost_percent: int = 30
    boilerplate: tuple[str, ...] = BOILERPLATE


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BAR = np.zeros(256, bool)
_BAR[[ord(c) for c in "|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&!"]] = True
#: Last bytes of a line that end a sentence: ASCII marks, and the last byte of common marks in UTF-8 (… ” ’ » 。 ！ ？).
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')]}"]] = True
_END_WIDE = ("…", "”", "’", "»", "。", "！", "？", "“")


def _fold(phrase: str) -> str:
    """The phrase with ASCII letters lowered, as lines are."""
    return phrase.encode().lower().decode()


def _ends_well(block: Block, last: np.ndarray) -> np.ndarray:
    """Whether the byte at each index, or the character that ends there, is a terminal mark."""
    buf = block.buf
    ok = _END[buf[last]]
    for mark in _END_WIDE:
        raw = mark.encode()
        hit = np.flatnonzero(~ok & (buf[last] == raw[-1]) & (last >= len(raw) - 1))
        for k, byte in enumerate(reversed(raw)):
            hit = hit[buf[last[hit] - k] == byte]
        ok[hit] = True
    return ok


def _features(block: Block, phrase: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    """Per text: the counts, the lost words and the verdict. ``phrase``: texts that hold a boilerplate phrase."""
    buf, off = block.buf, block.off
    ws, we = block.words()
    n_words = block.per_text(ws)
    word_bytes = np.concatenate([[0], np.cumsum(we - ws)])[np.searchsorted(ws, off)]
    within = (buf & 0xC0) == 0x80
    chars = np.diff(word_bytes) - sums(within, off)
    # words of 3-word windows that occur twice or more
    h, doc = block.hashes(ws, we), np.repeat(np.arange(block.n), n_words)
    again = np.zeros(len(h), bool)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            w = mix(h[:-2] * U64(3) + mix(h[1:-1] * U64(5) + mix(h[2:] * U64(7) + doc[2:].astype(U64))))
        inside = doc[:-2] == doc[2:]
        at = np.flatnonzero(inside)
        at = at[repeated(w[at])[1]]
        again[at] = again[at + 1] = again[at + 2] = True
    # lines that have a word
    ls, le = block.lines()
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    full = first < last
    ls, le, first, last = ls[full], le[full], first[full], last[full]
    line_doc = np.searchsorted(off, ls, "right") - 1
    counts = last - first
    with np.errstate(over="ignore"):
        keys = mix(block.hashes(ls, le) + mix(line_doc.astype(U64)))
    dup = repeated(keys)[0]
    within_lines = lambda what: np.diff(np.concatenate([[0], np.cumsum(what[buf])])[np.stack([ls, le])], axis=0)[0]
    bars, marks = within_lines(_BAR), within_lines(_MARK)
    failed = (counts >= rules.min_prose_words) & ~_ends_well(block, we[last - 1] - 1) if len(ls) else np.zeros(0, bool)
    failed |= (bars >= rules.nav_separators) & (100 * bars >= rules.nav_percent * counts)
    failed |= (counts >= rules.min_marked_words) & (100 * marks >= rules.marks_percent * counts)
    lines_off = np.searchsorted(line_doc, np.arange(block.n + 1))
    for d in np.flatnonzero(phrase):
        for k in range(lines_off[d], lines_off[d + 1]):
            line = buf[ls[k] : le[k]].tobytes().lower()  # bytes: ASCII only
            failed[k] |= any(p.encode() in line for p in rules.boilerplate)
    lost = np.bincount(line_doc[failed], (we[last - 1] - ws[first])[failed], block.n).astype(np.int64) if len(ls) else np.zeros(block.n, np.int64)
    total = np.bincount(line_doc, we[last - 1] - ws[first], block.n).astype(np.int64) if len(ls) else np.zeros(block.n, np.int64)
    n_repeat = sums(again, np.concatenate([[0], np.cumsum(n_words)]))
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": sums(_SYMBOL[buf], off), "n_dup_lines": np.bincount(line_doc[dup], minlength=block.n), "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= rules.max_lost_percent * total),
        "n_failed_lines": np.bincount(line_doc[failed], minlength=block.n), "lost_bytes": lost, "total_bytes": total,
        "_lines": (ls, le, line_doc, failed),
    }


def _cleaned(block: Block, ls: np.ndarray, le: np.ndarray, doc: np.ndarray, failed: np.ndarray) -> list[str]:
    """Each text without its failing lines (a failing line goes with the line feed that follows it)."""
    drop = np.zeros(len(block.buf) + 1, np.int8)
    for k in np.flatnonzero(failed):
        drop[ls[k] : min(le[k] + 1, block.off[doc[k] + 1])] = 1
    keep = drop[:-1] == 0
    return [block.buf[a:b][keep[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(block.off[:-1], block.off[1:], strict=True)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_failed_lines", "lost_bytes", "total_bytes")


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, ``base_failed``, ``kept``, what the rules removed and (with_text) the cleaned text.

    ``kept`` is false where the base rules fail or more than ``max_lost_percent`` of the bytes in lines that
    have words stand in failing lines. Null and empty texts have no words: not kept, cleaned text empty.
    Repeated rows each give a row, an empty table none; other columns are not read. One pass, no shuffle.
    """
    runtime.ship(docs.sparkSession)
    rules = replace(rules, boilerplate=tuple(_fold(p) for p in rules.boilerplate if p))
    pattern = "|".join(re.escape(p) for p in rules.boilerplate) or "$^"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in slices(batch, "text"):
                phrase = pc.match_substring_regex(rows.column(1), pattern, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
                f = _features(block, phrase, rules)
                out = [rows.column(0), *(pa.array(f[c].astype(np.int64)) for c in COUNTS), pa.array(f["base_failed"]), pa.array(f["kept"]), *(pa.array(f[c].astype(np.int64)) for c in MORE)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(_cleaned(block, *f["_lines"]), pa.string())] if with_text else []), names)

    names = ["doc_id", *COUNTS, "base_failed", "kept", *MORE] + ["cleaned"] * with_text
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} bigint" for c in MORE) + ", cleaned string" * with_text
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
