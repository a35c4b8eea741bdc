"""Token counts and ids for whole texts, with the library's own results.

Texts are cut at boundaries where the tokenizer can never join what stands on either side, equal
pieces are encoded once per worker, and counts or ids are put together again. The cuts for
``word_bpe_49k.json``: ASCII white space (dropped by its splitter, never part of a token), and between
an ASCII letter and one of ``. , ; : ! ?`` (its splitter separates letters from other characters there,
none of these characters composes under NFC with an ASCII letter, and no special string has one).
A long text is thus handed over in pieces; only what has no such boundary (say, a run of Han characters) is one
piece, whole, as any cut within it could change its tokens. Vocabularies for which these cuts do not hold are
encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm import runtime
from slotwise.llm.textblock import BLOCK_BYTES, Block, slices

#: Pieces that a worker remembers; beyond it the memory starts anew. It bounds memory, results do not depend on it.
REMEMBERED = 1_000_000
TABLE_BITS = 20

_CLASS = np.full(256, 5, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[ord(c) for c in ".,;:!?"]] = 2
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class PieceEncoder:
    """Ids of pieces of text, each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.n = self.used = 0
        self.start, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        # two direct-mapped tables from a piece's hash to its slot, and a dict for what finds neither place free
        self.key = [np.zeros(1 << TABLE_BITS, np.uint64) for _ in range(2)]
        self.at = [np.full(1 << TABLE_BITS, -1, np.int32) for _ in range(2)]
        self.more: dict[int, int] = {}

    @staticmethod
    def _place(h: np.ndarray, table: int) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS) if table == 0 else h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        if len(a) < used + len(values):
            b = np.zeros(max(used + len(values), 2 * len(a)), a.dtype)
            b[:used] = a[:used]
            setattr(self, name, a := b)
        a[used : used + len(values)] = values

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the pieces, lengths in that order, ids in that order). Words of plain letters are one pre-token each, so many go in one call and part at word ends."""
        encode = lambda x: self.tokenizer.encode_batch_fast(x, add_special_tokens=False)
        kinds: tuple[list[int], list[int]] = [], []
        for i, p in enumerate(pieces):
            kinds[_PLAIN.fullmatch(p) is not None].append(i)
        rest, plain = kinds
        order, lengths, ids = [], [], []
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            got = np.array(encode([" ".join([pieces[i] for i in some])])[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(some):
                order += some
                lengths.append(np.diff(cuts, prepend=0))
                ids.append(got)
            else:
                rest += some
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            got = [e.ids for e in encode([pieces[i] for i in some])]
            order += some
            lengths.append(np.array([len(x) for x in got]))
            ids.append(np.array([i for x in got for i in x], np.uint32))
        return np.array(order), np.concatenate(lengths), np.concatenate(ids)

    def pieces(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        buf, c = block.buf, _CLASS[block.buf]
        lead = np.flatnonzero(buf == 0xC3)  # letters from À to ÿ are 0xC3 and a byte; × and ÷ are none
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        c[lead] = c[lead + 1] = 1
        split = np.zeros(len(c), bool)
        if len(c):
            split[1:] = (c[1:] * c[:-1]) == 2
        return block.spans(c > 0, split)

    def _find(self, h: np.ndarray) -> np.ndarray:
        slots = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for t in (0, 1):
            place = self._place(h[left], t)
            hit = (self.key[t][place] == h[left]) & (self.at[t][place] >= 0)
            slots[left[hit]] = self.at[t][place[hit]]
            left = left[~hit]
        if len(left) and self.more:
            slots[left] = [self.more.get(k, -1) for k in h[left].tolist()]
        return slots

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        order, lengths, ids = self._encode(pieces)
        h = h[order]
        self._append("start", self.n, self.used + np.cumsum(lengths) - lengths)
        self._append("length", self.n, lengths)
        self._append("ids", self.used, ids)
        slots = np.arange(self.n, self.n + len(h))
        self.n, self.used = self.n + len(h), self.used + len(ids)
        for t in (0, 1):
            place = self._place(h, t)
            first = np.zeros(len(h), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = first & (self.at[t][place] < 0)
            self.key[t][place[put]], self.at[t][place[put]] = h[put], slots[put]
            h, slots = h[~put], slots[~put]
        self.more.update(zip(h.tolist(), slots.tolist(), strict=True))

    def slots(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(start of each piece, its slot) over a block."""
        starts, ends = self.pieces(block)
        if self.n > REMEMBERED:
            self.forget()
        h = block.hashes(starts, ends)
        slots = self._find(h)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            raw = block.buf.tobytes()
            self._learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slots[miss] = self._find(h[miss])
        return starts, slots

    def counts(self, block: Block) -> np.ndarray:
        """Tokens of each text."""
        starts, slots = self.slots(block)
        c = np.concatenate([[0], np.cumsum(self.length[slots])])
        return np.diff(c[np.searchsorted(starts, block.off)])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets of the texts in them)."""
        starts, slots = self.slots(block)
        lens = self.length[slots]
        c = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(c[-1]) - np.repeat(c[:-1] - self.start[slots], lens)
        return self.ids[at], c[np.searchsorted(starts, block.off)]


class WholeTexts:
    """For vocabularies with other boundaries: the library on each whole text."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda x: p.encode(x, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._ids = lambda x: [e.ids for e in t.encode_batch_fast(x, add_special_tokens=False)]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids([block.text(a, b) for a, b in zip(block.off[:-1], block.off[1:], strict=True)])
        return np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def counts(self, block: Block) -> np.ndarray:
        return np.diff(self.encode(block)[1])


_encoders: dict[str, PieceEncoder | WholeTexts] = {}


def encoder(path: str) -> PieceEncoder | WholeTexts:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = PieceEncoder(path) if os.path.basename(path) == "word_bpe_49k.json" else WholeTexts(path)
    return _encoders[path]


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows each give a row;
    an empty table gives none; other columns are not read. Arrow batches are cut into runs of about
    ``BLOCK_BYTES``, so a task's memory does not follow the row count. Only lengths leave the function.
    """
    runtime.ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for rows, block in slices(batch, "text", BLOCK_BYTES):
                n = e.counts(block)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(block.off)), pa.array(n.astype(np.int64)), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
