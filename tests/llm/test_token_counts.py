import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from slotwise.llm import packing, token_counts
from slotwise.llm.queries import tokenizer_path
from slotwise.llm.textblock import of_array

PATH = tokenizer_path()
ODD = ["<|startoftext|>hello.<|endoftext|>x", "don't. 'S.s it's,we", "J̌. İstanbul. caféé! .́a !́", "a b c.d,e;f", "中文.abc.", "<|START|>,<|startoftext|>.", None, "", "ΣΣ. Σ", "x.̸y", "'ll.'re", "Ünï×÷cödé.", "a" * 5000]


def test_ids_are_the_librarys():
    t = Tokenizer.from_file(PATH)
    e = token_counts.PieceEncoder(PATH)
    for _ in range(2):  # the second time from memory
        ids, off = e.encode(of_array(pa.array(ODD)))
        for k, text in enumerate(ODD):
            assert ids[off[k] : off[k + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    e = token_counts.PieceEncoder(PATH)
    blocks = [of_array(pa.array([f"one two w{k}", "three"])) for k in range(5)]
    t = Tokenizer.from_file(PATH)
    for k, b in enumerate(blocks):
        assert e.counts(b).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in (f"one two w{k}", "three")]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    e = token_counts.encoder(tokenizer_path(name))
    assert (e.counts(of_array(pa.array(["some words here", None, ""]))) > 0).tolist() == [True, False, False]


def test_rows(odd_docs, no_docs):
    rows = token_counts.token_counts(odd_docs, PATH, limit=100).collect()
    t = Tokenizer.from_file(PATH)
    texts = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == texts
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_packing_round_trip(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH, 64).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for r in odd_docs.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(r.doc_id), k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(no_docs, PATH, 64).count() == 0
