import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from slotwise.llm import media


@given(st.binary(max_size=500))
def test_round_trip(raw):
    p = media.payload_of(raw)
    assert p and len(p) % 64 == 0 and p.rstrip(b"\0") == raw.rstrip(b"\0")
    for made, kind in ((media.to_wav, "audio/wav"), (media.to_png, "image/png")):
        data = made(p)
        seen = media.sniff(data)
        assert (seen.kind, seen.length) == (kind, len(data)) and media.samples(data, kind) == p


def parts():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "hello" * 10)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 66, 0, 62, 40, 1, 1, 1, 1) + b"\0" * 36
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab\x12\xff\0\x13\xff\xd9"
    return {"application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 1000), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpg, "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF", "image/png": media.to_png(media.payload_of(b"q"))}


def test_carving():
    blob = b"noise BM RIFF PK\x03\x04 " + b"--".join(parts().values()) + b"GIF89a"
    seen = media.sniff(blob)
    assert seen.kind == media.UNKNOWN
    assert [(k, blob[a : a + n]) for a, n, k in seen.embedded] == list(parts().items())


@pytest.mark.parametrize("kind", parts())
def test_truncated_media_are_none(kind):
    assert media.sniff(parts()[kind]).kind == kind
    assert media.sniff(parts()[kind][:-1]).kind == media.UNKNOWN


def test_pdf_files_of_several_sections():
    first = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n24\n%%EOF\n"
    assert first[24:28] == b"xref"
    update = first + b"2 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % (len(first) + 15)
    assert update[len(first) + 15 :].startswith(b"xref")
    linear = b"%PDF-1.4\nxref\ntrailer\nstartxref\n0\n%%EOF\n9 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"
    for whole in (first.rstrip(), update, linear):
        assert media.sniff(whole) == media.Sniffed("application/pdf", len(whole), ())
        seen = media.sniff(b"x" + whole + update + b" text with startxref and %%EOF")
        assert [(a, n) for a, n, _ in seen.embedded] == [(1, len(whole)), (1 + len(whole), len(update))]
    assert media.sniff(first.replace(b"24", b"25")).kind == media.UNKNOWN


def test_odd_columns(spark):
    png = bytearray(parts()["image/png"])
    df = spark.createDataFrame([(1, "image/png", png, "x", "y")] * 2 + [(None, "text/plain", bytearray(), None, None)], "id long, declared string, data binary, kind string, embedded string")
    rows = media.sniff_column(df).collect()
    assert sorted((str(r.id), r.kind, r.corrected, r.length) for r in rows) == [("1", "image/png", False, len(png))] * 2 + [("None", media.UNKNOWN, True, 0)]
    assert media.sniff_column(df.limit(0)).count() == 0


def test_stored_texts_have_definite_features(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other text %PDF-1.4 startxref 0 %%EOF"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in media.store_texts(docs, with_media=False).collect()}
    assert rows[1].feature == rows[2].feature != rows[3].feature and all(r.feature for r in rows.values())


def plain_feature(text):
    """(kind, feature) of a stored text, read back by the standard library."""
    p = (text or "").encode()
    p += b"\0" * (-len(p) % 64 or (0 if p else 64))
    kind = "image/png" if zlib.crc32(p) & 1 else "audio/wav"
    return kind, f"{kind};n={len(p)};sum={sum(p)};min={min(p)};max={max(p)};distinct={len(set(p))}"


def test_features_and_embedded_media_against_a_plain_version(spark):
    pdf = "%PDF-1.4 startxref\n0\n%%EOF"
    zip_end = "PK\x05\x06" + "\0" * 18
    texts = ["a", "some text é漢", None, "", f"see {pdf} and {pdf}", "x" * 200, f"PK\x03\x04 {zip_end}", *(f"text {k}" for k in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.store_texts(docs).cache()
    rows = {r.doc_id: r for r in stored.collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.kind, r.feature) == plain_feature(t)
        assert (r.declared, r.corrected) == ("audio/wav", r.kind != "audio/wav")
        if r.kind == "audio/wav":
            with wave.open(io.BytesIO(bytes(r.media))) as w:
                assert w.readframes(w.getnframes()).rstrip(b"\0") == (t or "").encode().rstrip(b"\0")
        assert r.n_embedded == len(r.embedded) == (2 if k == 4 else 0)
    assert {r.corrected for r in rows.values()} == {True, False}
    carved = media.carve(stored).orderBy("part").collect()
    assert [(r.id, r.part, r.kind, bytes(r.data).decode()) for r in carved] == [(4, n, "application/pdf", pdf) for n in range(2)]


@pytest.mark.parametrize("unit", [b"%PDF-", b"PK\x03\x04", b"GIF89a!xA,", b"PK\x05\x06PK\x03\x04", b"%PDF-1 startxref 0 ", b"%%EOF%PDF-"])
def test_time_is_in_proportion_to_repeated_magics(unit):
    times = []
    for n in (100_000, 800_000):
        data = unit * (n // len(unit))
        start = time.process_time()
        media.sniff(data)
        times.append(time.process_time() - start)
    assert times[1] < 25 * times[0] + 0.2 and times[1] < 3


def test_gif_walks_meet():
    gif = parts()["image/gif"]
    body = gif[13 + 6 :]
    tail = b"GIF89a" + gif[6:19] + b"!\x01\x02ab\x00" * 50 + body
    data = b"GIF89a" + gif[6:19] + b"!\x01" + bytes([len(b"GIF89a")]) + b"GIF89a" + b"\x00" + body
    assert media.sniff(data) == media.Sniffed("image/gif", len(data), ())
    assert media.sniff(b"--" + tail).embedded == ((2, len(tail), "image/gif"),)


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(1, "image/jpeg", bytearray(parts()["image/png"])), (2, "image/gif", bytearray(parts()["image/gif"])), (3, None, None)], "id long, declared string, data binary")
    rows = {r.id: r for r in media.sniff_column(df).collect()}
    assert (rows[1].kind, rows[1].corrected) == ("image/png", True)
    assert (rows[2].corrected, rows[3].kind, rows[3].corrected) == (False, media.UNKNOWN, False)


def test_texts(odd_docs, no_docs):
    rows = media.store_texts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for text in (None, "", "word"):
        p = media.payload_of((text or "").encode())
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in rows)
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in rows)
    assert media.store_texts(no_docs).count() == 0
