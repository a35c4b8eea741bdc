"""Media columns by signature sniffing.

One Aho-Corasick pass over the bytes finds every place where a magic number stands; the format's validator
then walks the structure from there (chunks and their checksums, block lengths, declared sizes) and says
how long the medium is, or that there is none. The medium at offset 0 gives the true type, against which the
declared one is corrected; valid media elsewhere in the bytes are carved.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import slices

#: Magic numbers by type.
MAGIC: dict[str, tuple[bytes, ...]] = {
    "image/png": (b"\x89PNG\r\n\x1a\n",),
    "image/jpeg": (b"\xff\xd8\xff",),
    "image/gif": (b"GIF87a", b"GIF89a"),
    "image/bmp": (b"BM",),
    "audio/wav": (b"RIFF",),
    "application/gzip": (b"\x1f\x8b\x08",),
    "application/zip": (b"PK\x03\x04",),
    "application/pdf": (b"%PDF-",),
}
UNKNOWN = "application/octet-stream"
#: The marks at which PDF and ZIP files end, and the header of the former.
_EOF, _XREF, _PDF, _DIRECTORY = b"%%EOF", b"startxref", b"%PDF-", b"PK\x05\x06"


def _png(b: bytes, at: int) -> int:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (not seen and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        seen, p = True, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind in (0x01, *range(0xD0, 0xD8), 0xFF):
            p += 1 + (kind != 0xFF)
            continue
        if kind == 0xD9:
            return p + 2 - at
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next marker that is no stuffing and no restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


_NOWHERE = -1


def _gif_step(b: bytes, p: int) -> int:
    """The next section after the one at p; ``-1 - p`` at the trailer, ``_NOWHERE`` if there is none."""
    if p >= len(b):
        return _NOWHERE
    if b[p] == 0x3B:
        return -1 - p
    if b[p] == 0x21 and p + 2 < len(b):
        p += 2
    elif b[p] == 0x2C and p + 10 < len(b):
        p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
    else:
        return _NOWHERE
    while p < len(b) and b[p]:
        p += b[p] + 1
    return p + 1


def _gif(b: bytes, at: int, marks: Marks) -> int:
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while 0 <= p < len(b) and b[p] == 0x21:  # what comes before the first frame
        p = _gif_step(b, p)
    if not 0 <= p < len(b) or b[p] != 0x2C:
        return 0
    end = marks.walk("gif", p, _gif_step)
    return 0 if end == _NOWHERE else -end - at


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    n, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    return n if not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= data <= n and at + n <= len(b) else 0


def _wav(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    n = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + n > len(b):
        return 0
    p, end, kinds = at + 12, at + n, []
    while p + 8 <= end:
        kinds.append(b[p : p + 4])
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + size % 2
    return n if p == end and kinds[:1] == [b"fmt "] and b"data" in kinds else 0


def _gzip(b: bytes, at: int) -> int:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and p < len(b):
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


class Marks:
    """Where the marks stand at which archives and documents end: gathered once a payload, so that no header looks for them by itself."""

    def __init__(self, b: bytes):
        self.b, self._ends, self._seen = b, None, {}
        self.at: dict[bytes, list[int]] = {m: [] for m in (_EOF, _XREF, _PDF, _DIRECTORY)}

    def note(self, mark: bytes, at: int) -> None:
        self.at[mark].append(at)

    def first(self, mark: bytes, at: int) -> int:
        """The first place of the mark from ``at`` on; the payload's length if there is none."""
        k = bisect.bisect_left(self.at[mark], at)
        return self.at[mark][k] if k < len(self.at[mark]) else len(self.b)

    def last(self, mark: bytes, at: int, before: int) -> int:
        """The last place of the mark from ``at`` on that ends before ``before``, or -1."""
        k = bisect.bisect_right(self.at[mark], before - len(mark)) - 1
        return self.at[mark][k] if k >= 0 and self.at[mark][k] >= at else -1

    def archive_end(self, at: int) -> int:
        """The end of the first sound directory of an archive that starts at ``at``; 0 if there is none."""
        if self._ends is None:
            self._ends = {}
            for p in self.at[_DIRECTORY]:
                if p <= len(self.b) - 22:
                    size, start, note = struct.unpack_from("<IIH", self.b, p + 12)
                    origin = p - start - size
                    if origin >= 0 and self.b[origin + start : origin + start + 4] == b"PK\x01\x02" and p + 22 + note <= len(self.b):
                        self._ends.setdefault(origin, p + 22 + note)
        return self._ends.get(at, 0)

    def walk(self, kind: str, p: int, step: Callable[[bytes, int], int]) -> int:
        """Where a walk from p ends (its last place, as ``-1 - place``), each place being walked from once however many headers lead to it."""
        seen, path = self._seen.setdefault(kind, {}), []
        while p >= 0 and p not in seen:
            path.append(p)
            p = step(self.b, p)
        end = seen[p] if p >= 0 else p
        for q in path:
            seen[q] = end
        return end


def _zip(b: bytes, at: int, marks: Marks) -> int:
    end = marks.archive_end(at)
    return end - at if end else 0


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    """Up to the last end mark that has a cross-reference section of its own: linearised and updated files have several."""
    end, p = at, marks.first(_EOF, at)
    while p < len(b) and marks.first(_PDF, max(end, at + 1)) >= p:
        q = marks.last(_XREF, end, p)
        place = b[q + 9 : p].strip() if q >= 0 else b""
        if not place.isdigit() or len(place) > 18:
            break
        to = at + int(place)
        if int(place) and not (to < q and (b[to : to + 4] == b"xref" or b[to : to + 1].isdigit())):
            break
        end = p + 5
        p = marks.first(_EOF, end)
    return end - at


_BY_MARKS = ("image/gif", "application/zip", "application/pdf")
VALIDATORS: dict[str, Callable[..., int]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp,
    "audio/wav": _wav, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf,
}


@functools.cache
def _automaton():  # noqa: ANN202
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            a.add_word(m.decode("latin-1"), (kind, len(m)))
    for m in (_EOF, _XREF, _DIRECTORY):
        a.add_word(m.decode("latin-1"), ("mark", len(m)))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Sniffed:
    """The type at offset 0 (UNKNOWN if none is valid there), its length, and (offset, length, type) of other valid media."""

    kind: str
    length: int
    embedded: tuple[tuple[int, int, str], ...]


def sniff(data: bytes) -> Sniffed:
    """What the bytes hold. A medium within a carved medium is not carved again; the bytes within the one at offset 0 are searched.

    One pass finds headers and end marks; then each header is judged. PDF, ZIP and GIF files are followed by what that pass
    found, so the time is in proportion to the bytes however often their headers stand there.
    """
    kind, length, found, end = UNKNOWN, 0, [], 0
    marks, heads = Marks(data), []
    for last, (what, n) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        if what in VALIDATORS:
            heads.append((at, what))
        if data[at : last + 1] in marks.at:
            marks.note(data[at : last + 1], at)
    for at, what in heads:
        if at and at < end:
            continue
        validate = VALIDATORS[what]
        size = validate(data, at, marks) if what in _BY_MARKS else validate(data, at)
        if size and not at:
            kind, length = what, size
        elif size:
            found.append((at, size, what))
            end = at + size
    return Sniffed(kind, length, tuple(found))


_PARTS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))


def _parts(seen: Sniffed) -> list[dict]:
    return [dict(zip(("offset", "length", "kind"), e, strict=True)) for e in seen.embedded]


def carve(df: DataFrame, data_col: str = "media", embedded_col: str = "embedded", id_col: str = "doc_id") -> DataFrame:
    """(id, part, kind, data): the media within each row's bytes, a row each, by what was sniffed; ``part`` is the number from 0. Rows without any give none."""
    parts = df.select(df[id_col].alias("id"), df[data_col].alias("_data"), F.posexplode(embedded_col).alias("part", "_e"))
    return parts.select("id", "part", "_e.kind", F.substring("_data", (F.col("_e.offset") + 1).cast("int"), F.col("_e.length").cast("int")).alias("data"))


def sniff_column(df: DataFrame, data_col: str = "data", declared_col: str | None = "declared", id_col: str = "id") -> DataFrame:
    """One row per row of ``df``: id, declared, kind (what the bytes are), corrected (a declared type that is wrong), length, embedded.

    Null and empty data are of the unknown type with length 0. A null declared type counts as unknown. Repeated rows each
    give a row, an empty table none; no other column is read, so their names do not matter.
    """
    runtime.ship(df.sparkSession)
    cols = df.select(df[id_col].alias("id"), (df[declared_col] if declared_col else df[data_col].cast("string").substr(1, 0)).cast("string").alias("declared"), df[data_col].cast("binary").alias("data"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sniff(x.as_py() or b"") for x in batch.column(2)]
            declared = [x or UNKNOWN for x in batch.column(1).to_pylist()]
            embedded = pa.array([_parts(g) for g in got], _PARTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g.kind for g in got], pa.string()), pa.array([g.kind != d for g, d in zip(got, declared, strict=True)], pa.bool_()), pa.array([g.length for g in got], pa.int64()), embedded], ["id", "declared", "kind", "corrected", "length", "embedded"])

    return cols.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, declared string, kind string, corrected boolean, length bigint, embedded array<struct<offset: bigint, length: bigint, kind: string>>")


UNIT = 64


def payload_of(raw: bytes) -> bytes:
    """The bytes, padded with 0 to a positive multiple of ``UNIT``."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def to_png(payload: bytes) -> bytes:
    """The payload as rows of ``UNIT`` 8-bit grey samples (unfiltered, stored without compression)."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC["image/png"][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 0)) + chunk(b"IEND", b"")


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples that a stored WAV or grey PNG holds."""
    if kind == "audio/wav":
        p = 12
        while data[p : p + 4] != b"data":
            n = struct.unpack_from("<I", data, p + 4)[0]
            p += 8 + n + n % 2
        return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]
    if kind == "image/png":
        p, raw, width = 8, [], 0
        while p < len(data):
            n, what = struct.unpack_from(">I4s", data, p)
            body = data[p + 8 : p + 8 + n]
            if what == b"IHDR":
                width, _, depth, colour = struct.unpack_from(">IIBB", body)
                if (depth, colour) != (8, 0):
                    raise ValueError("only 8-bit grey images hold samples")
            elif what == b"IDAT":
                raw.append(body)
            p += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(raw)), np.uint8).reshape(-1, width + 1)
        if lines[:, 0].any():
            raise ValueError("only unfiltered rows hold samples")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no samples in {kind}")


def store(payload: bytes) -> bytes:
    """A WAV or a PNG, as the payload's checksum has it: a column of both kinds, equal payloads alike."""
    return to_png(payload) if zlib.crc32(payload) & 1 else to_wav(payload)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: str = "audio/wav", with_media: bool = True) -> DataFrame:
    """Each text stored as a medium, sniffed and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, declared, kind, corrected, embedded, n_embedded and (with_media) media.

    The column is declared to hold one type (``declared``); the type under which the samples are read is the sniffed one, and ``corrected`` where that is
    another. ``embedded`` has the offset, length and type of each other medium in the stored bytes, at which ``carve`` takes it out. ``feature`` is of the samples read: type,
    count, sum, least, most and number of distinct values. A null or empty text is a payload of ``UNIT``
    zeros. Repeated rows each give a row, an empty table none; no other column is read. One pass, no shuffle.
    """
    runtime.ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "kind", "corrected", "embedded", "n_embedded"] + ["media"] * with_media
    longs = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_embedded"}
    kinds = {n: pa.int64() if n in longs else pa.binary() if n == "media" else pa.string() for n in names} | {"corrected": pa.bool_(), "embedded": _PARTS}
    types = {"corrected": "boolean", "embedded": "array<struct<offset: bigint, length: bigint, kind: string>>", "media": "binary"}

    def one(raw: bytes) -> tuple:
        data = store(payload_of(raw))
        seen = sniff(data)
        got = samples(data, seen.kind)
        counts = np.bincount(np.frombuffer(got, np.uint8), minlength=256)
        at = np.flatnonzero(counts)
        feature = f"{seen.kind};n={len(got)};sum={int(counts @ np.arange(256))};min={at[0]};max={at[-1]};distinct={len(at)}"
        return len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, declared, seen.kind, seen.kind != declared, _parts(seen), len(seen.embedded), data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in slices(batch, "text"):
                raw = block.buf.tobytes()
                made = [one(raw[a:b]) for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, kinds[n]) for n, c in zip(names[1:], zip(*made, strict=True), strict=False))], names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} " + ("bigint" if n in longs else types.get(n, "string")) for n in names[1:])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
