"""Media columns: signature sniffing with Aho-Corasick, format validators, corrected types and carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, whole_text

# Magic bytes, their offset from the start of the file, and the media type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVE", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]
_AUTOMATON: list = []


class Found(NamedTuple):
    start: int
    length: int
    kind: str


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """payload as 8-bit mono samples in a RIFF/WAVE file; odd chunks get their pad byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_payload(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file; chunks before data are skipped."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


class Marks:
    """Where the end markers of one media value are, each looked for once, so that many signatures do not mean many searches."""

    def __init__(self, b: bytes):
        self.b = b
        self.places: dict[bytes, list[int]] = {}
        self.members: dict[int, int] = {}  # where deflated data begins -> where it ends, 0 if it isn't whole
        self.pages: set[int] = set()
        self.directories: dict[int, int] | None = None
        self.nul: dict[int, tuple[int, int]] = {}

    def all(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            at, out = self.b.find(mark), []
            while at >= 0:
                out.append(at)
                at = self.b.find(mark, at + 1)
            self.places[mark] = out
        return self.places[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at` on; -1 without."""
        own = self.all(mark)
        k = bisect_left(own, at)
        return own[k] if k < len(own) else -1

    def next_nul(self, at: int, field: int) -> int:
        """The first zero byte from `at` on, the length without one; for each header field, as places rise, the bytes are looked at once."""
        begin, found = self.nul.get(field, (1, 0))
        if not begin <= at <= found:
            found = self.b.find(b"\0", at)
            found = len(self.b) if found < 0 else found
            self.nul[field] = at, found
        return found

    def inflated(self, at: int) -> int:
        """Where a gzip member whose deflated data begins at `at` ends, its checksum and size confirmed; 0 if they are wrong. A megabyte at a
        time is held, whatever the data unpack to; each place is unpacked once."""
        if at not in self.members:
            d, crc, size, fed, step, end = zlib.decompressobj(-15), 0, 0, at, 1 << 16, 0
            try:
                while not d.eof:
                    data = d.unconsumed_tail
                    if not data:
                        data = self.b[fed : fed + step]
                        fed += len(data)
                        if not data:
                            break
                    out = d.decompress(data, 1 << 20)
                    crc, size = zlib.crc32(out, crc), size + len(out)
                if d.eof:
                    end = fed - len(d.unused_data)
                    end = end + 8 if self.b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0
            except zlib.error:
                end = 0
            self.members[at] = end
        return self.members[at]

    def archive(self, at: int) -> int:
        """Where a zip archive that begins at `at` ends: by a directory end whose size and offset lead back to there; 0 without."""
        if self.directories is None:
            self.directories = {}
            for e in self.all(b"PK\x05\x06"):
                if e + 22 <= len(self.b):
                    size, offset, note = struct.unpack_from("<IIH", self.b, e + 12)
                    end = e + 22 + note
                    if end <= len(self.b) and e - size - offset >= 0 and (not size or self.b[e - size : e - size + 4] == b"PK\x01\x02"):
                        self.directories.setdefault(e - size - offset, end)
        return self.directories.get(at, 0)


def _png(b, at: int, marks: Marks) -> int:
    """Length up to IEND; every chunk's checksum must hold."""
    start, at, first = at, at + 8, True
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        end = at + 12 + size
        if end > len(b) or (first and (name != b"IHDR" or size != 13)) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if name == b"IEND":
            return end - start
        at, first = end, False
    return 0


def _jpeg(b, at: int, marks: Marks) -> int:
    """Walks the segments to start-of-scan, then looks for the end marker."""
    start, at = at, at + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if mark in (0x00, 0xFF) or size < 2 or at + 2 + size > len(b):
            return 0
        at += 2 + size
        if mark == 0xDA:
            end = marks.after(b"\xff\xd9", at)
            return end + 2 - start if end >= 0 else 0
    return 0


def _gif(b, at: int, marks: Marks) -> int:
    """Walks colour tables, blocks and sub-blocks to the trailer."""
    start, end = at, len(b)
    if at + 13 > end:
        return 0
    at += 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while at < end:
        kind = b[at]
        if kind == 0x3B:
            return at + 1 - start
        if kind == 0x2C and at + 10 < end:
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
        elif kind == 0x21:
            at += 2
        else:
            return 0
        while at < end and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def _bmp(b, at: int, marks: Marks) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and header in (12, 40, 108, 124) and 26 <= data < size <= len(b) - at else 0


def _riff(b, at: int, marks: Marks) -> int:
    if at < 0 or at + 12 > len(b) or b[at : at + 4] != b"RIFF":
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    return size if 12 <= size <= len(b) - at else 0


def _wav(b, at: int, marks: Marks) -> int:
    """RIFF with a fmt chunk before its data chunk, both inside."""
    size, pos, fmt = _riff(b, at, marks), at + 12, False
    while size and pos + 8 <= at + size:
        name, n = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + n > at + size:
            return 0
        if name == b"data":
            return size if fmt else 0
        fmt |= name == b"fmt " and n >= 16
        pos += 8 + n + n % 2
    return 0


def _flac(b, at: int, marks: Marks) -> int:
    """A stream-info block of 34 bytes must come first; the length is what remains."""
    return len(b) - at if at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and b[at + 5 : at + 8] == b"\0\0\x22" else 0


def _ogg(b, at: int, marks: Marks) -> int:
    """Pages that follow one another, up to the last; a page of a stream that began before is none of its own."""
    start = at
    while at not in marks.pages and at + 27 <= len(b) and b[at : at + 4] == b"OggS" and b[at + 4] == 0:
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            break
        marks.pages.add(at)
        at = end
    return at - start


def _pdf(b, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next file's header: a file that was saved again has one for each time."""
    if not b[at + 5 : at + 6].isdigit():
        return 0
    ends, other = marks.all(b"%%EOF"), marks.after(b"%PDF-", at + 5)
    k = (bisect_left(ends, other) if other >= 0 else len(ends)) - 1
    return ends[k] + 5 - at if k >= 0 and ends[k] > at else 0


def _zip(b, at: int, marks: Marks) -> int:
    end = marks.archive(at)
    return end - at if end else 0


def _gzip(b, at: int, marks: Marks) -> int:
    """One member: the header's optional fields, the deflated data, and the checksum."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        if pos + 2 > len(b):
            return 0
        pos += 2 + struct.unpack_from("<H", b, pos)[0]
    for flag in (8, 16):  # file name, comment
        if flags & flag:
            pos = marks.next_nul(pos, flag) + 1
    pos += 2 if flags & 2 else 0
    end = marks.inflated(pos) if pos < len(b) else 0
    return end - at if end else 0


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "image/webp": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}


def automaton():
    """Built once per Python worker. Bytes are read as Latin-1, one character each."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, offset, kind in SIGNATURES:
            a.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def carve(media: bytes | None) -> Iterator[Found]:
    """All media whose magic bytes occur anywhere and whose structure and length the format's validator confirms, by start."""
    if not media:
        return
    seen, marks = set(), Marks(media)
    for end, (n, offset, kind) in automaton().iter(media.decode("latin-1")):
        at = end + 1 - n - offset
        if at >= 0 and (at, kind) not in seen and (length := VALIDATORS[kind](media, at, marks)):
            seen.add((at, kind))
            yield Found(at, length, kind)


def sniff(media: bytes | None, declared: str | None = None) -> tuple[str, list[Found]]:
    """The corrected type (confirmed at byte 0, else application/octet-stream; the declared one only if confirmed) and the embedded media."""
    found = sorted(carve(media))
    own = [x for x in found if x.start == 0]
    kind = next((x.kind for x in own if x.kind == declared), own[0].kind if own else "application/octet-stream")
    return kind, [x for x in found if x.start]


def sniff_column(df: DataFrame, media: str = "media", declared: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, media_type, embedded array<struct<start, length, kind, content>>) of a binary column; null media: octet-stream, nothing embedded."""
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("content", pa.binary())]))
        for batch in batches:
            out = [(sniff(m.as_py(), d.as_py()), m.as_py()) for m, d in zip(batch.column(1), batch.column(2), strict=True)]
            inner = [[{"start": x.start, "length": x.length, "kind": x.kind, "content": m[x.start : x.start + x.length]} for x in emb] for (_, emb), m in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for (k, _), _ in out], pa.string()), pa.array(inner, kinds)], names=["id", "media_type", "embedded"])

    return df.select(F.col(id_col).cast("long").alias("id"), media, (F.col(declared) if declared else F.lit(None)).cast("string").alias("declared")).mapInArrow(run, "id long, media_type string, embedded array<struct<start:bigint,length:bigint,kind:string,content:binary>>")


def store_texts(docs: DataFrame, block: int = 576, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, filled up with 255 to a positive multiple of block, as an 8-bit WAV; written as a table and read again."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [x.as_py().encode() for x in part.column(1)]
                media = [wav(x + b"\xff" * (max(block, -(-len(x) // block) * block) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return materialize(rows, "media", compression="zstd")


def read_back(stored: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Digests of a table of store_texts: the stored form, its sniffed type and embedded media, and the payload taken out of it again.

    feature: corrected type, number of samples, mean and standard deviation of the samples, embedded types with counts."""
    ship(stored.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_embedded"]
        for batch in batches:
            out = []
            for doc, n, m in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                media = m.as_py()
                kind, inner = sniff(media, declared)
                payload = wav_payload(media)
                samples = np.frombuffer(payload, dtype=np.uint8)
                counts = sorted({k: sum(x.kind == k for x in inner) for k in {x.kind for x in inner}}.items())
                feature = f"{kind};samples={len(samples)};mean={samples.mean():.6f};std={samples.std():.6f};embedded={','.join(f'{k}:{v}' for k, v in counts) or '-'}"
                out.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, len(inner)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_embedded long")
