"""Media columns: bytes as 8-bit samples in Ogg, written and read page by page.

An Ogg file here holds two logical streams, interleaved: the samples (packets of PACKET samples after one header
packet; the granule position counts samples) and an envelope (the mean of each block of BLOCK samples; the granule
position counts blocks). The reader takes any Ogg bytes: it verifies each page's checksum, rebuilds packets from the
lacing values, across pages where they continue, keeps the logical streams apart by serial number, and turns granule
positions into seconds.

Defined results: null text is empty, and an empty payload is one block of zeros; a page that is cut off or whose
checksum differs is counted in `bad_pages` and left out, with the packet that ran through it; bytes between pages are
skipped; a media value of null has no streams; equal texts give equal media; rows are independent, so repeated rows,
ties and any other columns change nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import map_arrow, slices, table

PAD = 64
PACKET = 16384
BLOCK = 256
RATE = 8000
SAMPLES, ENVELOPE = 0x53414D50, 0x454E5645
HEADER = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sIIQ")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """The checksum of Ogg pages: polynomial 0x04C11DB7, most significant bit first, start 0. It is the mirror image
    of zlib's, so zlib does the work on mirrored bytes."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


class _Writer:
    """One logical stream. pages() gives finished pages; close() gives the rest."""

    def __init__(self, serial: int):
        self.serial, self.number, self.flags = serial, 0, FIRST
        self.lacing, self.body, self.granule = bytearray(), [], -1

    def _page(self, last: bool = False) -> bytes:
        head = HEADER.pack(b"OggS", 0, self.flags | LAST * last, self.granule, self.serial, self.number, 0, len(self.lacing))
        page = b"".join((head, self.lacing, *self.body))
        page = page[:22] + ogg_crc(page).to_bytes(4, "little") + page[26:]
        self.number, self.flags, self.granule = self.number + 1, 0, -1
        self.lacing, self.body = bytearray(), []
        return page

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        at, left = 0, len(data) // 255 + 1
        while left:
            if len(self.lacing) == 255:
                yield self._page()
                self.flags = CONTINUED * (at > 0)
            now = min(left, 255 - len(self.lacing))
            left -= now
            size = now * 255 if left else len(data) - at
            self.lacing += b"\xff" * (now - (not left)) + (b"" if left else bytes([size - 255 * (now - 1)]))
            self.body.append(data[at : at + size])
            at += size
        self.granule = granule

    def flush(self, last: bool = False) -> Iterator[bytes]:
        if self.lacing or last:
            yield self._page(last)


def encode_ogg(payload: bytes, rate: int = RATE) -> bytes:
    """payload as 8-bit samples, with its envelope as a second logical stream."""
    main, side = _Writer(SAMPLES), _Writer(ENVELOPE)
    out = [*main.packet(IDENT.pack(b"PCM-U8\0\0", rate, 1, len(payload)), 0), *main.flush()]
    out += [*side.packet(IDENT.pack(b"MEAN-U8\0", rate, BLOCK, -(-len(payload) // BLOCK)), 0), *side.flush()]
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        out += main.packet(part, at + len(part))
        wave = np.frombuffer(part, np.uint8)
        cuts = np.arange(0, len(wave), BLOCK)
        sums = np.add.reduceat(wave, cuts, dtype=np.int64)
        means = (sums // np.diff(np.append(cuts, len(wave)))).astype(np.uint8)
        out += side.packet(means.tobytes(), (at + len(part) + BLOCK - 1) // BLOCK)
    return b"".join([*out, *main.flush(True), *side.flush(True)])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page that ends a packet
    ended: bool = False
    open: list[bytes] | None = None
    expect: int | None = None


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes] | None]:
    """(flags, granule, serial, number, lacing, body) of each sound page; None for each that is not."""
    at = data.find(b"OggS")
    while at >= 0:
        if at + HEADER.size > len(data):
            yield None
            return
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        body = at + HEADER.size + n
        lacing = data[at + HEADER.size : body]
        end = body + sum(lacing)
        good = version == 0 and len(lacing) == n and end <= len(data)
        if good and ogg_crc(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) == crc:
            yield flags, granule, serial, number, lacing, data[body:end]
            at = data.find(b"OggS", end)
        else:
            yield None
            at = data.find(b"OggS", at + 4)


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and how many pages were not sound."""
    streams: dict[int, Stream] = {}
    bad = 0
    for page in pages(data or b""):
        if page is None:
            bad += 1
            continue
        flags, granule, serial, number, lacing, body = page
        s = streams.setdefault(serial, Stream(serial))
        if s.expect is not None and number != s.expect:
            s.open = None  # a page is missing: what ran through it is lost
        s.expect = number + 1
        skip = bool(flags & CONTINUED) and s.open is None
        if not flags & CONTINUED:
            s.open = None
        at = size = 0
        for lace in lacing:
            size += lace
            if lace < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(b"".join([*(s.open or ()), body[at : at + size]]))
                s.open, at, size = None, at + size, 0
        if size or (lacing and lacing[-1] == 255):
            s.open = None if skip else [*(s.open or ()), body[at:]]
        if granule >= 0:
            s.granules.append(granule)
        s.ended |= bool(flags & LAST)
    return streams, bad


@dataclass
class Media:
    payload: bytes
    rate: int
    seconds: float
    bad_pages: int
    streams: int
    envelope: bytes


def decode_ogg(data: bytes) -> Media:
    """The samples and what goes with them; the duration comes from the last granule position."""
    streams, bad = read_ogg(data)
    found = {s: streams.get(s, Stream(s)) for s in (SAMPLES, ENVELOPE)}
    main = found[SAMPLES]
    rate = IDENT.unpack(main.packets[0])[1] if main.packets and len(main.packets[0]) == IDENT.size else RATE
    return Media(b"".join(main.packets[1:]), rate, max(main.granules, default=0) / rate, bad, len(streams), b"".join(found[ENVELOPE].packets[1:]))


def features(m: Media) -> str:
    """Duration, mean, deviation, peak-to-peak and sign changes of the samples, and the envelope's range."""
    wave = np.frombuffer(m.payload, np.uint8)
    if not len(wave):
        return "seconds=0.000000"
    n, total = len(wave), int(wave.sum(dtype=np.int64))
    squares = int(np.dot(wave.astype(np.float64), wave))
    high = wave >= 128
    env = np.frombuffer(m.envelope, np.uint8) if m.envelope else np.zeros(1, np.uint8)
    deviation = max(0.0, squares / n - (total / n) ** 2) ** 0.5
    return f"seconds={m.seconds:.6f};mean={total / n:.4f};deviation={deviation:.4f};range={int(wave.max()) - int(wave.min())};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};envelope={int(env.min())}-{int(env.max())}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the text, zero-padded to a positive multiple of 64 bytes, as an Ogg column."""

    def make():
        def each(batch):
            for part, data in slices(batch, 1):
                media = [encode_ogg(x + bytes(-len(x) % PAD or PAD * (not x))) for x in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return each

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, "doc_id long, n_bytes long, media binary")


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, bad_pages int, streams int"


def media_columns(media: DataFrame) -> DataFrame:
    """Read each Ogg column back: digests of the samples and the stored form, features, seconds, unsound pages."""

    def make():
        def each(batch):
            for part, data in slices(batch, 2):
                rows = []
                for x in data:
                    m = decode_ogg(x)
                    rows.append((len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-PAD:]), len(x), hashlib.sha256(x).hexdigest(), features(m), m.seconds, m.bad_pages, m.streams))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], [x.split()[0] for x in MEDIA_SCHEMA.split(", ")])

        return each

    return map_arrow(media.select("doc_id", "n_bytes", "media"), make, MEDIA_SCHEMA)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(to_media(table(spark, sf_dir, "documents")))
