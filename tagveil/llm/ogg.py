"""Ogg media columns: page checksums, packet reassembly from lacing values, demultiplexing, granule times.

``mux`` writes logical streams into one Ogg byte string, ``demux`` reads any Ogg byte
string back. A page whose checksum, version or length is wrong is skipped and counted and
the reader looks for the next capture pattern; a packet that loses a part to such a page
is dropped and counted, never returned in pieces.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import map_arrow, sub_batches, texts_of

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
MAX_LACES = 255

#: The two streams a payload is stored as, and its sample rate.
SAMPLES_SERIAL, ENVELOPE_SERIAL = 0x5361, 0x456E
RATE, BLOCK = 8000, 4096
_SETUP = struct.Struct("<8sII")
SAMPLES_MAGIC, ENVELOPE_MAGIC = b"u8mono\0\0", b"envelope"


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, zero start and no final inversion.

    zlib's CRC is the same polynomial least significant bit first, so it is taken over the
    bit-reversed bytes from an undone start value, and its register reversed.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(laces)) + laces + body
    return blank[:22] + struct.pack("<I", page_checksum(blank)) + blank[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """One logical stream as (time, page) in order; ``packets`` holds (bytes, end granule).

    A page's granule is that of the last packet ending on it, or -1 if none does; its time
    is the latest granule so far.
    """
    pages: list[tuple[int, bytes]] = []
    laces, body = bytearray(), []
    granule, resumed, last = NO_GRANULE, False, 0

    def flush(end: bool = False) -> None:
        nonlocal laces, body, granule, resumed, last
        flags = CONTINUED * resumed | FIRST * (not pages) | LAST * end
        last = max(granule, last)
        pages.append((last, _page(flags, granule, serial, len(pages), bytes(laces), b"".join(body))))
        resumed = bool(laces) and laces[-1] == 255
        laces, body, granule = bytearray(), [], NO_GRANULE

    for k, (data, ends) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1
        while left:
            if len(laces) == MAX_LACES:
                flush()
            take = min(left, MAX_LACES - len(laces))
            done = take == left
            size = len(data) - at if done else 255 * take
            laces += b"\xff" * (take - done) + (bytes([size - 255 * (take - 1)]) if done else b"")
            body.append(data[at : at + size])
            at, left = at + size, left - take
        granule = ends
        if k == 0 and len(packets) > 1:
            flush()  # a setup packet stands alone on the first page
    flush(end=True)
    return pages


def mux(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """Interleave logical streams: all first pages, then the rest by granule (equal rates are assumed)."""
    pages = [(granule, k, i, page) for k, (serial, packets) in enumerate(streams) for i, (granule, page) in enumerate(stream_pages(serial, packets))]
    return b"".join(p[3] for p in sorted(pages, key=lambda p: (p[2] > 0, p[0], p[1], p[2])))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    #: How many packets end on the page that gave each granule, counted back from it.
    back: list[int] = field(default_factory=list)
    pages: int = 0
    holes: int = 0
    ended: bool = False
    part: list[bytes] | None = None
    number: int | None = None

    def ends(self, duration: Callable[[bytes], int] | None = None) -> list[int | None]:
        """End granule of each packet: the page's granule less the durations of later packets on that page.

        Without a rule for durations only the last packet of a page has one.
        """
        out: list[int | None] = [None] * len(self.packets)
        later = 0
        for i in range(len(self.packets) - 1, -1, -1):
            if self.granules[i] == NO_GRANULE:
                continue
            if self.back[i] == 0:
                out[i], later = self.granules[i], 0
            elif duration:
                later += duration(self.packets[i + 1])
                out[i] = self.granules[i] - later
        return out


def demux(data: bytes) -> tuple[dict[int, Stream], dict[str, int]]:
    """Logical streams by serial number, and counts of good pages, bad pages and skipped bytes."""
    streams: dict[int, Stream] = {}
    good = bad = skipped = 0
    at, size = 0, len(data)
    while at < size:
        found = data.find(CAPTURE, at)
        if found < 0:
            skipped += size - at
            break
        skipped += found - at
        at = found
        if size - at < _HEAD.size:
            bad, skipped = bad + 1, skipped + size - at
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        start = at + _HEAD.size + n
        laces = data[at + _HEAD.size : start]
        stop = start + sum(laces)
        page = data[at:stop]
        if version or len(laces) < n or stop > size or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            bad, skipped, at = bad + 1, skipped + 1, at + 1
            continue
        good += 1
        s = streams.setdefault(serial, Stream())
        s.pages += 1
        if s.number is not None and number != s.number + 1:
            s.holes, s.part = s.holes + 1, None
        s.number, s.ended = number, s.ended or bool(flags & LAST)
        if not flags & CONTINUED:
            s.part = []
        elif s.part == []:
            s.holes, s.part = s.holes + 1, None  # the page continues a packet whose start is lost
        begin = pos = start
        ended_here = len(s.packets)
        for lace in laces:
            pos += lace
            if lace < 255:
                if s.part is not None:
                    s.packets.append(b"".join([*s.part, data[begin:pos]]))
                begin, s.part = pos, []
        if begin < pos and s.part is not None:
            s.part.append(data[begin:pos])
        count = len(s.packets) - ended_here
        s.granules += [granule] * count
        s.back += range(count - 1, -1, -1)
        at = stop
    return streams, {"pages": good, "bad_pages": bad, "skipped": skipped}


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or 64 * (not text))


def encode_payload(payload: bytes) -> bytes:
    """Unsigned 8-bit samples in one stream, each block's extremes and sum in another."""
    setup = _SETUP.pack(SAMPLES_MAGIC, RATE, len(payload))
    samples, envelope = [(setup, 0)], [(_SETUP.pack(ENVELOPE_MAGIC, RATE, BLOCK), 0)]
    for at in range(0, len(payload), BLOCK):
        block = payload[at : at + BLOCK]
        ends = at + len(block)
        samples.append((block, ends))
        envelope.append((struct.pack("<BBI", min(block), max(block), sum(block)), ends))
    return mux([(SAMPLES_SERIAL, samples), (ENVELOPE_SERIAL, envelope)])


def decode_payload(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples read back, with checks of length, envelope and times in the counts."""
    streams, counts = demux(media)
    s, e = streams[SAMPLES_SERIAL], streams[ENVELOPE_SERIAL]
    magic, rate, length = _SETUP.unpack(s.packets[0])
    payload = b"".join(s.packets[1:])
    ends = s.ends(len)[1:]
    if magic != SAMPLES_MAGIC or len(payload) != length or ends != [min(length, BLOCK * (i + 1)) for i in range(len(ends))]:
        raise ValueError("the stored samples are incomplete")
    for block, mark in zip(s.packets[1:], e.packets[1:], strict=True):
        if struct.unpack("<BBI", mark) != (min(block), max(block), sum(block)):
            raise ValueError("the envelope does not fit the samples")
    counts |= {"streams": len(streams), "packets": sum(len(x.packets) for x in streams.values()), "ms": ends[-1] * 1000 // rate, "holes": s.holes + e.holes}
    return payload, counts


def features(payload: bytes, counts: dict[str, int]) -> str:
    """Container counts, duration, and level, crossing and entropy figures of the samples as integers."""
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    p = hist[hist > 0] / len(x)
    entropy = int(round(float(-(p * np.log2(p)).sum()) * 1000))
    high = x >= 96
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    return f"streams={counts['streams']};pages={counts['pages']};packets={counts['packets']};ms={counts['ms']};mean={mean};entropy={entropy};crossings={crossings}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        out: list[list] = [[] for _ in range(7)]
        for text in texts_of(batch):
            media = encode_payload(payload_of(text))
            payload, counts = decode_payload(media)
            row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, counts))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def ogg_digests(docs: DataFrame) -> DataFrame:
    """Store every whole text as Ogg, read it back and return digests and features.

    Null and empty texts give the 64-byte zero payload; a null doc_id stays null; repeated
    rows give repeated rows; an empty table gives no row; columns besides doc_id and text
    are not looked at. Map-only: no shuffle, one document in memory at a time.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), _digests, _SCHEMA)


_MEDIA = "doc_id long, media binary"
_PACKETS = "doc_id long, serial long, packet_no long, packet binary, end_granule long, end_ms long, bad_pages long, holes long"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        media = [encode_payload(payload_of(text)) for text in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "media"):
        rows = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            streams, counts = demux(data or b"")
            for serial, s in sorted(streams.items()):
                ours = s.packets and s.packets[0][:8] in (SAMPLES_MAGIC, ENVELOPE_MAGIC)
                ends = s.ends({SAMPLES_SERIAL: len, ENVELOPE_SERIAL: lambda _: BLOCK}.get(serial) if ours else None)
                rate = _SETUP.unpack(s.packets[0])[1] if ours else 0
                for i, (packet, end) in enumerate(zip(s.packets, ends, strict=True)):
                    rows.append((doc_id, serial, i, packet, end, end * 1000 // rate if rate and end is not None else None, counts["bad_pages"], s.holes))
        if rows:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PACKETS.split(", ")])


def to_ogg(docs: DataFrame) -> DataFrame:
    """A media column: each text's payload as one Ogg file (doc_id, media)."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), _media, _MEDIA)


def ogg_packets(media: DataFrame) -> DataFrame:
    """All packets of a media column, demultiplexed, one row per packet; null or foreign bytes give none."""
    return map_arrow(media.select(F.col("doc_id").cast("long"), F.col("media")), _packets, _PACKETS)
