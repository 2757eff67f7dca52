import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import ogg


def slow_checksum(data):
    register = 0
    for byte in data:
        register ^= byte << 24
        for _ in range(8):
            register = (register << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if register >> 31 else register << 1
    return register


def test_checksum_equals_bitwise_division():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("sizes", [[0], [254, 255, 256, 0, 510], [70_000, 3, 65_025, 65_026], [1] * 700])
def test_packets_survive_any_lacing(sizes):
    rng = random.Random(2)
    one = [(rng.randbytes(n), i) for i, n in enumerate(sizes)]
    two = [(b"x", 5), (b"", 9)]
    streams, counts = ogg.demux(ogg.mux([(7, one), (9, two)]))
    assert streams[7].packets == [p for p, _ in one] and streams[9].packets == [b"x", b""]
    assert counts["bad_pages"] == counts["skipped"] == 0
    assert streams[7].ended and streams[7].ends()[-1] == len(sizes) - 1


def test_damage_drops_whole_packets_only():
    packets = [(bytes([i]) * 9000, 9000 * (i + 1)) for i in range(40)]
    media = bytearray(ogg.mux([(1, packets)]))
    media[len(media) // 2] ^= 1
    streams, counts = ogg.demux(bytes(media))
    assert counts["bad_pages"] >= 1 and streams[1].holes == 1
    assert 0 < len(streams[1].packets) < 40 and set(streams[1].packets) <= {p for p, _ in packets}
    got = dict(zip(streams[1].packets, streams[1].ends(len), strict=True))
    assert all(got[p] == end for p, end in packets if p in got)


def test_truncated_and_foreign_bytes():
    assert ogg.demux(b"")[0] == {} and ogg.demux(b"OggS")[1]["bad_pages"] == 1
    media = ogg.encode_payload(ogg.payload_of(b"hello" * 5000))
    assert ogg.demux(media[:-10])[1]["bad_pages"] == 1
    assert ogg.demux(b"junk" + media)[1]["skipped"] == 4


def test_round_trip_of_rows(spark):
    texts = [None, "", "a", "é" * 64, "x" * 300_000, "a"]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "a", "extra")], "doc_id long, text string, media string")
    rows = ogg.ogg_digests(docs).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows}
    assert (by[0].n_bytes, by[0].payload_bytes, by[0].tail_crc32) == (0, 64, zlib.crc32(bytes(64)))
    assert by[3].n_bytes == 128 == by[3].payload_bytes
    assert by[2][1:] == by[5][1:] == by[None][1:]
    packets = ogg.ogg_packets(ogg.to_ogg(docs.where("doc_id = 4"))).where(f"serial = {ogg.SAMPLES_SERIAL} and packet_no > 0").orderBy("packet_no").collect()
    assert b"".join(bytes(p.packet) for p in packets) == ogg.payload_of(b"x" * 300_000)
    assert [p.end_ms for p in packets][-1] == 300_032 * 1000 // ogg.RATE
    assert ogg.ogg_digests(docs.where("false")).count() == 0


TABLE = [slow_checksum(bytes([i])) for i in range(256)]


def plain_packets(media):
    """Packets by serial of a whole, sound Ogg file: read page by page from the format's description, nothing shared with the operator."""
    packets, part, numbers, pages, at = defaultdict(list), defaultdict(bytes), {}, 0, 0
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        whole = lambda a, n: int.from_bytes(media[at + a : at + a + n], "little")  # noqa: B023, E731
        serial, number, laces = whole(14, 4), whole(18, 4), media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(laces)
        stop = body + sum(laces)
        crc = 0
        for i in range(at, stop):
            crc = (crc << 8 ^ TABLE[crc >> 24 ^ (0 if 22 <= i - at < 26 else media[i])]) & 0xFFFFFFFF
        assert crc == whole(22, 4) and number == numbers.get(serial, -1) + 1 and bool(media[at + 5] & 1) == bool(part[serial])
        numbers[serial] = number
        for lace in laces:
            part[serial] += media[body : body + lace]
            body += lace
            if lace < 255:
                packets[serial].append(part.pop(serial, b""))
        pages, at = pages + 1, stop
    return packets, pages


def test_whole_table_by_an_independent_reader(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    media = {r.doc_id: bytes(r.media) for r in ogg.to_ogg(docs).collect()}
    rows = {r.doc_id: r for r in ogg.ogg_digests(docs).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert rows.keys() == media.keys() == texts.keys()
    for doc_id, text in texts.items():
        r, (packets, pages) = rows[doc_id], plain_packets(media[doc_id])
        samples = b"".join(packets[ogg.SAMPLES_SERIAL][1:])
        assert samples[: len(text)] == text and not samples[len(text) :].strip(b"\0") and len(samples) % 64 == 0 < len(samples) < len(text) + 65
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[doc_id]), hashlib.sha256(media[doc_id]).hexdigest())
        given = dict(x.split("=") for x in r.feature.split(";"))
        entropy = -sum(n / len(samples) * math.log2(n / len(samples)) for n in Counter(samples).values())
        crossings = sum((a >= 96) != (b >= 96) for a, b in zip(samples, samples[1:], strict=False))
        want = (2, pages, sum(map(len, packets.values())), len(samples) * 1000 // ogg.RATE, sum(samples) * 1000 // len(samples), crossings)
        assert tuple(int(given[k]) for k in ("streams", "pages", "packets", "ms", "mean", "crossings")) == want
        assert abs(int(given["entropy"]) - entropy * 1000) <= 0.51
