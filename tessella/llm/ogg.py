"""Ogg container: pages, lacing, checksums, logical streams and granule positions.

An Ogg file is a run of pages. Each page belongs to a logical stream (its serial number), carries up to 255 lacing
values and a CRC-32 (polynomial 0x04C11DB7, not reflected, zero start). A packet is the bytes of consecutive lacing
values up to one below 255, and may go on over pages. The granule position of a page is the stream time at the end of
the last packet that ends on it, or -1.

Defined results: a null text is empty; an empty text becomes one unit of padding; equal texts give equal bytes. A
long text is encoded whole, over as many pages as it takes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.arrow import map_rows, texts

UNIT, RATE, STREAMS, PAD = 576, 8000, 2, 0xFF
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_INFO = struct.Struct("<8sIHBBQ")
_MAGIC = b"\x01raw8pcm"
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes


class Packet(NamedTuple):
    data: bytes
    granule: int  # of the page on which it ends, if it is the last to end there; else -1


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC by way of zlib's reflected one: turn the bits of each byte, and of the result."""
    crc = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_TURNED), "big")


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; each packet comes with its end time. The first packet stands alone on its page."""
    pages: list[bytes] = []
    lacing, body, granule, going_on = bytearray(), [], -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, going_on
        flags = CONTINUED * going_on | FIRST * (not pages) | LAST * last
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, len(pages), 0, len(lacing)) + bytes(lacing)
        data = b"".join((head, *body))
        pages.append(data[:22] + struct.pack("<I", checksum(data)) + data[26:])
        lacing, body, granule = bytearray(), [], -1

    for i, (data, end) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1
        while left:
            take = min(left, 255 - len(lacing))
            size = min(len(data) - at, 255 * take)
            lacing += b"\xff" * (take - 1) + bytes([255 if left > take else len(data) % 255])
            body.append(data[at : at + size])
            at, left = at + size, left - take
            if not left:
                granule = end
            if len(lacing) == 255 and (left or i + 1 < len(packets)):
                close(False)
                going_on = left > 0
            elif not left:
                going_on_next = False
                if i == 0 and len(packets) > 1:
                    close(False)
                    going_on = going_on_next
    close(True)
    return pages


def pages(data: bytes) -> Iterator[Page]:
    """Reads the pages one after another and verifies each checksum."""
    at, n = 0, len(data)
    while at < n:
        if n - at < 27 or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > n:
            raise OggError(f"broken page at byte {at}")
        if checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        yield Page(flags, granule, serial, sequence, lacing, data[start:end])
        at = end


def demultiplex(data: bytes) -> dict[int, list[Packet]]:
    """Packets of each logical stream, by serial number, put together again from the lacing values."""
    found: dict[int, list[Packet]] = {}
    begun: dict[int, list[bytes]] = {}
    count: dict[int, int] = {}
    for p in pages(data):
        own = found.setdefault(p.serial, [])
        if p.sequence != count.get(p.serial, 0) or bool(p.flags & FIRST) != (p.sequence == 0):
            raise OggError(f"page {p.sequence} of stream {p.serial} is out of order")
        part = begun.setdefault(p.serial, [])
        if bool(part) != bool(p.flags & CONTINUED):
            raise OggError(f"a packet of stream {p.serial} is cut")
        count[p.serial] = p.sequence + 1
        at = from_ = 0
        first = len(own)
        for lace in p.lacing:
            at += lace
            if lace < 255:
                own.append(Packet(b"".join((*part, p.body[from_:at])), -1))
                part.clear()
                from_ = at
        if from_ < at or (p.lacing and p.lacing[-1] == 255):
            part.append(p.body[from_:at])
        if len(own) > first:
            own[-1] = own[-1]._replace(granule=p.granule)
        if p.flags & LAST and part:
            raise OggError(f"stream {p.serial} ends inside a packet")
    return found


def encode(data: bytes, unit: int = UNIT, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """8-bit samples in packets of unit bytes, dealt in turn to the logical streams, whose pages go by time."""
    payload = data + bytes([PAD]) * (-len(data) % unit or (0 if data else unit))
    ways: list[list[tuple[bytes, int]]] = [[(_INFO.pack(_MAGIC, rate, unit, s, streams, len(data)), 0)] for s in range(streams)]
    for i, at in enumerate(range(0, len(payload), unit)):
        ways[i % streams].append((payload[at : at + unit], at + unit))
    made = [(struct.unpack_from("<q", p, 6)[0], n > 0, s, n, p) for s, w in enumerate(ways) for n, p in enumerate(paginate(w, s + 1))]
    made.sort(key=lambda x: (x[1], x[0] if x[0] >= 0 else 0, x[2], x[3]))
    return b"".join(x[4] for x in made)


class Sound(NamedTuple):
    payload: bytes
    n_bytes: int
    rate: int
    stamps: list[float]  # seconds at the end of each page's last packet, by time
    n_packets: int


def decode(data: bytes) -> Sound:
    """The samples in time order, with times derived from the granule positions."""
    ways = demultiplex(data)
    info = {s: _INFO.unpack(w[0].data) for s, w in ways.items()}
    if any(x[0] != _MAGIC for x in info.values()):
        raise OggError("unknown stream kind")
    _, rate, unit, _, streams, n_bytes = next(iter(info.values()))
    lanes = [w[1:] for _, w in sorted(ways.items(), key=lambda x: info[x[0]][3])]
    total = sum(map(len, lanes))
    payload = b"".join(lanes[i % streams][i // streams].data for i in range(total))
    for lane, w in enumerate(lanes):
        for j, p in enumerate(w):
            if p.granule >= 0 and p.granule != (j * streams + lane + 1) * unit:
                raise OggError("granule position and packets disagree")
    stamps = sorted(p.granule / rate for w in lanes for p in w if p.granule >= 0)
    return Sound(payload, n_bytes, rate, stamps, total)


def feature(sound: Sound) -> str:
    """Length, level, energy, peak and sign changes of the samples, as text of integers."""
    x = np.frombuffer(sound.payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    level = np.arange(256, dtype=np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    ms = round(1000 * sound.stamps[-1]) if sound.stamps else 0
    return f"ms={ms};packets={sound.n_packets};pages={len(sound.stamps)};sum={int(hist @ level)};energy={int(hist @ level**2)};peak={int(np.abs(level[hist > 0]).max(initial=0))};crossings={crossings}"


def add_media(docs: DataFrame, unit: int = UNIT, rate: int = RATE, streams: int = STREAMS) -> DataFrame:
    """doc_id, media (the Ogg bytes) and, read back from them, n_bytes, payload and feature. One narrow pass; a row in, a row out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                media = encode(text, unit, rate, streams)
                sound = decode(media)
                yield doc_id, media, sound.n_bytes, sound.payload, feature(sound)

    return map_rows(docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")), run, "doc_id long, media binary, n_bytes long, payload binary, feature string", lambda r: 2 * len(r[1]))


def media_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of add_media's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, media, n_bytes, payload, feat = (b.column(k)[i].as_py() for k in range(5))
                yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feat

    return map_rows(add_media(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
