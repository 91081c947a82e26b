"""Media columns: Ogg physical streams, written and read back page by page.

`mux` cuts each logical stream's packets into pages by their lacing values and signs every page with
the container's checksum. `demux` is the reader: it finds pages by their capture pattern, verifies
checksum, version and page order, joins the lacing segments to packets across pages, separates logical
streams by serial number and turns granule positions into times. A page that fails its checksum is
reported in `Stream.bad_pages` and its packets are dropped, as a decoder does; `strict` raises instead.

`media_columns` stores every text of a table this way. A text's UTF-8 bytes are padded by 255 to a
positive multiple of 576, one packet holds 576 samples of 8 bits, and packets alternate between two logical
streams (even, odd), so that reading needs real demultiplexing. Empty and null texts give one packet of
padding; equal texts give equal bytes, since nothing but the text goes in. Extra columns are ignored;
rows with equal ids each give a row; a null id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows, text_sizes, texts_of

BLOCK = 576
RATE = 48_000
SERIALS = (0x53494556, 0x53494557)

#: Fixed values of the container format (RFC 3533): capture pattern, header layout, flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SEGMENTS = 255

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(data: bytes) -> int:
    """The page checksum: CRC-32 of polynomial 0x04C11DB7, most significant bit first, starting from 0.

    That is zlib's CRC with the bits of each byte and of the result mirrored and its inversions undone.
    """
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages(packets: list[bytes], serial: int, granules: list[int], segments: int = SEGMENTS) -> Iterator[tuple[int, bytes]]:
    """(granule, page) of one logical stream; a page has the granule of the last packet it ends, or -1."""
    lacing, body, ends, sequence, going = bytearray(), bytearray(), -1, 0, False
    total = sum(len(p) // 255 + 1 for p in packets)
    done = 0

    def flush() -> bytes:
        nonlocal sequence
        flags = CONTINUED * going | FIRST * (sequence == 0) | LAST * (done == total)
        out = page(serial, sequence, ends, flags, bytes(lacing), bytes(body))
        sequence += 1
        return out

    for packet, granule in zip(packets, granules, strict=True):
        for i in range(len(packet) // 255 + 1):
            if len(lacing) == segments:
                yield ends, flush()
                lacing, body, ends, going = bytearray(), bytearray(), -1, i > 0
            part = packet[255 * i : 255 * i + 255]
            lacing.append(len(part))
            body += part
            done += 1
        ends = granule
    if lacing or not packets:
        yield ends, flush()


def mux(streams: dict[int, tuple[list[bytes], list[int]]], segments: int = SEGMENTS) -> bytes:
    """Interleaves logical streams (serial: packets, granules) by granule; the first pages of all come first."""
    made = {s: list(pages(p, s, g, segments)) for s, (p, g) in streams.items()}
    out = [x[0][1] for x in made.values()]
    rest, last = [], 0
    for k, (_, x) in enumerate(made.items()):
        last = 0
        for i, (granule, data) in enumerate(x[1:]):
            last = max(last, granule)
            rest.append((last, k, i, data))
    return b"".join(out + [x[3] for x in sorted(rest, key=lambda x: x[:3])])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    bad_pages: int = 0
    gaps: int = 0
    ended: bool = False

    def times(self, rate: int = RATE) -> list[float]:
        """The end of each packet in seconds; a packet without a granule of its own takes the next one's."""
        out, at = [], None
        for g in reversed(self.granules):
            at = g if g >= 0 else at
            out.append((at or 0) / rate)
        return out[::-1]


def demux(data: bytes, strict: bool = True) -> dict[int, Stream]:
    """The logical streams of a physical stream, by serial number, in order of their first page."""
    streams: dict[int, Stream] = {}
    parts: dict[int, bytearray | None] = {}
    expect: dict[int, int] = {}
    at = 0
    while (found := data.find(CAPTURE, at)) >= 0:
        if strict and found != at:
            raise OggError(f"{found - at} bytes outside of pages at {at}")
        at = found
        if at + HEADER.size > len(data):
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        s = streams.get(serial) or streams.setdefault(serial, Stream(serial))
        if version or len(lacing) < n or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            if strict:
                raise OggError(f"the page at {at} fails its checksum")
            s.bad_pages += 1
            at += len(CAPTURE)
            continue
        if sequence != expect.get(serial, sequence if not strict else 0) or bool(flags & FIRST) != (s.pages == 0):
            if strict:
                raise OggError(f"the page at {at} is out of order")
            s.gaps += 1
            parts[serial] = None
        expect[serial] = sequence + 1
        s.pages += 1
        s.ended |= bool(flags & LAST)
        part = parts.get(serial)
        if not flags & CONTINUED:
            part = bytearray()
        whole: list[bytes] = []
        for size in lacing:
            if part is not None:
                part += data[start : start + size]
            start += size
            if size < 255:
                if part is not None:
                    whole.append(bytes(part))
                part = bytearray()
        parts[serial] = part
        s.packets += whole
        s.granules += [-1] * (len(whole) - 1) + [granule] * bool(whole)
        at = end
    if strict and (at != len(data) or not all(s.ended for s in streams.values())):
        raise OggError("the stream ends early")
    return streams


def encode(payload: bytes) -> bytes:
    """The payload as packets of 576 samples, dealt in turn to two logical streams of one physical stream."""
    packets = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    ends = [BLOCK * (i + 1) for i in range(len(packets))]
    return mux({s: (packets[k::2], ends[k::2]) for k, s in enumerate(SERIALS) if packets[k::2] or not k})


def decode(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload: the packets of both streams in turn. Its order is checked against the granules."""
    streams = demux(media)
    even, odd = (streams[s].packets if s in streams else [] for s in SERIALS)
    if not 0 <= len(even) - len(odd) <= 1:
        raise OggError("the streams do not belong together")
    out = [b""] * (len(even) + len(odd))
    out[::2], out[1::2] = even, odd
    for k, s in enumerate(SERIALS):
        for i, g in enumerate(streams[s].granules if s in streams else []):
            if g >= 0 and g != BLOCK * (2 * i + k + 1):
                raise OggError("a granule position does not fit its packet")
    return b"".join(out), streams


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration, level and crossings of the samples (unsigned, centred on 128), and the layout, as JSON."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    f = {
        "seconds": round(max(t for s in streams.values() for t in s.times()[-1:]), 6),
        "pages": [s.pages for s in streams.values()],
        "packets": [len(s.packets) for s in streams.values()],
        "mean": round(float(x.mean()), 4),
        "rms": round(float(np.sqrt(np.square(x, dtype=np.int64).mean())), 4),
        "peak": int(np.abs(x).max()),
        "crossings": int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))),
    }
    return json.dumps(f, separators=(",", ":"))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, text_sizes(), 4 << 20):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
            data = text.encode()
            media = encode(pad(data))
            payload, streams = decode(media)
            sha = lambda d: hashlib.sha256(d).hexdigest()
            row = (doc_id, len(data), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), features(payload, streams))
            rows.append((*row, media) if keep_media else row)
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * keep_media
        types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")] + [pa.binary()] * keep_media
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each document's text stored as Ogg, read back and described; with `keep_media` the stored bytes too."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _rows(it, keep_media), SCHEMA + ", media binary" * keep_media)
