"""Operator 1, media columns: the Ogg container.

Pages carry a CRC-32 (polynomial 04c11db7, most significant bit first), a lacing
table that cuts their body into packets (a packet may run over several pages),
a logical stream's serial number and a granule position from which the time of
the last packet that ends on the page follows.

Defined edge cases: a null text is the empty text; an empty payload is padded to
64 zero bytes; texts of any length work (packets continue over pages); equal
texts give equal values; repeated rows are answered row by row; stored bytes that are null, damaged or no
container have a reason in ``error`` and nulls in what is read from them; an empty table
gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, PACKET, TRACKS = 8000, 4096, 2


def page_crc(page: bytes) -> int:
    """The container's CRC through zlib's: the same polynomial, with bits of bytes and of the result reversed."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def write_stream(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> list[bytes]:
    """Pages of one logical stream of (packet, granule position at its end); the first packet has a page of its own."""
    pages, lacing, body, done, fresh = [], bytearray(), bytearray(), -1, True
    flags = FIRST

    def flush(last: bool) -> None:
        nonlocal lacing, body, done, flags
        pages.append(_page(flags | (LAST if last else 0), done, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, done, flags = bytearray(), bytearray(), -1, 0

    for i, (data, granule) in enumerate(packets):
        full, rest = divmod(len(data), 255)
        values, at = [255] * full + [rest], 0
        while values:
            room = segments - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += bytes(part)
            body += data[at : at + size]
            at += size
            if values:
                flush(False)
                flags = CONTINUED
        done = granule
        if i == len(packets) - 1:
            flush(True)
        elif fresh or len(lacing) == segments:
            flush(False)
        fresh = False
    return pages


class Packet(NamedTuple):
    data: bytes
    #: end position in samples, and in seconds, where the page tells it (the last packet that ends on it)
    granule: int | None
    seconds: float | None


class Container(NamedTuple):
    streams: dict[int, list[Packet]]
    pages: int
    bad_pages: int
    #: packets that lost a part to a missing or damaged page
    broken: int


def read_container(media: bytes | None, rate: int = RATE) -> Container:
    """Demultiplex a physical stream. Pages with a wrong checksum, version or length are skipped and counted, and reading goes on
    at the next capture pattern; packets that run over a lost page are dropped and counted."""
    media = media or b""
    streams: dict[int, list[Packet]] = {}
    parts: dict[int, bytearray | None] = {}
    numbers: dict[int, int] = {}
    pages = bad = broken = 0
    at = media.find(b"OggS")
    while at >= 0:
        if len(media) - at < 27:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < count or len(page) < end - at or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 4)
            continue
        pages += 1
        out = streams.setdefault(serial, [])
        pending = parts.get(serial)
        if number != numbers.get(serial, -1) + 1 or bool(flags & CONTINUED) != (pending is not None):
            broken += pending is not None or bool(flags & CONTINUED)
            pending = None
            skip = bool(flags & CONTINUED)
        else:
            skip = False
        numbers[serial] = number
        ends, pos = [], at + 27 + count
        for v in lacing:
            if not skip:
                pending = bytearray() if pending is None else pending
                pending += media[pos : pos + v]
            pos += v
            if v < 255:
                if not skip:
                    ends.append(bytes(pending))
                pending, skip = None, False
        for i, data in enumerate(ends):
            known = granule >= 0 and i == len(ends) - 1
            out.append(Packet(data, granule if known else None, granule / rate if known else None))
        parts[serial] = pending
        if end < len(media) and media[end : end + 4] != b"OggS":
            bad += 1  # bytes that belong to no page: a page whose capture pattern is damaged
        at = media.find(b"OggS", end)
    broken += sum(p is not None for p in parts.values())
    return Container(streams, pages, bad, broken)


def encode(payload: bytes) -> bytes:
    """A payload as 8-bit samples: block i of PACKET samples goes to track i mod TRACKS; the tracks' pages are interleaved."""
    tracks = []
    for t in range(TRACKS):
        packets, granule = [(b"PCM8" + struct.pack("<BBIQ", t, TRACKS, RATE, len(payload)), 0)], 0
        for at in range(t * PACKET, len(payload), TRACKS * PACKET):
            block = payload[at : at + PACKET]
            granule += len(block)
            packets.append((block, granule))
        tracks.append(write_stream(1000 + t, packets))
    turns = max(map(len, tracks))
    return b"".join(pages[i] for i in range(turns) for pages in tracks if i < len(pages))


def decode(media: bytes) -> tuple[bytes, str]:
    """The payload of a container that ``encode`` wrote, and what was measured on the way."""
    box = read_container(media)
    heads = sorted((struct.unpack("<BBIQ", p[0].data[4:]), s) for s, p in box.streams.items() if p and p[0].data[:4] == b"PCM8")
    if box.bad_pages or box.broken or not heads or len(heads) != heads[0][0][1]:
        raise ValueError("damaged container")
    tracks = [box.streams[s][1:] for _, s in heads]
    payload = b"".join(t[i].data for i in range(max(map(len, tracks))) for t in tracks if i < len(t))
    if len(payload) != heads[0][0][3]:
        raise ValueError("samples are missing")
    last = [next((p.seconds for p in reversed(box.streams[s]) if p.seconds is not None), 0.0) for _, s in heads]
    said = f"streams={len(box.streams)};pages={box.pages};packets={sum(map(len, box.streams.values()))};ms={','.join(str(round(1000 * x)) for x in last)};mean={sum(payload) / len(payload):.4f}"
    return payload, said


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as UTF-8, zero-padded to a positive multiple of 64 and stored in a container."""

    def each(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [encode(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], schema=_ENCODED)

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(each, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Read stored containers (doc_id, n_bytes, media) back and digest them; ``error`` is null where all went well."""

    def each(batches):
        for b in batches:
            out = []
            for media in b.column(2).to_pylist():
                stored_as = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                try:
                    payload, feature = decode(media)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored_as, feature, None))
                except (ValueError, struct.error) as e:
                    out.append((None, None, None, *stored_as, None, str(e)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in out], _READ.field(i + 2).type) for i in range(7))], schema=_READ)

    return stored.mapInArrow(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def demux(df: DataFrame, media_col: str = "media", id_col: str = "media_id") -> DataFrame:
    """One row per packet of arbitrary containers: id, serial, packet_no, n_bytes, granule, seconds, data. Damaged pages yield no packets; null or foreign bytes yield no rows."""

    def each(batches):
        for b in batches:
            rows = [(i, s, n, len(p.data), p.granule, p.seconds, p.data) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, ps in sorted(read_container(m).streams.items()) for n, p in enumerate(ps)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[id_col, "serial", "packet_no", "n_bytes", "granule", "seconds", "data"])

    return df.selectExpr(f"cast(`{id_col}` as long)", f"`{media_col}`").mapInArrow(each, f"{id_col} long, serial long, packet_no int, n_bytes long, granule long, seconds double, data binary")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(documents(spark, sf_dir)))


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES: dict[str, str] = {}
