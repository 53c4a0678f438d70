"""Media columns: lossless storage of samples in Ogg, and a reader that trusts nothing but verified pages.

Writing: a payload of 8-bit samples is cut into packets, whose pages go by turns to two logical streams, each with an
identification packet and a comment packet; the pages are interleaved in one physical stream. Reading takes any raw
PCM, of any sample width, channels and number of streams: every page's checksum is verified, packets are reassembled
from the lacing values (also over page borders), the pages are demultiplexed by serial number, and each audio packet
gets its time stamp from its page's granule position, which dates the end of the page's last packet. Merging the
packets of all streams by time stamp gives the payload back.

Cases: a null text is an empty one; an empty payload is padded like any other, so each file has samples; texts of any
length are stored whole; a page with a wrong checksum, a gap in the page numbers or an unfinished packet raises
OggError, as do streams that overlap in time when they are merged. Other columns of the table are not read, so their
names don't matter; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import common

# Fixed values of the Ogg container (RFC 3533) and of the raw PCM mapping's identification packet: its fields are magic,
# version (major, minor), format, rate, significant bits, channels, frames of a packet at most, further header packets.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEAD = "<4sBBqIIIB"
PCM_ID = ">8sHHIIBBHI"
PCM_MAGIC, PCM_U8, RATE = b"PCM     ", 1, 8000
#: Bytes of a sample by format: whole numbers of 8 to 32 bits, mu-law and A-law, floating point.
WIDTHS = {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 16: 1, 17: 1, 32: 4, 33: 4, 34: 8, 35: 8}

#: Samples of a frame (one packet), packets of a page at most, and bytes to which a payload is padded.
FRAME, PAGE_PACKETS, UNIT = 576, 56, 576
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (most significant bit first, start 0, no final inversion).

    It is zlib's CRC-32 of the bit-mirrored bytes, mirrored back, with zlib's inversions taken out.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEAD, CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class _Stream:
    """Turns the packets of one logical stream into pages; a packet that doesn't fit goes on in the next page."""

    def __init__(self, serial: int):
        self.serial, self.number, self.lacing, self.body, self.granule, self.carried = serial, 0, b"", [], -1, False

    def flush(self, flags: int = 0) -> bytes:
        page = _page(self.serial, self.number, flags | CONTINUED * self.carried, self.granule, self.lacing, b"".join(self.body))
        self.number, self.lacing, self.body, self.granule, self.carried = self.number + 1, b"", [], -1, False
        return page

    def put(self, packet: bytes, granule: int, flags: int = 0) -> Iterator[bytes]:
        """Adds a packet; yields the pages that were filled by it."""
        lacing = _lacing(len(packet))
        while len(self.lacing) + len(lacing) > 255:
            room = 255 - len(self.lacing)
            if room:
                self.lacing += lacing[:room]
                self.body.append(packet[: 255 * room])
                packet, lacing = packet[255 * room :], lacing[room:]
            yield self.flush(flags)
            self.carried = bool(room) or self.carried
        self.lacing += lacing
        self.body.append(packet)
        self.granule = granule


def header(kind: int, rate: int, channels: int) -> bytes:
    return struct.pack(PCM_ID, PCM_MAGIC, 0, 0, kind, rate, 0, channels, 0, 0)


def comment() -> bytes:
    vendor = b"argentum"
    return struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", 0)


def write_ogg(payload: bytes, serial: int | None = None) -> bytes:
    """The payload's 8-bit samples as an Ogg file with two logical streams, which take turns by page.

    Both count on the payload's time: the granule position of a page is the sample at which its last packet ends.
    """
    serial = zlib.crc32(payload) & 0x7FFFFFFE if serial is None else serial
    streams = [_Stream(serial), _Stream(serial + 1)]
    out: list[bytes] = []
    for s in streams:
        out += s.put(header(PCM_U8, RATE, 1), 0)
        out.append(s.flush(FIRST))
    for s in streams:
        out += s.put(comment(), 0)
        out.append(s.flush())
    whole = FRAME * PAGE_PACKETS
    pages = range(0, len(payload), whole)
    for n, start in enumerate(pages):
        s = streams[n % 2]
        for at in range(start, min(start + whole, len(payload)), FRAME):
            out += s.put(payload[at : at + FRAME], min(at + FRAME, len(payload)))
        if n + 2 < len(pages):
            out.append(s.flush())
    return b"".join(out + [s.flush(LAST) for s in streams])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """(serial, number, flags, granule, lacing, where the body begins) of each verified page."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or at + 27 > len(media):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or end > len(media):
            raise OggError(f"broken page at byte {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield serial, number, flags, granule, lacing, at + 27 + n
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[int, bytes, bool]]]:
    """By serial number: (granule position, packet, is it the last that ends on its page) of each packet.

    A page's granule position holds for the last packet that ends on it; the others get -1.
    """
    packets: dict[int, list[tuple[int, bytes, bool]]] = {}
    parts: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    for serial, number, flags, granule, lacing, at in read_pages(media):
        if flags & FIRST:
            if serial in packets:
                raise OggError(f"stream {serial} begins twice")
            packets[serial], parts[serial], numbers[serial] = [], [], 0
        if serial not in packets or serial in ended or number != numbers[serial]:
            raise OggError(f"page {number} of stream {serial} is out of order")
        numbers[serial] += 1
        if bool(flags & CONTINUED) != bool(parts[serial]):
            raise OggError(f"page {number} of stream {serial} doesn't go on with a packet as it says")
        mine = packets[serial]
        first, size = len(mine), 0
        for x in lacing:
            size += x
            if x < 255:
                mine.append((-1, b"".join([*parts[serial], media[at : at + size]]), False))
                parts[serial], at, size = [], at + size, 0
        if size or (lacing and lacing[-1] == 255):
            parts[serial].append(media[at : at + size])
        if len(mine) > first:
            mine[-1] = (granule, mine[-1][1], True)
        if flags & LAST:
            ended.add(serial)
    if any(parts.values()) or ended != set(packets):
        raise OggError("a packet or a stream doesn't end")
    return packets


def read_streams(media: bytes) -> list[dict]:
    """What is known of each logical stream, and its audio: (first frame, last frame, bytes) of each packet."""
    found = []
    for serial, packets in demultiplex(media).items():
        size = struct.calcsize(PCM_ID)
        if len(packets) < 2 or len(packets[0][1]) < size or packets[0][1][:8] != PCM_MAGIC:
            raise OggError(f"stream {serial} isn't raw PCM")
        _, _, _, kind, rate, _, channels, _, extra = struct.unpack_from(PCM_ID, packets[0][1])
        if kind not in WIDTHS or not channels:
            raise OggError(f"stream {serial} has samples of an unknown kind")
        unit = WIDTHS[kind] * channels
        audio: list[tuple[int, int, bytes]] = []
        run: list[bytes] = []
        for granule, packet, last in packets[2 + extra :]:
            if len(packet) % unit:
                raise OggError(f"a packet of stream {serial} has part of a frame")
            run.append(packet)
            if last:
                # The granule position dates the end of the last packet; those before it on the page end where the next begins.
                end, dated = granule, []
                for p in reversed(run):
                    dated.append((end - len(p) // unit, end, p))
                    end -= len(p) // unit
                audio += reversed(dated)
                run = []
        found.append({"serial": serial, "kind": kind, "rate": rate, "channels": channels, "packets": len(audio), "samples": sum(e - s for s, e, _ in audio), "last_granule": max((e for _, e, _ in audio), default=0), "audio": audio})
    return found


def read_ogg(media: bytes) -> tuple[bytes, list[dict]]:
    """The payload, merged from all streams by time stamp, and what is known of each stream."""
    streams = read_streams(media)
    if len({(s["kind"], s["rate"], s["channels"]) for s in streams}) > 1:
        raise OggError("streams of different kinds can't be merged")
    stamped = sorted((p for s in streams for p in s.pop("audio")), key=lambda p: p[:2])
    at = stamped[0][0] if stamped else 0
    for start, end, _ in stamped:
        if start != at:
            raise OggError(f"samples {at} to {start} are missing or twice there")
        at = end
    return b"".join(p for _, _, p in stamped), streams


def describe(payload: bytes, streams: list[dict]) -> str:
    """Features of the decoded samples and of the streams, as text."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean())
    power = float(np.square(x, dtype=np.uint32).mean(dtype=np.float64))
    centred = x >= 128
    return (
        f"streams={len(streams)};packets={sum(s['packets'] for s in streams)};samples={len(x)}"
        f";end_s={max(s['last_granule'] for s in streams) / streams[0]['rate']:.4f};mean={mean:.4f};rms={power**0.5:.4f}"
        f";crossings={int(np.count_nonzero(centred[1:] != centred[:-1]))};peak={int(x.max())}"
    )


def pad(text: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of UNIT."""
    return text + b"\xff" * ((-len(text)) % UNIT or (UNIT if not text else 0))


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            media = write_ogg(pad(raw))
            payload, streams = read_ogg(media)
            rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload, streams)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def to_ogg(df: DataFrame, key: str, text: str, media: str = "media") -> DataFrame:
    """(key, media): each text's UTF-8 bytes, padded, as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [write_ogg(pad(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[key, media])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, `{media}` binary")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from each text's Ogg file; nothing is shuffled."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests, SCHEMA)


common.ship(sys.modules[__name__])
