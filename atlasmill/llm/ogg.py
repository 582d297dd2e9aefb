"""Media columns: lossless storage of bytes as 8-bit samples in an Ogg container, and its reading.

Pages follow RFC 3533: capture pattern, granule position, serial number, page sequence, CRC-32 with
polynomial 0x04c11db7 (most significant bit first, start 0) and lacing values. The reader verifies
every page's checksum and sequence, demultiplexes the logical streams by serial number, reassembles
packets from the lacing values, also across pages, and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .shared import per_text

MAGIC = b"S8RAW\0"
RATE = 8000
#: Samples in a packet; packets alternate between the logical streams.
PACKET = 4000
STREAMS = 2
BLOCK = 64
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<6sBBIQ")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC by zlib's: the polynomial is the same, so mirrored bytes give the mirrored sum."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEADER.pack(b"OggS", 0, kind, granule, serial, sequence, 0, len(lacing)) + lacing + body)
    page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
    return bytes(page)


class _Writer:
    """Pages of one logical stream: packets as (bytes, end granule)."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, kind: int, granule: int, lacing: bytes, body: bytes) -> bytes:
        self.sequence += 1
        return _page(kind, granule, self.serial, self.sequence - 1, lacing, body)

    def pages(self, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
        """The data pages; a packet that does not fit continues on the next page. The last page ends the stream."""
        lacing, body, granule, goes_on = bytearray(), bytearray(), -1, False
        for packet, end in packets:
            at, left = 0, [*[255] * (len(packet) // 255), len(packet) % 255]
            while left:
                room, now = 255 - len(lacing), left
                now, left = now[:room], now[room:]
                lacing += bytes(now)
                n = sum(now)
                body += packet[at : at + n]
                at += n
                granule = granule if left else end
                if len(lacing) == 255:
                    yield self.page(int(goes_on), granule, bytes(lacing), bytes(body))
                    lacing, body, granule, goes_on = bytearray(), bytearray(), -1, bool(left)
        yield self.page(4 | int(goes_on), granule if lacing else packets[-1][1] if packets else 0, bytes(lacing), bytes(body))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def mux(payload: bytes, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """The payload as samples: packets dealt in turn to the logical streams, whose pages are interleaved. Equal payloads give equal bytes."""
    base = zlib.crc32(payload)
    writers = [_Writer((base + k) & 0xFFFFFFFF) for k in range(streams)]
    out = []
    for k, w in enumerate(writers):
        ident = _IDENT.pack(MAGIC, k, streams, rate, len(payload))
        out.append(w.page(2, 0, bytes([len(ident)]), ident))
    dealt: list[list[tuple[bytes, int]]] = [[] for _ in range(streams)]
    for n, at in enumerate(range(0, len(payload), PACKET)):
        packet = payload[at : at + PACKET]
        dealt[n % streams].append((packet, at + len(packet)))
    turns = [w.pages(p) for w, p in zip(writers, dealt, strict=True)]
    while turns:
        for turn in list(turns):
            if (page := next(turn, None)) is None:
                turns.remove(turn)
            else:
                out.append(page)
    return b"".join(out)


def demux(stored: bytes) -> dict[int, dict]:
    """Logical streams by serial number: pages, packets, and ends (granule position, or -1, after each packet). Raises ValueError on damage."""
    found: dict[int, dict] = {}
    at = 0
    while at < len(stored):
        if stored[at : at + 4] != b"OggS" or at + 27 > len(stored):
            raise ValueError(f"no page at byte {at}")
        _, version, kind, granule, serial, sequence, crc, segments = _HEADER.unpack_from(stored, at)
        lacing = stored[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > len(stored):
            raise ValueError(f"page at byte {at} is cut off or of another version")
        if page_crc(stored[at : at + 22] + bytes(4) + stored[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        s = found.get(serial)
        if s is None:
            if not kind & 2:
                raise ValueError(f"stream {serial} has no first page")
            s = found[serial] = {"pages": 0, "packets": [], "ends": [], "part": None, "last": False}
        if sequence != s["pages"] or s["last"] or bool(kind & 1) != (s["part"] is not None):
            raise ValueError(f"page {sequence} of stream {serial} is out of sequence")
        s["pages"] += 1
        s["last"] = bool(kind & 4)
        part, p, done = s["part"], start, 0
        for n in lacing:
            part = stored[p : p + n] if part is None else part + stored[p : p + n]
            p += n
            if n < 255:
                s["packets"].append(part)
                s["ends"].append(-1)
                part, done = None, done + 1
        if done:  # a page's granule position is that of the last packet that ends on it
            s["ends"][-1] = granule
        s["part"] = part
        at = end
    if any(s["part"] is not None or not s["last"] for s in found.values()):
        raise ValueError("a stream does not end")
    return found


def unmux(stored: bytes) -> tuple[bytes, dict]:
    """The payload, and what was found: streams, pages, packets, rate, and timed: seconds at the end of each stream's last packet."""
    found = demux(stored)
    dealt, seen = {}, {"streams": len(found), "pages": 0, "packets": 0, "rate": 0, "timed": []}
    total = 0
    for s in found.values():
        magic, k, streams, rate, total = _IDENT.unpack(s["packets"][0])
        if magic != MAGIC or streams != len(found):
            raise ValueError("another kind of stream")
        dealt[k] = s["packets"][1:]
        seen["pages"] += s["pages"]
        seen["packets"] += len(s["packets"]) - 1
        seen["rate"] = rate
        seen["timed"].append(max(s["ends"]) / rate)
    order = [dealt[k] for k in sorted(dealt)]
    payload = b"".join(order[n % len(order)][n // len(order)] for n in range(seen["packets"]))
    if len(payload) != total:
        raise ValueError("the packets do not make up the payload")
    return payload, seen


def feature(payload: bytes, seen: dict) -> str:
    """Of the samples as read back: container facts and level statistics around the mid level 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return (
        f"streams={seen['streams']};pages={seen['pages']};packets={seen['packets']};samples={len(x)};seconds={max(seen['timed']):.6f};"
        f"mean={x.mean():.6f};rms={float(np.sqrt((x.astype(np.float64) ** 2).mean())):.6f};peak={int(np.abs(x).max())};crossings={crossings}"
    )


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _row(text: str, with_media: bool) -> tuple:
    data = text.encode()
    stored = mux(pad(data))
    payload, seen = unmux(stored)
    sha = hashlib.sha256
    return len(data), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), sha(stored).hexdigest(), feature(payload, seen), *[stored] * with_media


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """A row per document: id and SCHEMA's columns, with with_media=True also `media`, the stored bytes.

    The text's UTF-8 bytes, padded with 0 to a positive multiple of 64, are stored as 8-bit samples
    and all figures are taken from what the reader gives back. A null text counts as empty; repeated rows
    give repeated rows; an empty table gives an empty result; other columns are ignored, whatever their
    names; equal texts give equal values.
    """
    schema = SCHEMA + ", media binary" * with_media

    def start():
        return lambda texts: list(zip(*(_row(t, with_media) for t in texts), strict=True))

    return per_text(docs, text_col, [id_col], start, schema)
