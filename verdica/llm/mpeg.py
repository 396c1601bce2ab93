"""MPEG audio columns: lossless storage of bytes in Layer III frames, and a resynchronising reader.

Writing. Bytes are padded with 255 to a positive multiple of 576 and cut into samples of 8 bits, 576 a frame: the
sample count of an MPEG-2 Layer III frame (16 kHz, mono, 144 kbit/s, 648 bytes). A frame has its header, a checksum,
silent side information and the samples as ancillary data. An ID3v2 tag and a frame with a variable-bitrate table
(frame count, bytes, 100 seek points) go before, an ID3v1 tag behind. Players hear silence; the reader gets every byte.

Reading. Any MPEG-1/2/2.5 stream of Layers I to III: tags are parsed, lost synchronisation is found again where a header
is followed by another one of its kind (or ends the stream), variable-bitrate tables (Xing, Info, VBRI) and
checksums are read, and exact durations and the seek offset of every frame come out.

Defined results: null and empty values store one block of padding; garbage gives no frames and duration 0; repeated
rows agree; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts_of

BLOCK = 576
# Fixed values of the format (ISO 11172-3, 13818-3): kbit/s by (MPEG-1?, layer), sampling rates, samples a frame.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: The writer's frame: MPEG-2, Layer III, with checksum, 144 kbit/s, 16 kHz, mono.
HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
SIDE_BYTES = 9
FRAME_BYTES = 648
DATA_AT = 4 + 2 + SIDE_BYTES


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side_bytes(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format and reserved values are no headers."""
    if four not in _HEADERS:
        if len(_HEADERS) > 1 << 16:
            _HEADERS.clear()
        _HEADERS[four] = _parsed(four)
    return _HEADERS[four]


def _parsed(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = (four[1] >> 3) & 3, 4 - ((four[1] >> 1) & 3)
    rate_index, kbit_index = (four[2] >> 2) & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or kbit_index in (0, 15):
        return None
    kbits, rate = KBITS[version == 3, layer][kbit_index - 1], RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    padding = (four[2] >> 1) & 1
    size = (12 * kbits * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    return Header(version, layer, not four[1] & 1, kbits, rate, four[3] >> 6 == 3, size, samples)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def checksum(data: bytes) -> int:
    """CRC-16 of the format (polynomial 8005, all ones at first)."""
    crc = 0xFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC_LIST[(crc >> 8) ^ b]
    return crc


def _protected(frame: bytes, h: Header) -> tuple[bytes, int]:
    """The bytes behind a frame's checksum that it covers, and how many bits of them: side information, or bit
    allocation (Layer II: and scale factor selection)."""
    if h.layer == 3:
        return frame[6 : 6 + h.side_bytes], 8 * h.side_bytes
    mode, channels = frame[3] >> 6, 1 if h.mono else 2
    bound = 4 * (((frame[3] >> 4) & 3) + 1) if mode == 1 else 32
    if h.layer == 1:
        n = 4 * (channels * bound + 32 - bound)
        return frame[6 : 6 + n // 8], n
    widths = _allocation_widths(h)
    body, at, chosen = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            if (body >> (512 - at - width)) & ((1 << width) - 1):
                chosen += channels if band >= bound else 1
            at += width
    return frame[6:70], at + 2 * chosen


def _allocation_widths(h: Header) -> list[int]:
    """Bits of the allocation of each Layer II subband (ISO 11172-3 tables B.2a to d, 13818-3 B.1)."""
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    kbits = h.kbits // (1 if h.mono else 2)
    if kbits < 56:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if kbits >= 96 and h.rate != 48000 else 4)


def frame_checksum(frame: bytes, h: Header) -> int:
    """The checksum that a frame should have."""
    body, n = _protected(frame, h)
    crc = checksum(frame[2:4] + body[: n // 8])
    for k in range(n % 8):
        bit = (body[n // 8] >> (7 - k)) & 1
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


_FRAME_HEAD = HEADER + struct.pack(">H", checksum(HEADER[2:4] + bytes(SIDE_BYTES))) + bytes(SIDE_BYTES)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def padded(data: bytes) -> bytes:
    short = -len(data) % BLOCK if data else BLOCK
    return data + b"\xff" * short


def encode(data: bytes) -> bytes:
    """The stored form of a byte string."""
    payload = np.frombuffer(padded(data), np.uint8).reshape(-1, BLOCK)
    n = len(payload)
    length = str(len(data)).encode()
    frames = b"".join(name + struct.pack(">IH", len(body) + 1, 0) + b"\x03" + body for name, body in ((b"TLEN", str(36 * n).encode()), (b"TXXX", b"bytes\x00" + length)))
    tag = b"ID3\x04\x00\x00" + _synchsafe(len(frames)) + frames
    table = np.zeros(FRAME_BYTES, np.uint8)
    table[:DATA_AT] = np.frombuffer(_FRAME_HEAD, np.uint8)
    points = bytes(min(255, (k * (n + 1) // 100) * 256 // (n + 1)) for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, n, (n + 1) * FRAME_BYTES) + points
    table[DATA_AT : DATA_AT + len(info)] = np.frombuffer(info, np.uint8)
    body = np.zeros((n, FRAME_BYTES), np.uint8)
    body[:, :DATA_AT] = np.frombuffer(_FRAME_HEAD, np.uint8)
    body[:, DATA_AT : DATA_AT + BLOCK] = payload
    tail = b"TAG" + b"verdica".ljust(30, b"\0") + bytes(90) + b"2026" + b"\xff"
    return tag + table.tobytes() + body.tobytes() + tail[:128].ljust(128, b"\0")


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    resynced: int = 0
    skipped: int = 0
    checked: int = 0
    damaged: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    table_points: bytes = b""


def _tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Reads ID3v2 tags at the start and an ID3v1 tag at the end; returns where frames may lie."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end and max(data[start + 6 : start + 10]) < 128:
        major, flags = data[start + 3], data[start + 5]
        size = sum(b << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop = start + 10, min(start + 10 + size, end)
        while at + 10 <= stop and data[at] and major >= 3:
            raw = data[at + 4 : at + 8]
            n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            if data[at : at + 1] == b"T" and n and at + 10 < stop:
                codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(data[at + 10], 3)]
                out.tags[data[at : at + 4].decode("latin-1")] = data[at + 11 : min(at + 10 + n, stop)].decode(codec, "replace").rstrip("\0")
            at += 10 + n
        start = stop + (10 if flags & 0x10 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags[name] = text
    return start, end


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """A variable-bitrate table in the first frame."""
    xing = at + 4 + (2 if h.checked else 0) + h.side_bytes
    for place in (xing, at + 4 + h.side_bytes):
        if data[place : place + 4] in (b"Xing", b"Info"):
            flags, pos = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    setattr(out, name, int.from_bytes(data[pos : pos + 4], "big"))
                    pos += 4
            if flags & 4:
                out.table_points = data[pos : pos + 100]
            return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        out.table_bytes, out.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
        return True
    return False


def _followed(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether a header of the same kind follows the frame, or the stream ends with it."""
    after = header(data[at + h.size : at + h.size + 4]) if at + h.size + 4 <= end else None
    return after.like(h) if after is not None else at + h.size == end


def _frames_within(data: bytes, at: int, h: Header, end: int) -> bool:
    found = data.find(b"\xff", at + 1, at + h.size)
    while found >= 0:
        inner = header(data[found : found + 4])
        if inner is not None and inner.like(h) and found + inner.size <= end and _followed(data, found, inner, end):
            return True
        found = data.find(b"\xff", found + 1, at + h.size)
    return False


def read(data: bytes) -> Stream:
    """Frames, tags, tables, checksums and exact duration of a stream."""
    out = Stream()
    at, end = _tags(data, out)
    last: Header | None = None
    first, lost = True, False
    samples: dict[int, int] = {}
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= end
        if fits and not _followed(data, at, h, end):
            # A lone pattern is no frame. In step, a frame whose successor is damaged still counts, unless frames begin inside it.
            in_step = last is not None and not lost and h.like(last)
            fits = in_step and not _frames_within(data, at, h, end)
        if not fits:
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            if not lost:
                out.resynced += 1
            lost, at = True, found if found >= 0 else end
            continue
        lost, last = False, h
        if h.checked:
            out.checked += 1
            if frame_checksum(data[at : at + h.size].ljust(70, b"\0"), h) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.damaged += 1
        if not (first and _table(data, at, h, out)):
            out.offsets.append(at)
            out.headers.append(h)
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        first, at = False, at + h.size
    out.duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    return out


def payload(data: bytes, stream: Stream) -> bytes:
    """The samples that ``encode`` stored, read from the frames' ancillary data."""
    own = [at for at, h in zip(stream.offsets, stream.headers, strict=True) if h.size == FRAME_BYTES and h.side_bytes == SIDE_BYTES and h.checked]
    whole = np.frombuffer(data, np.uint8)
    if not own:
        return b""
    places = np.array(own)[:, None] + np.arange(DATA_AT, DATA_AT + BLOCK)
    return whole[places].tobytes()


def feature(s: Stream) -> str:
    """What the frames tell, in one line."""
    h = s.headers[0] if s.headers else None
    kind = f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version]}-layer{h.layer};{h.rate}Hz;{'mono' if h.mono else 'stereo'}" if h else "none"
    seek = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
    bitrates = len({x.kbits for x in s.headers})
    return f"{kind};frames={len(s.headers)};seconds={s.duration};bitrates={bitrates};table={s.table_frames};checked={s.checked};damaged={s.damaged};resynced={s.resynced};seek={seek:08x}"


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, ``media``: each text as a stream."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(t) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"{key} {kind}, n_bytes long, media binary")


def described(media: DataFrame, column: str = "media") -> DataFrame:
    """The other columns of ``media``, and for each stream its duration, frame seek offsets, tags and table, checks, and the stored payload."""
    names = [c for c in media.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)
    fields = "seconds double, n_frames long, offsets array<long>, tags map<string,string>, table_frames long, checked long, damaged long, resynced long, payload binary, media_bytes long, media_sha256 string, feature string"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made: list[list] = [[] for _ in range(12)]
        for value in texts_of(batch.column(batch.num_columns - 1)):
            s = read(value)
            one = (float(s.duration), len(s.headers), s.offsets, list(s.tags.items()), s.table_frames, s.checked, s.damaged, s.resynced, payload(value, s), len(value), sha256(value).hexdigest(), feature(s))
            for into, x in zip(made, one, strict=True):
                into.append(x)
        kinds = (pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.string(), pa.string())
        columns = [*batch.columns[:-1], *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *(f.split()[0] for f in fields.split(", "))])

    return map_rows(media, [*names, column], rows, f"{schema}, {fields}" if schema else fields)
