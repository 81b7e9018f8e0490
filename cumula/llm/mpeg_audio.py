"""MPEG audio columns: frames, tags, tables and checksums; and text carried in frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import texts

# Fixed values of ISO 11172-3 and 13818-3: bit rates in kbit/s by index 1 to 14, sampling rates in Hz.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS, LAYERS = {0: 2.5, 2: 2, 3: 1}, {1: 3, 2: 2, 3: 1}
POLYNOMIAL = 0x8005

#: The carrier's format: MPEG-2 layer III, 16 kHz, 144 kbit/s, mono, with checksums; a frame holds 576 samples.
CARRIER_UNIT, CARRIER_FRAME, CARRIER_SIDE = 576, 648, 9
CARRIER_HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])
CARRIER_BODY = 4 + 2 + CARRIER_SIDE


@dataclass(frozen=True)
class Frame:
    version: float
    layer: int
    crc: bool
    kbps: int
    rate: int
    mono: bool
    samples: int
    length: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Frame | None:
    """The frame header at a place, or None where the four bytes are none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(data[at + 1] >> 3 & 3), LAYERS.get(data[at + 1] >> 1 & 3)
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version is None or layer is None or index in (0, 15) or rate == 3 or data[at + 3] & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    kbps, hertz, pad = BITRATES[family, layer][index - 1], RATES[version][rate], data[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or family == 1 else 576
    length = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    return Frame(version, layer, not data[at + 1] & 1, kbps, hertz, data[at + 3] >> 6 == 3, samples, length)


_HEADERS: dict[bytes, Frame | None] = {}


def _header(data: bytes, at: int) -> Frame | None:
    key = data[at : at + 4]
    if key not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        _HEADERS[key] = header(data, at)
    return _HEADERS[key]


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The checksum of MPEG audio frames."""
    for b in data:
        value ^= b << 8
        for _ in range(8):
            value = (value << 1 ^ (POLYNOMIAL if value & 0x8000 else 0)) & 0xFFFF
    return value


_SUMS: dict[bytes, int] = {}


def _crc(data: bytes) -> int:
    if data not in _SUMS:
        if len(_SUMS) > 10_000:
            _SUMS.clear()
        _SUMS[data] = crc16(data)
    return _SUMS[data]


def id3_size(data: bytes, at: int = 0) -> int:
    """Bytes of an ID3v2 tag at a place, header and footer included, or 0."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)


def id3_texts(data: bytes) -> dict[str, str]:
    """Text frames (T...) of an ID3v2.3 or 2.4 tag at the start."""
    end, out, at = id3_size(data), {}, 10
    wide = data[3:4] == b"\x04"
    codes = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        a, b, c, d = data[at + 4 : at + 8]
        n = a << 21 | b << 14 | c << 7 | d if wide else a << 24 | b << 16 | c << 8 | d
        if data[at : at + 1] == b"T" and n:
            out[data[at : at + 4].decode("latin-1")] = data[at + 11 : at + 10 + n].decode(codes.get(data[at + 10], "latin-1"), "replace").rstrip("\0")
        at += 10 + n
    return out


@dataclass
class Stream:
    """What a file holds: frames by place, tags, the variable-bitrate table, and faults."""

    tag_bytes: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    toc: tuple[int, ...] = ()
    offsets: list[int] = field(default_factory=list)
    frames: list[Frame] = field(default_factory=list)
    skipped: int = 0
    resyncs: int = 0
    checked: int = 0
    bad_crc: int = 0
    unchecked: int = 0
    truncated: int = 0
    trailer: int = 0

    @property
    def samples(self) -> int:
        return sum(f.samples for f in self.frames)

    @property
    def seconds(self) -> float:
        """Exact duration: samples of each frame over its own rate."""
        by_rate: dict[int, int] = {}
        for f in self.frames:
            by_rate[f.rate] = by_rate.get(f.rate, 0) + f.samples
        return sum(n / r for r, n in sorted(by_rate.items()))


def _read_table(data: bytes, at: int, f: Frame, out: Stream) -> bool:
    """Xing, Info or VBRI table in the first frame."""
    place = at + 4 + (2 if f.crc else 0) + f.side
    kind = data[place : place + 4]
    if f.layer == 3 and kind in (b"Xing", b"Info"):
        flags, p = struct.unpack_from(">I", data, place + 4)[0], place + 8
        if flags & 1:
            out.table_frames, p = struct.unpack_from(">I", data, p)[0], p + 4
        if flags & 2:
            out.table_bytes, p = struct.unpack_from(">I", data, p)[0], p + 4
        if flags & 4:
            out.toc = tuple(data[p : p + 100])
        out.table = kind.decode()
        return True
    place = at + 36
    if data[place : place + 4] == b"VBRI" and len(data) >= place + 26:
        out.table_bytes, out.table_frames, entries, scale, width = struct.unpack_from(">IIHHH", data, place + 10)
        out.toc = tuple(int.from_bytes(data[p : p + width], "big") * scale for p in range(place + 26, min(place + 26 + entries * width, len(data) - width + 1), max(1, width)))
        out.table = "VBRI"
        return True
    return False


def _protected(f: Frame, mode: int) -> int:
    """Bytes behind the checksum that it covers: layer III side information, or layer I bit allocation."""
    if f.layer == 3:
        return f.side
    single = (mode >> 4 & 3) * 4 + 4 if mode >> 6 == 1 else 32  # subbands from here on share their allocation
    return 16 if f.mono else (single * 2 + 32 - single) // 2


def _tags_behind(data: bytes, least: int) -> list[int]:
    """Places, ascending, where tags that end with the data may begin."""
    cut, out = len(data), []
    if cut - least >= 128 and data[cut - 128 : cut - 125] == b"TAG":
        cut -= 128
        out.append(cut)
    if cut - least >= 32 and data[cut - 32 : cut - 24] == b"APETAGEX":
        size = struct.unpack_from("<I", data, cut - 20)[0] + (32 if data[cut - 9] & 0x80 else 0)
        if 32 <= size <= cut - least:
            out.append(cut - size)
    return sorted(out)


def parse(data: bytes) -> Stream:
    """All frames of a file from first to last byte.

    Tags in front (ID3v2) and behind (ID3v1, APE) are set apart; one behind only
    where the frames end: a frame of the stream that starts at its place, or
    reaches into it, is sound, whatever bytes inside it look like. A header counts where another of the same version,
    layer and rate, a tag behind, or the end of the data follows its frame; else
    the search goes on a byte further. The first frame may hold a table instead
    of sound. Checksums of layers I and III are verified; protected layer II
    frames, whose allocation tables are not held here, count as unchecked.
    """
    out, at, end = Stream(), 0, len(data)
    while n := id3_size(data, at):
        if not at:
            out.tags = id3_texts(data[:n])
        at += n
    out.tag_bytes = min(at, end)
    behind = _tags_behind(data, at)
    last, lost = None, False
    while at + 4 <= end:
        f, tagged = _header(data, at), at in behind
        if f:
            after = at + f.length
            g = _header(data, after) if after + 4 <= end else None
            same = g and (g.version, g.layer, g.rate) == (f.version, f.layer, f.rate)
            follows = last and (last.version, last.layer, last.rate) == (f.version, f.layer, f.rate) and not lost
            if after > end:
                if follows and not tagged:
                    out.truncated += 1
                    at = next((c for c in behind if c > at), end)
                    break
                f = None
            elif not (same or after == end or after in behind or (follows and end - after < 4)):
                f = None
        if tagged and not f:
            break
        if not f:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = min(end if nxt < 0 else nxt, next((c for c in behind if c > at), end))
            out.skipped += nxt - at
            at, lost = nxt, True
            continue
        if lost:
            out.resyncs += 1
        lost, first = False, last is None
        last = f
        if f.crc and f.layer == 2:
            out.unchecked += 1
        elif f.crc:
            out.checked += 1
            out.bad_crc += _crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + _protected(f, data[at + 3])]) != struct.unpack_from(">H", data, at + 4)[0]
        if not (first and _read_table(data, at, f, out)):
            out.offsets.append(at)
            out.frames.append(f)
        at += f.length
    if at in behind:
        out.trailer, end = end - at, at
    out.skipped += max(0, end - at)
    return out


_SIDE = bytes(CARRIER_SIDE)  # no main data: every byte behind the side information is ancillary
_FRAME_HEAD = CARRIER_HEADER + struct.pack(">H", crc16(CARRIER_HEADER[2:] + _SIDE)) + _SIDE
_TITLE = b"\x03text"
_TAG = b"ID3\x04\0\0" + bytes([0, 0, 0, 10 + len(_TITLE)]) + b"TIT2" + bytes([0, 0, 0, len(_TITLE)]) + b"\0\0" + _TITLE


def carry(payload: bytes) -> bytes:
    """A layer III file whose frames hold 576 payload bytes each as ancillary data.

    An ID3v2 tag and a frame with an Info table and 100 seek points go first;
    the last bytes of each frame are zero. The length must be a multiple of 576.
    """
    n = len(payload) // CARRIER_UNIT
    total = (n + 1) * CARRIER_FRAME
    toc = bytes(min(255, 256 * ((n * k // 100 + 1) * CARRIER_FRAME) // total) for k in range(100))
    info = _FRAME_HEAD + b"Info" + struct.pack(">III", 7, n, total) + toc
    frames = np.zeros((n, CARRIER_FRAME), np.uint8)
    frames[:, :CARRIER_BODY] = np.frombuffer(_FRAME_HEAD, np.uint8)
    frames[:, CARRIER_BODY : CARRIER_BODY + CARRIER_UNIT] = np.frombuffer(payload, np.uint8).reshape(n, CARRIER_UNIT)
    return _TAG + info.ljust(CARRIER_FRAME, b"\0") + frames.tobytes()


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload of a carrier file, frame by frame as parsed."""
    return b"".join([data[o + CARRIER_BODY : o + CARRIER_BODY + CARRIER_UNIT] for o in stream.offsets])


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // CARRIER_UNIT)) * CARRIER_UNIT - len(data))


def feature(stream: Stream) -> str:
    """Duration, frames, checksums and a digest of the exact seek offsets."""
    seek = zlib.crc32(np.array(stream.offsets, "<i8").tobytes())
    f = stream.frames[0] if stream.frames else Frame(0, 0, False, 0, 0, True, 0, 0)
    return f"v{f.version}/l{f.layer}/{f.rate}Hz/{f.kbps}kbps;frames={len(stream.frames)};samples={stream.samples};seconds={stream.seconds:.6f};crc_ok={stream.checked - stream.bad_crc}/{stream.checked};resyncs={stream.resyncs};table={stream.table}:{stream.table_frames};seek={seek:08x}"


def audio_columns(media: DataFrame, column: str = "media") -> DataFrame:
    """Rows of ``media`` with a struct ``audio`` of what its MPEG audio bytes hold.

    It has exact seconds, samples, frames, seek offsets of every frame, table
    kind and frames, tag bytes, text tags, skipped bytes, resyncs, checked, wrong
    and unchecked checksums. Null, empty and unreadable bytes give no frames and 0 s.
    """
    kind = "struct<seconds:double,samples:long,frames:int,seek:array<long>,vbr_table:string,table_frames:int,tag_bytes:int,tags:map<string,string>,skipped:long,resyncs:int,checked:int,bad_crc:int,unchecked:int,truncated:int>"
    if "audio" in media.columns:
        raise ValueError("column audio exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(column).to_pylist():
                s = parse(data or b"")
                out.append({"seconds": s.seconds, "samples": s.samples, "frames": len(s.frames), "seek": s.offsets, "vbr_table": s.table, "table_frames": s.table_frames, "tag_bytes": s.tag_bytes, "tags": list(s.tags.items()), "skipped": s.skipped, "resyncs": s.resyncs, "checked": s.checked, "bad_crc": s.bad_crc, "unchecked": s.unchecked, "truncated": s.truncated})
            form = pa.struct([("seconds", pa.float64()), ("samples", pa.int64()), ("frames", pa.int32()), ("seek", pa.list_(pa.int64())), ("vbr_table", pa.string()), ("table_frames", pa.int32()), ("tag_bytes", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())), ("skipped", pa.int64()), ("resyncs", pa.int32()), ("checked", pa.int32()), ("bad_crc", pa.int32()), ("unchecked", pa.int32()), ("truncated", pa.int32())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, form)], names=[*b.schema.names, "audio"])

    return media.mapInArrow(run, media.select("*", F.lit(None).cast(kind).alias("audio")).schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Text of (doc_id, text) as carrier files, read back and described, one row for each row.

    Null texts count as empty; an empty text is one frame of bytes 255. Equal
    texts give equal values, repeated rows and rows without an id stay rows;
    nothing is shuffled, and a task holds one text's file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in texts(b):
                media = carry(padded(t))
                stream = parse(media)
                back = carried(media, stream)
                for c, v in zip(cols, (len(t.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return view.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
