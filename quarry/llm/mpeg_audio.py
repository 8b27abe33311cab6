"""MPEG audio columns: lossless storage of bytes in an MPEG-1 Layer III stream, and a reader for any such stream.

Writer: an ID3v2.3 tag that holds the payload's length, an ``Info`` frame (frame count, byte count and a
table of 100 seek points), then one mono frame of 48 kHz and 80 kbit/s for every 192 payload bytes. Each
frame carries its CRC-16 and a side information of zeros (silence); the payload lies in its ancillary bytes.
A stream ends with an ID3v1 tag.

Reader: skips and parses ID3v2 and ID3v1 tags, follows the frame headers (any MPEG version, layers I to III, any
bit rate, so variable ones too), searches anew where a header is broken for one whose successor is of the same
kind, reads Xing, Info and VBRI tables with their seek points and the encoder's delay and padding, verifies every
CRC over the bits that its layer protects, and reports the exact duration, as samples less delay and padding over
the sample rate, with the byte offset of each frame.

Defined cases: null text is empty; an empty payload is one frame of 192 spaces; bytes that hold no frame
give zero frames and duration 0; a frame cut off at the end doesn't count; free-format and reserved headers
aren't frames. Rows are independent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches

UNIT = 192
#: Fixed values of the format: kbit/s by (MPEG-1 or later, layer) and bit rate index, and Hz by version and sample rate index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Fixed values of the format: (subbands, bits of each one's allocation) in layer II, for MPEG-1 by rate and for later versions.
ALLOCATION = {
    "27": ((11, 4), (12, 3), (4, 2)),
    "30": ((11, 4), (12, 3), (7, 2)),
    "8": ((2, 4), (6, 3)),
    "12": ((2, 4), (10, 3)),
    "later": ((4, 4), (7, 3), (19, 2)),
}
#: Header of every written frame: MPEG-1, layer III, with CRC; 80 kbit/s, 48 kHz; mono. The Info frame has no CRC.
HEADER, PLAIN_HEADER = b"\xff\xfa\x64\xc0", b"\xff\xfb\x64\xc0"
FRAME, SIDE = 240, 17


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005, as frames use it, over the first ``bits`` of ``data`` (all by default)."""
    value, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for i in range(7, max(7 - left, -1), -1):
            value = (value << 1 ^ 0x8005) & 0xFFFF if (value >> 15) ^ (byte >> i & 1) else value << 1 & 0xFFFF
        left -= 8
        if left <= 0:
            break
    return value


@lru_cache(maxsize=4096)
def header(four: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame bytes, samples, sample rate, side information bytes, has CRC, layer) of a frame header, else None."""
    if four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    first, mono, pad = version == 3, four[3] >> 6 == 3, four[2] >> 1 & 1
    per_second, bits = HERTZ[version][hertz], KBITS[1 if first else 2, layer][rate] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12 * bits // per_second + pad) * 4 if layer == 1 else samples // 8 * bits // per_second + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return size, samples, per_second, side, not four[1] & 1, layer


def protected_bits(frame: bytes, layer: int, side: int) -> int:
    """How many bits after the CRC it covers: side information, or allocation and, in layer II, the scale factor selection."""
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    if layer == 3:
        return 8 * side
    channels, bound = 1 if mode == 3 else 2, 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (min(bound, 32) * channels + 32 - min(bound, 32))
    first, hertz = frame[1] >> 3 & 3 == 3, frame[2] >> 2 & 3
    each = KBITS[1 if first else 2, 2][frame[2] >> 4] / channels
    if not first:
        table = "later"
    elif each <= 48:
        table = "12" if hertz == 2 else "8"
    else:
        table = "27" if hertz == 1 or each <= 80 else "30"
    body, at, subband, selected = int.from_bytes(frame[6:], "big"), 0, 0, 0
    total = 8 * (len(frame) - 6)
    for count, width in ALLOCATION[table]:
        for _ in range(count):
            own = channels if subband < bound else 1
            for _ in range(own):
                if body >> max(0, total - at - width) & ((1 << width) - 1):
                    selected += 1 if own == channels else channels  # joint allocation selects for both
                at += width
            subband += 1
    return at + 2 * selected


def crc_holds(frame: bytes, layer: int, side: int) -> bool:
    bits = protected_bits(frame, layer, side)
    return crc16(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


@dataclass
class Audio:
    frames: list[tuple[int, int]] = field(default_factory=list)  # offset, size
    samples: int = 0
    rate: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int | list[int]] = field(default_factory=dict)

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding."""
        return max(0, self.samples - self.table.get("delay", 0) - self.table.get("padding", 0))

    @property
    def duration(self) -> float:
        return self.played / self.rate if self.rate else 0.0


def write(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A stream that holds ``payload``, whose length is a multiple of UNIT."""
    n = len(payload) // UNIT
    if n * UNIT != len(payload) or not n:
        raise ValueError(f"the payload is no positive multiple of {UNIT} bytes")
    said = b"\x00payload-bytes\x00" + str(len(payload) if n_bytes is None else n_bytes).encode()
    frame_id = b"TXXX" + struct.pack(">IH", len(said), 0) + said
    tag = b"ID3\x03\x00\x00" + syncsafe(len(frame_id)) + frame_id
    audio_bytes = FRAME * (n + 1)
    points = bytes(min(255, 256 * (FRAME * (1 + i * n // 100)) // audio_bytes) for i in range(100))
    info = PLAIN_HEADER + bytes(SIDE) + b"Info" + struct.pack(">III", 7, n, audio_bytes) + points
    head = HEADER + struct.pack(">H", crc16(HEADER[2:] + bytes(SIDE))) + bytes(SIDE)
    rest = bytes(FRAME - len(head) - UNIT)
    body = b"".join([x for i in range(0, len(payload), UNIT) for x in (head, payload[i : i + UNIT], rest)])
    return tag + info.ljust(FRAME, b"\x00") + body + b"TAG".ljust(127, b"\x00") + b"\xff"


def text_tags(data: bytes, end: int) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag; those with a description are kept under it."""
    tags, at = {}, 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        raw = data[at + 4 : at + 8]
        size = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(raw, "big")
        if data[at : at + 1] == b"T" and size:
            kind = data[at + 10] if at + 10 < end else 0
            text = data[at + 11 : min(at + 10 + size, end)].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[kind] if kind < 4 else "latin-1", "replace")
            name, _, value = text.partition("\x00") if data[at : at + 4] == b"TXXX" else (data[at : at + 4].decode("latin-1"), "", text)
            tags[name] = value.rstrip("\x00")
        at += 10 + size
    return tags


def rate_table(frame: bytes, side: int, crc: bool) -> dict:
    """The Xing, Info or VBRI table in a frame, empty if there is none."""
    at = 4 + side + 2 * crc
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, size, frames, entries, scale, width, each = struct.unpack(">HxxIIHHHH", frame[42:62])
        steps = [int.from_bytes(frame[62 + i * width :][:width], "big") * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "delay": delay, "seek": list(accumulate(steps)), "frames_per_entry": each}
    if frame[at : at + 4] not in (b"Xing", b"Info") or len(frame) < at + 8:
        return {}
    flags = int.from_bytes(frame[at + 4 : at + 8], "big")
    out, p = {"kind": frame[at : at + 4].decode()}, at + 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(frame[p : p + 4], "big")
            p += 4
    if flags & 4:
        out["seek"] = list(frame[p : p + 100])
        p += 100
    p += 4 * (flags >> 3 & 1)  # quality
    if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= p + 24:
        both = int.from_bytes(frame[p + 21 : p + 24], "big")
        out |= {"encoder": frame[p : p + 9].decode("latin-1").strip("\x00 "), "delay": both >> 12, "padding": both & 0xFFF}
    return out


def alike(four: bytes, other: bytes) -> bool:
    """Whether both are headers of the same version, layer and sample rate."""
    return header(other) is not None and four[1] & 0x1E == other[1] & 0x1E and four[2] & 0x0C == other[2] & 0x0C


def read(data: bytes) -> Audio:
    audio, at, end = Audio(), 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        at = min(end, 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True)))
        audio.tags = text_tags(data, at)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        if title := data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"):
            audio.tags["title"] = title
    synced = first = True
    while at + 4 <= end:
        found = header(data[at : at + 4])
        fits = found is not None and at + found[0] <= end
        if fits and not synced:  # a lone sync pattern inside other bytes is no frame: its successor must be one too
            after = at + found[0]
            fits = after == end or after + 4 <= end and alike(data[at : at + 4], data[after : after + 4])
        if not fits:
            if found is not None and synced and at + found[0] > end:
                break
            audio.resyncs += synced
            synced = False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        size, samples, rate, side, crc, layer = found
        if first and layer == 3:
            audio.table = rate_table(data[at : at + size], side, crc)
        if not (first and audio.table):
            audio.crc_bad += crc and not crc_holds(data[at : at + size], layer, side)
            audio.frames.append((at, size))
            audio.samples += samples
            audio.rate = audio.rate or rate
        first, synced = False, True
        at += size
    return audio


def payload(data: bytes, audio: Audio) -> bytes:
    """The bytes that write() stored, from the frames that read() found."""
    skip = 6 + SIDE
    return b"".join([data[at + skip : at + skip + UNIT] for at, _ in audio.frames])


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """doc_id and the stream of each whole text as a binary column."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([write(*padded(t)) for t in batch.column(text).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", media])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), run, f"doc_id long, `{media}` binary")


def scan(table: DataFrame, media: str = "media") -> DataFrame:
    """doc_id, frames, samples, sample_rate, duration, crc_bad, resyncs, seek_offsets and tags of any streams."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [read(m or b"") for m in batch.column(media).to_pylist()]
        columns = [
            pa.array([len(a.frames) for a in found], pa.int64()), pa.array([a.samples for a in found], pa.int64()), pa.array([a.rate for a in found], pa.int64()),
            pa.array([a.duration for a in found], pa.float64()), pa.array([a.crc_bad for a in found], pa.int64()), pa.array([a.resyncs for a in found], pa.int64()),
            pa.array([[at for at, _ in a.frames] for a in found], pa.list_(pa.int64())), pa.array([list(a.tags.items()) for a in found], pa.map_(pa.string(), pa.string())),
        ]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "frames", "samples", "sample_rate", "duration", "crc_bad", "resyncs", "seek_offsets", "tags"])

    schema = "doc_id long, frames long, samples long, sample_rate long, duration double, crc_bad long, resyncs long, seek_offsets array<long>, tags map<string,string>"
    return map_batches(table.select(F.col("doc_id").cast("long").alias("doc_id"), media), run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Stores every whole text, reads the stored bytes back and describes them."""

    def row(text: str | None) -> tuple:
        stream = write(*padded(text))
        audio = read(stream)
        back = payload(stream, audio)
        offsets = hashlib.sha256(struct.pack(f"<{len(audio.frames)}Q", *(at for at, _ in audio.frames))).hexdigest()[:16]
        feature = f"frames={len(audio.frames)};samples={audio.samples};rate={audio.rate};duration={audio.duration:.6f};crc_bad={audio.crc_bad};resyncs={audio.resyncs};table={audio.table.get('kind')}:{audio.table.get('frames')};seek={offsets}"
        return int(audio.tags["payload-bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
