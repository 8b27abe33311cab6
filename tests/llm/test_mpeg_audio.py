import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import mpeg_audio as mp


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=700), st.just("\xff\xfa\x64\xc0" * 200)))
def test_round_trip(text):
    data, n = mp.padded(text)
    stream = mp.write(data, n)
    audio = mp.read(stream)
    assert mp.payload(stream, audio) == data and audio.crc_bad == audio.resyncs == 0
    assert audio.samples == 1152 * len(data) // 192 and audio.table["frames"] == len(data) // 192
    assert audio.tags["payload-bytes"] == str(n) and len(audio.table["seek"]) == 100


def test_resynchronises_and_verifies():
    data = random.Random(3).randbytes(192 * 20)
    stream = bytearray(mp.write(data))
    clean = mp.read(bytes(stream))
    broken = bytearray(stream)
    broken[clean.frames[4][0] + 8] ^= 1  # side information
    assert mp.read(bytes(broken)).crc_bad == 1
    torn = bytes(stream[: clean.frames[7][0]]) + b"\xffgarbage\xff\xfb" * 9 + bytes(stream[clean.frames[7][0] :])
    found = mp.read(torn)
    assert found.resyncs == 1 and mp.payload(torn, found) == data
    cut = bytes(stream[: clean.frames[-1][0] + 100])
    assert len(mp.read(cut).frames) == 19


def test_variable_bit_rate_and_versions():
    frames = []
    for rate in (1, 9, 14, 5):
        four = bytes([0xFF, 0xFB, rate << 4, 0x00])
        frames.append(four + bytes(mp.header(four)[0] - 4))
    audio = mp.read(b"".join(frames))
    assert [s for _, s in audio.frames] == [104, 417, 1044, 208] and audio.rate == 44100 and audio.samples == 4 * 1152
    low = bytes([0xFF, 0xF3, 0x80, 0xC0])
    assert mp.header(low)[:3] == (208, 576, 22050)
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x0c\x00", b"\xff\xeb\x10\x00", b"\x00\xfb\x10\x00"):
        assert mp.header(bad) is None


def test_crc_known_value():
    assert mp.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS: polynomial 0x8005, initial value 0xFFFF


def test_digest_and_columns(spark):
    rows = [(1, "abc", b"z"), (2, None, None), (2, None, None), (None, "é" * 5000, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    found = {r.doc_id: r for r in mp.digest(docs).collect()}
    for doc_id, text, _ in rows:
        data, n = mp.padded(text)
        r = found[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(mp.write(data, n)), hashlib.sha256(mp.write(data, n)).hexdigest())
    assert mp.digest(docs).count() == 4 and mp.digest(docs.limit(0)).collect() == []
    seen = {r.doc_id: r for r in mp.scan(mp.store(docs)).collect()}
    assert seen[1].frames == 1 and seen[1].duration == pytest.approx(0.024) and len(seen[None].seek_offsets) == seen[None].frames == 53
    assert {r.frames for r in mp.scan(docs).collect()} == {0}


def test_payload_must_be_whole():
    with pytest.raises(ValueError):
        mp.write(b"x")
    assert struct.calcsize(">II") == 8
