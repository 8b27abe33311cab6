"""Streams put together by hand, not by the module's own writer."""

import struct

import pytest

from quarry.llm import mpeg_audio as mp


def crc(bits):
    """Bit by bit, from the text of the standard: x16 + x15 + x2 + 1, all ones at first."""
    register = [1] * 16
    for bit in bits:
        carry = register[0] ^ bit
        register = register[1:] + [0]
        if carry:
            for i in (0, 13, 15):
                register[i] ^= 1
    return int("".join(map(str, register)), 2)


def bits_of(data):
    return [byte >> i & 1 for byte in data for i in range(7, -1, -1)]


def frame(four, covered, extra=0):
    """A frame whose CRC covers the given bits of its body."""
    size = mp.header(four)[0]
    body = bytes(int("".join(map(str, (covered + [0] * 8)[i : i + 8])), 2) for i in range(0, -(-len(covered) // 8) * 8, 8))
    return (four + struct.pack(">H", crc(bits_of(four[2:]) + covered)) + body).ljust(size, b"\x00")


@pytest.mark.parametrize(
    ("four", "covered", "size", "samples"),
    [
        (b"\xff\xfe\x40\xc0", [0, 0, 0, 1] * 32, 4 * (12 * 128000 // 44100), 384),  # layer I, mono
        (b"\xff\xfe\x44\x00", [0, 1, 0, 1] * 64, 4 * 32, 384),  # layer I, stereo, 48 kHz
        (b"\xff\xfe\x44\x50", [0, 1, 1, 0] * (8 * 2 + 24), 4 * 32, 384),  # layer I, joint above subband 8
        (b"\xff\xfc\x84\xc0", [0, 0, 0, 1] + [0] * (10 * 4 + 12 * 3 + 4 * 2) + [0, 1], 144 * 128000 // 48000, 1152),  # layer II, 27 subbands, one used
        (b"\xff\xfc\x28\xc0", [0] * (2 * 4 + 10 * 3), 144 * 48000 // 32000, 1152),  # layer II, 12 subbands
        (b"\xff\xf4\x84\xc0", [0] * (4 * 4 + 7 * 3 + 19 * 2), 144 * 64000 // 24000, 1152),  # layer II of MPEG-2
        (b"\xff\xfa\x90\x00", [1, 0] * 128, 144 * 128000 // 44100, 1152),  # layer III, stereo
    ],
)
def test_layers_and_their_checksums(four, covered, size, samples):
    one = frame(four, covered)
    assert len(one) == size
    audio = mp.read(one * 3)
    assert (len(audio.frames), audio.samples, audio.crc_bad, audio.resyncs) == (3, 3 * samples, 0, 0)
    broken = bytearray(one)
    broken[6] ^= 0x10
    assert mp.read(one + bytes(broken) + one).crc_bad == 1


def xing(kind=b"Xing", encoder=b""):
    four = b"\xff\xfb\x90\x00"
    body = kind + struct.pack(">III", 15, 7, 9000) + bytes(range(100)) + struct.pack(">I", 50) + encoder
    return (four + bytes(32) + body).ljust(mp.header(four)[0], b"\x00"), four.ljust(mp.header(four)[0], b"\x00")


def test_xing_table_with_encoder_delay():
    table, plain = xing(encoder=b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big"))
    audio = mp.read(table + plain * 7)
    assert audio.table == {"kind": "Xing", "frames": 7, "bytes": 9000, "seek": list(range(100)), "encoder": "LAME3.100", "delay": 576, "padding": 1000}
    assert len(audio.frames) == 7 and audio.played == 7 * 1152 - 1576 and audio.duration == pytest.approx(audio.played / 44100)
    assert mp.read(xing()[0] + plain).played == 1152


def test_vbri_table():
    four = b"\xff\xfb\x90\x00"
    size = mp.header(four)[0]
    body = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 1105, 75, 4000, 9, 3, 2, 2, 3) + struct.pack(">HHH", 600, 610, 620)
    audio = mp.read((four + bytes(32) + body).ljust(size, b"\x00") + four.ljust(size, b"\x00") * 9)
    assert audio.table == {"kind": "VBRI", "frames": 9, "bytes": 4000, "delay": 1105, "seek": [1200, 2420, 3660], "frames_per_entry": 3}
    assert len(audio.frames) == 9 and audio.played == 9 * 1152 - 1105


def test_search_needs_a_successor_of_the_same_kind():
    four = b"\xff\xfb\x90\x00"
    plain = four.ljust(mp.header(four)[0], b"\x00")
    lone = b"\xff\xfe\x40\xc0".ljust(4 * (12 * 128000 // 44100), b"\x00")  # another layer, once
    audio = mp.read(plain * 2 + b"noise" + lone + plain * 2)
    assert len(audio.frames) == 4 and audio.resyncs == 1
