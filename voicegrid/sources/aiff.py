"""AIFF files and AIFC ones without compression: the header; samples are read as those of WAV files are."""

from __future__ import annotations

from typing import BinaryIO

from .wav import Samples

#: Fixed values of the format: (floating, width or None for the header's, big-endian) of each kind of AIFC that isn't compressed.
_KINDS = {
    b"NONE": (False, None, True),
    b"twos": (False, None, True),
    b"sowt": (False, None, False),
    b"fl32": (True, 4, True),
    b"FL32": (True, 4, True),
    b"fl64": (True, 8, True),
    b"FL64": (True, 8, True),
}


def extended(raw: bytes) -> float:
    """A positive float of 80 bits, as the rate is given."""
    power, whole = int.from_bytes(raw[:2], "big") & 0x7FFF, int.from_bytes(raw[2:10], "big")
    return whole * 2.0 ** (power - 16383 - 63)


def header(f: BinaryIO) -> Samples:
    """Of a file of whole numbers of 1 to 4 bytes or of floats; chunks may come in any order."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    start = f.read(12)
    if start[:4] != b"FORM" or start[8:] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    at, told, data = 12, None, None
    while at + 8 <= size and not (told and data):
        f.seek(at)
        chunk = f.read(8)
        name, length = chunk[:4], int.from_bytes(chunk[4:8], "big")
        if name == b"COMM":
            body = f.read(min(length, 22))
            channels, count, bits = (int.from_bytes(body[a:b], "big") for a, b in ((0, 2), (2, 6), (6, 8)))
            kind = body[18:22] if start[8:] == b"AIFC" else b"NONE"
            if kind not in _KINDS or not channels or not 1 <= bits <= 64:
                raise ValueError(f"AIFF of kind {kind!r}, {channels} channels and {bits} bits is not known")
            floating, width, big = _KINDS[kind]
            width = width or (bits + 7) // 8
            if not floating and width > 4:
                raise ValueError(f"AIFF of {bits} bits is not known")
            told = round(extended(body[8:18])), channels, width, floating, count, big
        elif name == b"SSND":
            begin = at + 16 + int.from_bytes(f.read(4), "big")
            data = begin, max(0, min(at + 8 + length, size) - begin)
        at += 8 + length + length % 2
    if not told or told[4] and not data:
        raise ValueError("an AIFF file without samples")
    rate, channels, width, floating, count, big = told
    begin, held = data or (size, 0)
    # A file that was cut off ends where it ends.
    return Samples(rate, channels, width, floating, begin, min(count, held // (channels * width)), big, True)
