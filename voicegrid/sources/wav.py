"""WAV files: header and samples apart, so that a stretch of a long file is read on its own."""

from __future__ import annotations

from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Samples:
    """What a header says: samples of ``width`` bytes from ``offset`` on, ``count`` of each channel."""

    rate: int
    channels: int
    width: int
    floating: bool
    offset: int
    count: int
    big: bool = False
    signed_bytes: bool = False


def header(f: BinaryIO) -> Samples:
    """Of a file of whole numbers of 1 to 4 bytes or of floats of 4 or 8, plain or extensible."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    start = f.read(12)
    if start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, None
    while at + 8 <= size:
        f.seek(at)
        chunk = f.read(8)
        name, length = chunk[:4], int.from_bytes(chunk[4:8], "little")
        if name == b"fmt ":
            body = f.read(min(length, 40))
            kind, channels, rate, _, frame, bits = np.frombuffer(body[:16], np.dtype("<u2,<u2,<u4,<u4,<u2,<u2"))[0]
            if kind == _EXTENSIBLE and len(body) >= 26:
                kind = int.from_bytes(body[24:26], "little")
            width = int(frame) // max(1, int(channels))
            if (kind, width) not in {(_PCM, 1), (_PCM, 2), (_PCM, 3), (_PCM, 4), (_FLOAT, 4), (_FLOAT, 8)}:
                raise ValueError(f"WAV format {kind} of {bits} bits is not known")
            found = int(rate), int(channels), width, kind == _FLOAT
        elif name == b"data" and found:
            # A length of a stream that was cut off, or was never known, ends with the file.
            length = min(length, size - at - 8)
            return Samples(*found, at + 8, length // (found[1] * found[2]))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def samples(f: BinaryIO, told: Samples, begin: int, end: int) -> np.ndarray:
    """Those from ``begin`` to ``end``, from -1 to 1; two-dimensional if there are several channels."""
    f.seek(told.offset + begin * told.channels * told.width)
    raw = f.read((end - begin) * told.channels * told.width)
    order = ">" if told.big else "<"
    if told.floating:
        x = np.frombuffer(raw, f"{order}f{told.width}").astype(float)
    elif told.width == 1:
        x = np.frombuffer(raw, np.int8) / 128 if told.signed_bytes else (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif told.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        zero = np.zeros((len(b), 1), np.uint8)
        x = np.concatenate([b, zero] if told.big else [zero, b], 1).view(f"{order}i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, f"{order}i{told.width}") / 2.0 ** (8 * told.width - 1)
    return x.reshape(-1, told.channels) if told.channels > 1 else x
