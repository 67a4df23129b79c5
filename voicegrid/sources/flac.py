"""FLAC decoding, from the public description of the format (RFC 9639).

Bits of a file are one NumPy array; a Rice partition is read by jumping from one
stop bit to the next and taking all remainders at once. The stored digest of
the samples, where there is one, is checked.
"""

from __future__ import annotations

import hashlib
from operator import mul

import numpy as np

#: Fixed values of the format: block sizes, rates and sample sizes by their codes; 0 where the header says it elsewhere.
_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
_WIDTHS = [0, 8, 12, 0, 16, 20, 24, 32]
_LEFT_SIDE, _SIDE_RIGHT, _MID_SIDE = 8, 9, 10


class _Bits:
    def __init__(self, content: bytes, at: int):
        self.bits = np.unpackbits(np.frombuffer(content, np.uint8))
        self.at = at * 8

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("the FLAC stream ends early")
        value = int.from_bytes(np.packbits(np.concatenate([np.zeros(-n % 8, np.uint8), self.bits[self.at : self.at + n]])).tobytes()) if n else 0
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def array(self, n: int, width: int) -> np.ndarray:
        """n signed numbers of ``width`` bits."""
        if not width:
            return np.zeros(n, np.int64)
        value = self._numbers(self.at + width * np.arange(n), width)
        self.at += n * width
        return value - ((value >> (width - 1)) << width)

    def _numbers(self, starts: np.ndarray, width: int) -> np.ndarray:
        if len(starts) and starts[-1] + width > len(self.bits):
            raise ValueError("the FLAC stream ends early")
        out = np.zeros(len(starts), np.int64)
        for j in range(width):
            out = out << 1 | self.bits[starts + j]
        return out

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def rice(self, n: int, k: int) -> np.ndarray:
        """n residuals: zeros before a stop bit, k bits after it, the sign folded into the lowest bit."""
        stops: list[int] = []
        begin, window = self.at, n * (k + 4) + 1024
        p = begin
        while len(stops) < n:
            part = self.bits[p : p + window]
            if not len(part):
                raise ValueError("the FLAC stream ends early")
            following = np.minimum.accumulate(np.where(part, np.arange(len(part)), len(part))[::-1])[::-1].tolist()
            q = 0
            while len(stops) < n and q < len(part) and (stop := following[q]) < len(part):
                stops.append(p + stop)
                q = stop + 1 + k
            if len(stops) < n and not q and p + len(part) == len(self.bits):
                raise ValueError("the FLAC stream ends early")
            p, window = p + q, window * 2
        at = np.array(stops, np.int64)
        before = np.concatenate([[begin], at[:-1] + 1 + k])
        if n:
            self.at = stops[-1] + 1 + k
        folded = (at - before) << k | self._numbers(at + 1, k)
        return folded >> 1 ^ -(folded & 1)


def _residual(bits: _Bits, n: int, order: int) -> np.ndarray:
    width = 4 + bits.take(2)
    parts = 1 << bits.take(4)
    found = []
    for part in range(parts):
        count = n // parts - (order if not part else 0)
        k = bits.take(width)
        found.append(bits.array(count, bits.take(5)) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(found)


def _predicted(start: list[int], residual: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    """Samples of which each is its residual and the weighted sum of those before it, the nearest first in ``weights``."""
    out, order, turned = list(start), len(weights), weights[::-1]
    for at, r in enumerate(residual.tolist()):
        out.append(r + (sum(map(mul, turned, out[at : at + order])) >> shift))
    return np.array(out, np.int64)


def _subframe(bits: _Bits, n: int, width: int) -> np.ndarray:
    kind = bits.take(7)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.array(n, width)
    elif 8 <= kind <= 12:
        order = kind - 8
        start = bits.array(order, width)
        out = _residual(bits, n, order)
        # A residual of order d is the d-th difference, so it is summed up d times, from the start's own differences.
        for d in range(order, 0, -1):
            out = np.cumsum(np.concatenate([np.diff(start, d - 1)[:1], out]))
    elif kind >= 32:
        order = kind - 31
        start = bits.array(order, width).tolist()
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = bits.array(order, precision).tolist()
        out = _predicted(start, _residual(bits, n, order), weights, shift)
    else:
        raise ValueError(f"FLAC subframes of type {kind} are reserved")
    return out << wasted


def _frame(bits: _Bits, width: int) -> tuple[list[np.ndarray], int]:
    if bits.take(15) != 0x7FFC:
        raise ValueError("no FLAC frame where one should begin")
    bits.take(1)
    size, rate, assignment, sample = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    number = bits.take(8)  # of the frame, in as many bytes as it has leading ones
    while number & 0xC0 == 0xC0:
        bits.take(8)
        number = number << 1 & 0xFF
    n = bits.take(8 if size == 6 else 16) + 1 if size in (6, 7) else _SIZES[size]
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    bits.take(8)
    width = _WIDTHS[sample] or width
    stereo = assignment in (_LEFT_SIDE, _SIDE_RIGHT, _MID_SIDE)
    wide = {_LEFT_SIDE: (0, 1), _SIDE_RIGHT: (1, 0), _MID_SIDE: (0, 1)}.get(assignment, (0,) * (assignment + 1))
    channels = [_subframe(bits, n, width + more) for more in wide]
    bits.at += -bits.at % 8 + 16
    if stereo:
        a, b = channels
        if assignment == _LEFT_SIDE:
            channels = [a, a - b]
        elif assignment == _SIDE_RIGHT:
            channels = [a + b, b]
        else:
            twice = 2 * a + (b & 1)
            channels = [(twice + b) >> 1, (twice - b) >> 1]
    return channels, n


def decode_flac(content: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate); two-dimensional if there are several channels."""
    if content[:4] != b"fLaC" or len(content) < 42:
        raise ValueError("not a FLAC stream")
    at, info = 4, b""
    while True:
        head, size = content[at], int.from_bytes(content[at + 1 : at + 4])
        if head & 0x7F == 0:
            info = content[at + 4 : at + 4 + size]
        at += 4 + size
        if head & 0x80:
            break
    if len(info) < 34:
        raise ValueError("a FLAC stream without its description")
    packed = int.from_bytes(info[10:18])
    rate, n_channels, width, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    bits, blocks, done = _Bits(content, at), [], 0
    while done < total if total else bits.at + 64 < len(bits.bits):
        channels, n = _frame(bits, width)
        blocks.append(np.stack(channels, 1))
        done += n
    x = np.concatenate(blocks) if blocks else np.zeros((0, n_channels), np.int64)
    if any(info[18:34]):
        size = -(-width // 8)
        raw = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        if hashlib.md5(raw).digest() != info[18:34]:
            raise ValueError("the FLAC stream's samples don't have its digest")
    out = x / 2.0 ** (width - 1)
    return (out if n_channels > 1 else out[:, 0]), rate
