"""The decoder against a published stream and against streams of a plain encoder."""

import hashlib

import numpy as np
import pytest

from voicegrid.sources import audio
from voicegrid.sources.flac import decode_flac

#: The first example stream of RFC 9639: one sample of two channels.
PUBLISHED = bytes.fromhex("664c61438000002210001000000 00f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a".replace(" ", ""))


def bits(value, n):
    return format(value & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(values, k):
    out = ""
    for v in values:
        folded = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (folded >> k) + "1" + bits(folded, k)
    return out


def residual(values, order, k, parts):
    out, n = "00" + bits(parts.bit_length() - 1, 4), (len(values) + order) // parts
    for p in range(parts):
        mine = values[max(0, p * n - order) : (p + 1) * n - order]
        out += bits(15, 4) + bits(24, 5) + "".join(bits(v, 24) for v in mine) if k is None else bits(k, 4) + rice(mine, k)
    return out


def subframe(x, width, kind, k=6, parts=4):
    if kind == "constant":
        return "0" + bits(0, 6) + "0" + bits(x[0], width)
    if kind == "verbatim":
        return "0" + bits(1, 6) + "0" + "".join(bits(v, width) for v in x)
    if kind == "wasted":
        return "0" + bits(1, 6) + "1" + "001" + "".join(bits(v >> 3, width - 3) for v in x)
    if kind.startswith("fixed"):
        order = int(kind[5])
        rest = np.diff(x, order).tolist() if order else list(x)
        return "0" + bits(8 + order, 6) + "0" + "".join(bits(v, width) for v in x[:order]) + residual(rest, order, k, parts)
    weights, shift = [3, -2, 1], 1  # linear prediction
    rest = [x[t] - (sum(w * x[t - 1 - j] for j, w in enumerate(weights)) >> shift) for t in range(3, len(x))]
    return "0" + bits(32 + 2, 6) + "0" + "".join(bits(v, width) for v in x[:3]) + bits(4, 4) + bits(shift, 5) + "".join(bits(w, 5) for w in weights) + residual(rest, 3, k, parts)


def stream(frames, channels, rate=16_000, width=16, x=None):
    """frames: (number of samples, channel assignment, bits of the subframes)."""
    total = sum(n for n, _, _ in frames)
    digest = hashlib.md5(x.astype("<i2").tobytes()).digest() if x is not None else bytes(16)
    head = bits(rate, 20) + bits(channels - 1, 3) + bits(width - 1, 5) + bits(total, 36)
    info = bytes(10) + int(head, 2).to_bytes(8) + digest
    out = b"fLaC" + b"\x04\x00\x00\x03abc" + b"\x80" + len(info).to_bytes(3) + info
    for k, (n, assignment, body) in enumerate(frames):
        number = bits(k, 8) if k < 128 else "110" + bits(k >> 6, 5) + "10" + bits(k, 6)
        f = bits(0x3FFE, 14) + "00" + bits(7, 4) + "0000" + bits(assignment, 4) + "000" + "0" + number + bits(n - 1, 16) + bits(0, 8) + body
        f += "0" * (-len(f) % 8) + bits(0, 16)
        out += int(f, 2).to_bytes(len(f) // 8)
    return out


def test_published_stream():
    x, rate = decode_flac(PUBLISHED)
    assert (x * 32768).tolist() == [[25588, 10416]] and rate == 44_100


@pytest.mark.parametrize("kind", ["constant", "verbatim", "wasted", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "linear"])
@pytest.mark.parametrize("k", [3, None])
def test_kinds_of_subframes(kind, k):
    rng = np.random.default_rng(0)
    x = np.full(256, 77) if kind == "constant" else (np.cumsum(rng.integers(-9, 9, 256)) * 8).astype(int)
    content = stream([(256, 0, subframe(x.tolist(), 16, kind, k))] * 3, 1, x=np.tile(x, 3))
    found, rate = audio.decode(content)
    assert rate == 16_000 and np.array_equal(found * 32768, np.tile(x, 3))


def test_stereo_and_many_frames():
    rng = np.random.default_rng(1)
    a, b = (np.cumsum(rng.integers(-30, 30, 64)) for _ in range(2))
    sub = lambda v, w: subframe(v.tolist(), w, "fixed2")
    modes = {1: sub(a, 16) + sub(b, 16), 8: sub(a, 16) + sub(a - b, 17), 9: sub(a - b, 17) + sub(b, 16), 10: sub((a + b) >> 1, 16) + sub(a - b, 17)}
    frames = [(64, mode, body) for mode, body in modes.items()] * 40
    both = np.stack([a, b], 1)
    found, _ = decode_flac(stream(frames, 2, x=np.tile(both, (160, 1))))
    assert np.array_equal(found * 32768, np.tile(both, (160, 1)))


def test_broken_streams_fail():
    x = np.arange(64)
    content = stream([(64, 0, subframe(x.tolist(), 16, "verbatim"))], 1, x=x)
    for broken in (content[:-40], content[:60] + b"\x00\x00" + content[62:], b"fLaC....", b"OggS"):
        with pytest.raises(ValueError):
            audio.decode(broken)


def test_features_of_flac_files(spark):
    t = np.arange(16_000)
    x = (8000 * np.sin(2 * np.pi * 440 * t / 16_000)).astype(int)
    content = stream([(4000, 0, subframe(x[s : s + 4000].tolist(), 16, "fixed2", 9)) for s in range(0, 16_000, 4000)], 1, x=x)
    files = spark.createDataFrame([("a.flac", bytearray(content))], "utt string, content binary")
    (row,) = audio.feature_table(files, 20).collect()
    assert np.allclose(np.array(row["features"]), audio.mfcc(x / 32768, 20))
