"""AIFF and AIFC files: kinds of samples, order of chunks, cut-off and broken files, blocks of a long one."""

import io
import struct

import numpy as np
import pytest

from voicegrid.operators import cepstra
from voicegrid.sources import aiff, audio, wav
from voicegrid.sources.audio import Frames

#: Rates as floats of 80 bits, by the format's definition.
RATES = {44_100: "400eac44000000000000", 16_000: "400cfa00000000000000", 8000: "400bfa00000000000000"}


def form(x, rate, kind=b"AIFF", bits=16, late=False, offset=0, extra=b""):
    """A file of samples from -1 to 1, (n,) or (n, channels); ``kind`` AIFF or that of an AIFC file."""
    channels = 1 if x.ndim == 1 else x.shape[1]
    flat = x.ravel()
    if kind.lower() in (b"fl32", b"fl64"):
        data = flat.astype(f">f{bits // 8}").tobytes()
    else:
        wide = -(-bits // 8)
        whole = np.clip(np.round(flat * 2.0 ** (8 * wide - 1)), -(2 ** (8 * wide - 1)), 2 ** (8 * wide - 1) - 1).astype(">i4")
        data = whole.view(np.uint8).reshape(-1, 4)[:, 4 - wide :]
        data = (data[:, ::-1] if kind == b"sowt" else data).tobytes()
    chunk = lambda name, body: name + struct.pack(">I", len(body)) + body + b"\x00" * (len(body) % 2)
    comm = struct.pack(">hIh", channels, len(flat) // channels, bits) + bytes.fromhex(RATES[rate])
    if kind != b"AIFF":
        comm += kind + b"\x04none\x00"
    chunks = [chunk(b"COMM", comm), chunk(b"SSND", struct.pack(">II", offset, 0) + b"\x07" * offset + data)]
    body = (b"AIFF" if kind == b"AIFF" else b"AIFC") + extra + b"".join(chunks[::-1] if late else chunks)
    return b"FORM" + struct.pack(">I", len(body)) + body


@pytest.mark.parametrize("kind, bits", [(b"AIFF", 8), (b"AIFF", 12), (b"AIFF", 16), (b"AIFF", 24), (b"AIFF", 32), (b"NONE", 16), (b"twos", 24), (b"sowt", 16), (b"sowt", 24), (b"fl32", 32), (b"FL32", 32), (b"fl64", 64)])
@pytest.mark.parametrize("late", [False, True])
def test_kinds_of_samples(kind, bits, late):
    rng = np.random.default_rng(0)
    for x in (rng.uniform(-0.9, 0.9, 501), rng.uniform(-0.9, 0.9, (77, 3))):
        content = form(x, 44_100, kind, bits, late, 6, b"NAME" + struct.pack(">I", 3) + b"abc\x00")
        got, rate = audio.decode(content)
        assert rate == 44_100 and got.shape == x.shape and np.abs(got - x).max() < 2.0 ** (2 - min(bits, 24))
        f = io.BytesIO(content)
        assert np.array_equal(wav.samples(f, aiff.header(f), 10, 60), got[10:60])


def test_loudest_samples_and_rates():
    got, rate = audio.decode(form(np.array([-1.0, 0.0, 0.5]), 8000, b"AIFF", 8))
    assert rate == 8000 and got.tolist() == [-1.0, 0.0, 0.5]
    assert {aiff.extended(bytes.fromhex(h)) for h in RATES.values()} == {float(r) for r in RATES}


def test_cut_off_and_broken_files():
    whole = form(np.zeros(10), 8000)
    assert aiff.header(io.BytesIO(whole[:-6])).count == 7
    assert aiff.header(io.BytesIO(form(np.zeros(0), 8000))).count == 0
    for content in (b"FORM", b"FORMxxxxILBM", whole[:38], form(np.zeros(4), 8000, b"ulaw"), form(np.zeros(4), 8000, b"AIFF", 0), whole[: whole.index(b"SSND")]):
        with pytest.raises(ValueError):
            aiff.header(io.BytesIO(content))


def test_a_long_file_in_blocks(spark, tmp_path):
    rng, frames, block = np.random.default_rng(1), Frames(16_000, 256, 64, 40), 1024
    recordings = {"a": (rng.normal(0, 0.1, 16_000), 16_000), "b": (rng.normal(0, 0.1, (9000, 2)), 8000), "c": (rng.normal(0, 0.1, 20_000), 44_100)}
    for name, (x, rate) in recordings.items():
        (tmp_path / f"{name}.aiff").write_bytes(form(x, rate, b"fl64", 64))
    (tmp_path / "x.aiff").write_bytes(b"FORM")
    heads = audio.heads(spark.createDataFrame([(f"{tmp_path}/{n}.aiff",) for n in "abcx"], "utt string"))
    assert {r["utt"][-6]: bool(r["error"]) for r in heads.collect()} == {"a": False, "b": False, "c": False, "x": True}
    assert sum(r["utt"].endswith("a.aiff") for r in audio.sample_blocks(heads, frames, block).select("utt").collect()) == 16
    got = {r["utt"][-6]: np.array(r["features"]) for r in cepstra.of_files(heads, 13, frames, block).collect()}
    for name, (x, rate) in recordings.items():
        plain = audio.mfcc(audio.resample(audio.mono(x), rate), 13, frames=frames)
        assert got[name].shape == plain.shape and np.abs(got[name] - plain).max() < 1e-6, name
