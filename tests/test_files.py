"""Files as a data source: listing and reading in tasks, WAV formats, recordings in blocks, CSV in splits."""

import io
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicegrid.operators import cepstra
from voicegrid.sources import audio, files, manifest, wav
from voicegrid.sources.audio import Frames


def riff(x, rate, kind=1, bits=16, extensible=False, extra=b""):
    """A WAV file of samples from -1 to 1, (n,) or (n, channels)."""
    channels = 1 if x.ndim == 1 else x.shape[1]
    flat = x.ravel()
    if kind == 3:
        data = flat.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = np.clip(np.round(flat * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    else:
        whole = np.clip(np.round(flat * 2.0 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
        data = whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    frame = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * frame, frame, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, kind) + b"\x00" * 14
    chunks = extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@pytest.mark.parametrize("kind, bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
@pytest.mark.parametrize("extensible", [False, True])
def test_wav_formats(kind, bits, extensible):
    rng = np.random.default_rng(0)
    for x in (rng.uniform(-0.9, 0.9, 501), rng.uniform(-0.9, 0.9, (77, 3))):
        content = riff(x, 22_050, kind, bits, extensible, b"LIST" + struct.pack("<I", 3) + b"abc\x00")
        got, rate = audio.decode(content)
        assert rate == 22_050 and got.shape == x.shape and np.abs(got - x).max() < 2.0 ** (2 - min(bits, 24))
        f = io.BytesIO(content)
        head = wav.header(f)
        assert np.array_equal(wav.samples(f, head, 10, 60), got[10:60])


def test_broken_wav_files():
    whole = riff(np.zeros(10), 8000)
    for content in (b"RIFF", b"RIFFxxxxAVI ", whole[:40], riff(np.zeros(4), 8000).replace(struct.pack("<H", 1), struct.pack("<H", 85), 1)):
        with pytest.raises(ValueError):
            wav.header(io.BytesIO(content))
    cut = wav.header(io.BytesIO(whole[:-6]))  # a stream that was cut off
    assert cut.count == 7


def test_listing_in_tasks(spark, tmp_path):
    for speaker in range(120):
        folder = tmp_path / "set" / f"s{speaker}" / "c"
        folder.mkdir(parents=True)
        for k in range(20):
            (folder / f"s{speaker}-c-{k}.flac").write_bytes(b"x" * k)
    (tmp_path / "set" / "top.flac").write_bytes(b"")
    (tmp_path / "set" / "s1" / "high.flac").write_bytes(b"")
    (tmp_path / "set" / "s1" / "c" / "deep").mkdir()
    (tmp_path / "set" / "s1" / "c" / "deep" / "low.flac").write_bytes(b"")
    (tmp_path / "set" / "s1" / "c" / ".hidden.flac").write_bytes(b"")
    (tmp_path / "set" / "s1" / "c" / "note.txt").write_bytes(b"")
    found = files.listing(spark, str(tmp_path / "set"), ".flac", depth=3)
    assert found.rdd.getNumPartitions() > 50
    rows = {r["utt"]: r["bytes"] for r in found.collect()}
    assert len(rows) == 2400 and rows[str(tmp_path / "set" / "s7" / "c" / "s7-c-3.flac")] == 3
    every = files.listing(spark, f"file://{tmp_path}/set", ".flac", hidden=True)
    assert every.count() == 2404
    speakers = manifest.from_directory(spark, str(tmp_path / "set")).groupBy("spk").count().collect()
    assert len(speakers) == 120 and {r["count"] for r in speakers} == {20}
    assert files.listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_recordings_in_blocks_are_as_in_one_piece(spark, tmp_path, monkeypatch):
    """At the rate of features and at others, in mono and stereo, from as many tasks as there are blocks."""
    rng, frames, block = np.random.default_rng(1), Frames(16_000, 256, 64, 40), 1024
    tones = lambda n, rate: np.sin(2 * np.pi * 700 * np.arange(n) / rate) * np.linspace(0, 0.5, n) + rng.normal(0, 0.01, n)
    recordings = {"a": (tones(16_000, 16_000), 16_000), "b": (np.stack([tones(9000, 8000)] * 2, 1), 8000), "c": (tones(30_000, 44_100), 44_100), "d": (tones(1024, 16_000), 16_000), "e": (np.zeros(0), 16_000), "f": (tones(3, 16_000), 16_000)}
    for name, (x, rate) in recordings.items():
        (tmp_path / f"{name}.wav").write_bytes(riff(x, rate, 3, 64))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "other.ogg").write_bytes(b"OggS")
    names = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in [*(f"{k}.wav" for k in recordings), "bad.wav", "other.ogg", "gone.wav", "a.wav"]] + [(None,)], "utt string")
    heads = audio.heads(names)
    rows = {r["utt"].rsplit("/", 1)[1]: r for r in heads.collect()}
    assert len(rows) == 9 and {k for k, r in rows.items() if r["error"]} == {"bad.wav", "other.ogg", "gone.wav"}
    blocks = audio.sample_blocks(heads, frames, block)
    sizes = blocks.select("utt", F.size("samples").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= block + frames.fft and sum(r["utt"].endswith("a.wav") for r in sizes) == 16
    got = {r["utt"].rsplit("/", 1)[1][0]: np.array(r["features"]) for r in cepstra.of_files(heads, 13, frames, block).collect()}
    for name, (x, rate) in recordings.items():
        whole = audio.mfcc(audio.resample(audio.mono(x), rate), 13, frames=frames) if len(x) else None
        if whole is not None:
            assert got[name].shape == whole.shape and np.abs(got[name] - whole).max() < 1e-6, name


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_records_over_lines_in_many_tasks(spark, tmp_path, ends):
    import csv

    rng = random.Random(4)
    rows = [[rng.choice(["plain", "with, comma", 'a "quote"', f"two{ends}lines", f'"{ends}{ends},x"', ""]) + str(k), f"/p/{k}"] + (["third"] if k % 11 == 0 else []) for k in range(3000)]
    for name, part in (("a.csv", rows[:1700]), ("b.csv", rows[1700:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=ends).writerows(part)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
        found = manifest.from_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["spk"], r["utt"]) for r in found) == sorted((r[0].strip(), r[1]) for r in rows if len(r) == 2)
    first = [r["utt"] for r in sorted(found, key=lambda r: r["pos"]) if int(r["utt"][3:]) < 1700]
    assert len({r["pos"] for r in found}) == len(found) and len(first) == sum(len(r) == 2 for r in rows[:1700])
