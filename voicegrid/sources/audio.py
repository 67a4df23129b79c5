"""Audio files to MFCC frame matrices: WAV, AIFF and FLAC decoding, mono mix, resampling, mel cepstra.

Definition: frames of 2048 samples, hop 512, Hann window, centred with zero padding
(or ``reflect``), power spectrum, 128 Slaney-scaled and area-normalised mel bands from
0 to 8 kHz, decibels floored at 1e-10 and 80 under the utterance's maximum, and an
orthonormal DCT-II. An utterance of N samples has 1 + N // 512 frames.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aiff, files, wav
from .flac import decode_flac

RATE, FFT, HOP, MELS, TOP_DB = 16_000, 2048, 512, 128, 80.0


@dataclass(frozen=True)
class Frames:
    """How samples are framed and frames summed up to mel bands. Frame f is centred at sample f * hop."""

    rate: int = RATE
    fft: int = FFT
    hop: int = HOP
    mels: int = MELS

    def count(self, samples: int) -> int:
        return 1 + samples // self.hop


#: The definition above.
DEFAULT = Frames()


#: Readers of headers, by how a file begins, of the formats of which any stretch can be read on its own.
_HEADERS = {b"RIFF": wav.header, b"FORM": aiff.header}
_UNKNOWN = "neither a WAV, an AIFF nor a FLAC file"


def decode_raw(content: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, rate) of a WAV or AIFF file; two-dimensional if there are several channels."""
    f = io.BytesIO(content)
    found = _HEADERS[content[:4]](f)
    return wav.samples(f, found, 0, found.count), found.rate


def decode(content: bytes) -> tuple[np.ndarray, int]:
    if content[:4] in _HEADERS:
        return decode_raw(content)
    if content[:4] == b"fLaC":
        return decode_flac(content)
    raise ValueError(_UNKNOWN)


def mono(x: np.ndarray) -> np.ndarray:
    return x.mean(1) if x.ndim == 2 else x


def resampled_count(n: int, rate: int, to: int = RATE) -> int:
    return int(np.ceil(n * Fraction(to, rate)))


def _reach(rate: int, to: int, zeros: int) -> tuple[float, int]:
    cut = min(1.0, to / rate)
    return cut, int(np.ceil(zeros / cut))


def needed(begin: int, end: int, rate: int, to: int = RATE, zeros: int = 32) -> tuple[int, int]:
    """The samples that those from ``begin`` to ``end`` of the new rate are made of; may reach beyond the utterance."""
    if rate == to:
        return begin, end
    reach = _reach(rate, to, zeros)[1]
    return int(np.floor(begin * (rate / to))) - reach, int(np.floor(max(begin, end - 1) * (rate / to))) + reach + 2


def resample(x: np.ndarray, rate: int, to: int = RATE, zeros: int = 32, first: int = 0, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Band-limited interpolation by a Hann-windowed sinc with ``zeros`` zero crossings a side.

    ``x`` has the samples from ``first`` on, of which nothing but zeros lies beyond; the
    result those from ``begin`` to ``end`` of the new rate, all if not told.
    """
    end = resampled_count(len(x), rate, to) if end is None else end
    if rate == to:
        return x[begin - first : end - first]
    if not len(x):
        return np.zeros(end - begin)
    cut, reach = _reach(rate, to, zeros)
    lo, hi = needed(begin, end, rate, to, zeros)
    padded = np.zeros(hi - lo)
    a, b = max(lo, first), min(hi, first + len(x))
    padded[a - lo : b - lo] = x[a - first : b - first]
    out = np.empty(end - begin)
    for at in range(begin, end, 1 << 14):
        place = np.arange(at, min(end, at + (1 << 14))) * (rate / to)
        whole = np.floor(place).astype(int)
        k = np.arange(-reach + 1, reach + 1)
        away = place[:, None] - (whole[:, None] + k)
        weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
        out[at - begin : at - begin + len(place)] = (padded[whole[:, None] + k - lo] * weight).sum(1)
    return out


def _mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear up to 1 kHz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) / (np.log(6.4) / 27))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * (np.log(6.4) / 27)))


@lru_cache(maxsize=8)
def mel_bands(rate: int = RATE, n_fft: int = FFT, n_mels: int = MELS) -> np.ndarray:
    """(n_mels, 1 + n_fft // 2) triangles of unit area in hertz."""
    edges = _hz(np.linspace(0, _mel(rate / 2), n_mels + 2))
    bins = np.arange(1 + n_fft // 2) * rate / n_fft
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=8)
def dct_matrix(n: int, k: int) -> np.ndarray:
    """(k, n) orthonormal DCT-II."""
    m = np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def decibels(samples: np.ndarray, frames: Frames = DEFAULT) -> np.ndarray:
    """(n, mels) of samples that are cut into n frames ``hop`` apart, the first at their start."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frames.fft) / frames.fft)
    cut = np.lib.stride_tricks.sliding_window_view(samples, frames.fft)[:: frames.hop]
    power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
    return 10 * np.log10(np.maximum(power @ mel_bands(frames.rate, frames.fft, frames.mels).T, 1e-10))


def cepstra_of(db: np.ndarray, loudest: float, n_mfcc: int) -> np.ndarray:
    """(n, n_mfcc) of the frames of an utterance whose loudest band is ``loudest``."""
    return np.maximum(db, loudest - TOP_DB) @ dct_matrix(db.shape[1], n_mfcc).T


def mfcc(x: np.ndarray, n_mfcc: int = 128, pad: str = "constant", frames: Frames = DEFAULT) -> np.ndarray:
    """(frames, n_mfcc) of mono samples at the frames' rate."""
    half = frames.fft // 2
    db = decibels(np.pad(x, half, mode=pad if len(x) > half or pad == "constant" else "constant"), frames)
    return cepstra_of(db, float(db.max()), n_mfcc)


def features_of(content: bytes, n_mfcc: int = 128) -> np.ndarray:
    samples, rate = decode(content)
    return mfcc(resample(mono(samples), rate), n_mfcc)


def feature_table(files: DataFrame, n_mfcc: int = 128) -> DataFrame:
    """(utt, features) of (utt, content) rows, each file once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"utt": part["utt"], "features": [features_of(c, n_mfcc).tolist() for c in part["content"]]})

    return files.select("utt", "content").mapInPandas(run, "utt string, features array<array<double>>")


#: Samples of a block of a long recording, without its halo: 16 seconds.
BLOCK = 1 << 18


def _head(path: str) -> tuple[str, int, str | None]:
    """(kind, samples at ``RATE``, error) of a file, of which the beginning is read."""
    try:
        with files.opened(path) as f:
            kind = f.read(4)
            if kind in _HEADERS:
                found = _HEADERS[kind](f)
                return "raw", resampled_count(found.count, found.rate), None
            if kind == b"fLaC":
                return "flac", 0, None
            return "", 0, _UNKNOWN
    except (OSError, ValueError) as e:
        return "", 0, str(e)


def heads(names: DataFrame) -> DataFrame:
    """(utt, kind, n, error) of the distinct files named by ``names`` (utt), which are opened where their names are dealt to.

    A file that isn't there, or can't be read, has an error and no kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_head(path) for path in batch.column("utt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("utt"), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["utt", "kind", "n", "error"])

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are small, so tasks aren't told by bytes
    return names.where("utt is not null").select("utt").repartition(tasks, "utt").dropDuplicates(["utt"]).mapInArrow(run, "utt string, kind string, n long, error string")


def sample_blocks(heads: DataFrame, frames: Frames = DEFAULT, block: int = BLOCK) -> DataFrame:
    """(utt, block, n, first, samples) of files (utt, kind, n): mono blocks with half a frame on either side.

    A WAV or AIFF file is read in as many tasks as it has blocks, each of which seeks what it
    needs; a FLAC file, whose frames follow one another, in one.
    """
    half = frames.fft // 2

    def cut(x: np.ndarray, first: int, number: int, n: int) -> tuple:
        begin, end = max(0, number * block - half), min(n, (number + 1) * block - frames.hop + half)
        return number, n, begin, x[begin - first : end - first]

    def of_raw(path: str, number: int, n: int) -> Iterator[tuple]:
        with files.opened(path) as f:
            found = _HEADERS[f.read(4)](f)
            begin, end = max(0, number * block - half), min(n, (number + 1) * block - frames.hop + half)
            lo, hi = needed(begin, end, found.rate)
            lo, hi = max(0, lo), min(found.count, hi)
            yield number, n, begin, resample(mono(wav.samples(f, found, lo, hi)), found.rate, first=lo, begin=begin, end=end)

    def of_flac(path: str) -> Iterator[tuple]:
        with files.opened(path) as f:
            x, rate = decode_flac(f.read())
        x = resample(mono(x), rate)
        for number in range(len(x) // block + 1):
            yield cut(x, 0, number, len(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for utt, kind, n, number in zip(*(batch.column(c).to_pylist() for c in ("utt", "kind", "n", "block")), strict=True):
                for b, n, first, x in of_raw(utt, number, n) if kind == "raw" else of_flac(utt):
                    arrays = [pa.array([utt]), *(pa.array([v], pa.int64()) for v in (b, n, first)), pa.array([x], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["utt", "block", "n", "first", "samples"])

    blocks = heads.where("kind <> ''").withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "raw", F.floor(F.col("n") / block)).otherwise(0))))
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("utt", "kind", "n", "block").repartition(tasks, "utt", "block").mapInArrow(run, "utt string, block long, n long, first long, samples array<double>")
