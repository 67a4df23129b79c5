"""Mel cepstra of utterances of any length, from blocks of samples that are framed apart.

A block holds the frames that are centred in its stretch of the utterance, so it needs half
a frame of samples beyond either end: a halo. Blocks are rows of bounded size, so an
hour of one speaker is as many tasks as it has blocks. What all frames of an utterance
have to know, the loudest band for the floor of 80 decibels, is one aggregate over
the frames' decibels, after which each frame's cepstrum is computed on its own. The
result is that of the whole utterance in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import audio
from ..sources.audio import BLOCK, DEFAULT, TOP_DB, Frames, dct_matrix, decibels


def sample_blocks(samples: DataFrame, key: str, value: str, frames: Frames = DEFAULT, block: int = BLOCK) -> DataFrame:
    """(utt, block, n, first, samples) of rows (key, frame, value, n_frames), where frame numbers a key's samples from 0.

    ``first`` is the number of the first sample there, ``n`` that of all samples of
    the utterance. ``block`` is a multiple of the hop.
    """
    if block % frames.hop:
        raise ValueError("a block has to be a multiple of the hop")
    half, at = frames.fft // 2, F.col("frame")
    # The centres that a sample is in the frames of: over frame - half, up to frame + half.
    low = F.greatest(F.lit(0), F.floor((at - half + 1) / block))
    high = F.least(F.floor((at + half) / block), F.floor(F.col("n_frames") / block))
    dealt = samples.withColumn("block", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")))).where(high >= low)
    inside = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("x"))))
    blocks = dealt.groupBy(F.col(key).cast("string").alias("utt"), "block").agg(F.max("n_frames").alias("n"), inside.alias("s"))
    return blocks.select("utt", "block", "n", F.element_at("s", 1)["at"].alias("first"), F.transform("s", lambda x: x["x"]).alias("samples"))


def _rows(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix, float).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), flat)


def frame_decibels(blocks: DataFrame, frames: Frames = DEFAULT, block: int = BLOCK) -> DataFrame:
    """(utt, frame, db) of the rows of ``sample_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for utt, number, n, first, samples in zip(*(batch.column(c) for c in ("utt", "block", "n", "first", "samples")), strict=True):
                number, n, first = number.as_py(), n.as_py(), first.as_py()
                begin = number * block
                count = min(block, n - begin + frames.hop - n % frames.hop) // frames.hop  # centres from begin, up to n
                padded = np.zeros((count - 1) * frames.hop + frames.fft)
                x = samples.values.to_numpy(zero_copy_only=False)
                at = first - begin + frames.fft // 2
                padded[at : at + len(x)] = x[: max(0, len(padded) - at)]
                db = decibels(padded, frames)
                yield pa.RecordBatch.from_arrays([pa.array([utt.as_py()] * count, pa.string()), pa.array(begin // frames.hop + np.arange(count)), _rows(db)], ["utt", "frame", "db"])

    return blocks.mapInArrow(run, "utt string, frame long, db array<double>")


def cepstra(db: DataFrame, n_mfcc: int, mels: int = DEFAULT.mels) -> DataFrame:
    """(utt, frame, mfcc) of all frames' decibels (utt, frame, db)."""
    loudest = db.groupBy("utt").agg(F.max(F.array_max("db")).alias("loudest"))
    matrix = dct_matrix(mels, n_mfcc).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("db").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, mels)
                floor = batch.column("loudest").to_numpy()[:, None] - TOP_DB
                yield pa.RecordBatch.from_arrays([batch.column("utt"), batch.column("frame"), _rows(np.maximum(x, floor) @ matrix)], ["utt", "frame", "mfcc"])

    return db.join(loudest, "utt").mapInArrow(run, "utt string, frame long, mfcc array<double>")


def of_files(heads: DataFrame, n_mfcc: int, frames: Frames = DEFAULT, block: int = BLOCK) -> DataFrame:
    """(utt, features) of files (utt, kind, n), as ``audio.heads`` has them: the whole cepstrum of each, computed block by block."""
    rows = cepstra(frame_decibels(audio.sample_blocks(heads, frames, block), frames, block), n_mfcc, frames.mels)
    return rows.groupBy("utt").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "mfcc"))), lambda x: x["mfcc"]).alias("features"))
