"""Windows over frame sequences: overlapping ones for inference, random crops for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import integer
from ..functions.numbers import numbered


def frames(events: DataFrame, key: str, order: tuple[str, ...], value: str, part: Column | None = None) -> DataFrame:
    """(key, frame, value, n_frames): rows of each key numbered from 0, and their number. ``part``, which never falls along the order, deals a key to several tasks."""
    return numbered(events, key, order, F.lit(0) if part is None else part, "frame", "n_frames").select(key, "frame", value, "n_frames")


def pool_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pooled): the mean over a key's frames."""
    return rows.groupBy(key).agg(F.avg(value).alias("pooled"))


def pool_last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pooled): the value of a key's last frame."""
    return rows.groupBy(key).agg(F.max_by(value, "frame").alias("pooled"))


def window_rows(rows: DataFrame, key: str, value: str, length: int, step: int) -> DataFrame:
    """(utt, window, features): each window of a key's frames, of one value each, as a row of bounded size."""
    inside = framed(rows, key, length, step).groupBy(F.col(key).cast("string").alias("utt"), "window")
    return inside.agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", value))), lambda x: F.array(x[value])).alias("features"))


def window_starts(n: Column, length: int, step: int) -> Column:
    """Starts 0, step, ... of the whole windows of n frames; none if there are fewer than ``length``."""
    return F.when(n >= length, F.sequence(F.lit(0), (n - length).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def sliding_windows(matrix: Column, length: int, step: int) -> Column:
    """Array of windows of an array of frames."""
    return F.transform(window_starts(F.size(matrix), length, step), lambda s: F.slice(matrix, s + 1, length))


def framed(rows: DataFrame, key: str, length: int, step: int) -> DataFrame:
    """Rows (key, frame, ...) once for each window they lie in, with ``window``; a range join by arithmetic.

    Frames are counted where rows don't come with ``n_frames``, as those of ``frames`` do.
    """
    if "n_frames" not in rows.columns:
        n = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_frames"))
        rows = rows.join(n, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - length) / step) + 1)
    last = F.least(F.floor(F.col("frame") / step), F.floor((F.col("n_frames") - length) / step))
    inside = rows.where(F.col("n_frames") >= length).withColumn("lo", first.cast("long")).withColumn("hi", last.cast("long")).where("lo <= hi")
    return inside.withColumn("window", F.explode(F.sequence("lo", "hi"))).drop("n_frames", "lo", "hi")


def crop_start(n: Column, length: int, tag: str, *parts: Column | str) -> Column:
    """Start of a random crop, from 0 to n - length, both included; null if there are too few frames."""
    return F.when(n >= length, integer(F.lit(0), n - length, tag, *parts))


def crop(matrix: Column, length: int, tag: str, *parts: Column | str) -> Column:
    return F.slice(matrix, (crop_start(F.size(matrix), length, tag, *parts) + 1).cast("int"), length)
