"""Windows over streams: of counted frames, as in batch framing, and of event time, an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_means(events: DataFrame, length: str = "20 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n, mean_value) of sliding windows; works on batch and streaming frames (ts, user_id, value)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy("user_id", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("user_id", F.col("w.start").alias("start"), "n", "mean_value")


def frame_windows(frames: DataFrame, key: str, order: str, value: str, length: int, step: int) -> DataFrame:
    """(utt, window, first_frame, features) of a stream of frames: every ``length`` of a key's frames, ``step`` apart, as in batch framing.

    Frames are counted, not timed: state holds how many frames a key has had and those
    that a window to come still needs, ``length`` at most. Frames of a micro-batch are put
    in order by ``order``; a later micro-batch has later frames. However the stream is cut
    into micro-batches, the windows are the same.
    """

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, windows, tail = state.get if state.exists else (0, 0, [])
        tail, found = list(tail), []
        for x in pd.concat(parts).sort_values(order, kind="stable")[value].tolist():
            if seen >= windows * step:  # else it lies between two windows
                tail.append(x)
            seen += 1
            if len(tail) == length:
                found.append((windows, tail))
                windows, tail = windows + 1, tail[step:]
        state.update((seen, windows, tail))
        columns = {"window": [w for w, _ in found], "first_frame": [w * step for w, _ in found], "features": [[[v] for v in x] for _, x in found]}
        yield pd.DataFrame({"utt": [names[0]] * len(found), **columns})

    rows = frames.select(F.col(key).cast("string").alias("utt"), order, F.col(value).cast("double").alias(value))
    return rows.groupBy("utt").applyInPandasWithState(run, "utt string, window long, first_frame long, features array<array<double>>", "seen long, windows long, tail array<double>", "append", GroupStateTimeout.NoTimeout)
