"""Masking of feature matrices: a band of columns, then a band of rows, set to the matrix's mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import bernoulli, integer
from ..functions.vectors import matrix_mean, once


@dataclass(frozen=True)
class Masks:
    freq_prob: float = 0.3
    time_prob: float = 0.3
    freq_max: int = 16
    time_max: int = 10


def masked(df: DataFrame, matrix: str, key: str, masks: Masks, seed: str = "m") -> DataFrame:
    """``df`` with ``matrix`` masked. Both bands take the mean from before either mask.

    Widths are from 1 to their maximum, starts from 0 to what leaves the band inside.
    Draws and mean are computed once a row, not for each cell.
    """
    n_rows, n_columns = F.size(matrix), F.size(F.element_at(matrix, 1))

    def band(name: str, prob: float, most: int, size: Column) -> list[Column]:
        width = F.least(integer(1, most, f"{seed}{name}w", key), size)
        start = integer(F.lit(0), size - width, f"{seed}{name}s", key)
        here = bernoulli(prob, f"{seed}{name}p", key)
        return [F.when(here, start).otherwise(F.lit(-1)).alias(f"{name}s"), F.when(here, start + width).otherwise(F.lit(-1)).alias(f"{name}e")]

    drawn = F.struct(matrix_mean(F.col(matrix)).alias("mean"), *band("f", masks.freq_prob, masks.freq_max, n_columns), *band("t", masks.time_prob, masks.time_max, n_rows))

    def rows(b: Column) -> Column:
        inside = lambda m, t: ((m >= b["fs"]) & (m < b["fe"])) | ((t >= b["ts"]) & (t < b["te"]))
        return F.transform(matrix, lambda row, t: F.transform(row, lambda x, m: F.when(inside(m, t), b["mean"]).otherwise(x.cast("double"))))

    return df.withColumn(matrix, once(drawn, rows))
