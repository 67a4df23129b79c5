"""Model parameters as Parquet tables (name, shape, data)."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import msgpack

SUFFIX = ".parquet"
Params = dict[str, np.ndarray]


def with_suffix(path: str) -> str:
    """The same on both sides, so that what is saved as ``X`` is loaded as ``X``."""
    return path if path.endswith(SUFFIX) else path + SUFFIX


def as_table(spark: SparkSession, params: Params) -> DataFrame:
    rows = [(name, list(p.shape), p.astype(float).ravel().tolist()) for name, p in sorted(params.items())]
    return spark.createDataFrame(rows, "name string, shape array<int>, data array<double>")


def save_table(table: DataFrame, path: str) -> str:
    """Write (name, shape, data) rows."""
    table.write.mode("overwrite").parquet(with_suffix(path))
    return with_suffix(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, data) rows of a table; a name that ends in .msgpack may also be a file that another tool saved, if there is no table of it."""
    try:
        return spark.read.parquet(with_suffix(path))
    except AnalysisException as e:
        if not path.endswith(msgpack.SUFFIX) or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return msgpack.table(spark, path)


def save(spark: SparkSession, path: str, params: Params) -> str:
    return save_table(as_table(spark, params).coalesce(1), path)


def load(spark: SparkSession, path: str) -> Params:
    rows = load_table(spark, path).collect()  # one row a parameter
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}


def checkpoint_path(path: str, step: int) -> str:
    return with_suffix(f"{path.removesuffix(SUFFIX)}.ckpt-{step}")
