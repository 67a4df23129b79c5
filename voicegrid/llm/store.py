"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs only the tasks it was running, never finished stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


#: The lists of all scratches that are open, the innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for held in _scratch.get():
        held.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Within, the paths that ``materialize`` writes are listed; those still listed at the end are deleted.

    What is read later has to be taken off the list (its ``stored_at``); a scratch around
    this one still has it on its own. After a failure nothing is deleted.
    """
    held: list[str] = []
    token = _scratch.set((*_scratch.get(), held))
    try:
        yield held
    finally:
        _scratch.reset(token)
    for path in held:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def renamed(docs: DataFrame, *known: str) -> DataFrame:
    """``docs`` with plain names (x0, x1, ...) for all columns but ``known``; ``toDF(*docs.columns)`` gives the names back.

    No name that an operator adds clashes then, and names with dots or backticks need no quoting.
    """
    return docs.toDF(*(c if c in known else f"x{k}" for k, c in enumerate(docs.columns)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
