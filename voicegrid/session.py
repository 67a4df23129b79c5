"""Sessions for local work, and shipping of this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it is unset, in local runs only, a folder of this session."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="voicegrid-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: computed once, and its lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="voicegrid-code-")) / "voicegrid.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(_PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        path = Path(folder) / name
                        z.write(path, path.relative_to(_PACKAGE.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
