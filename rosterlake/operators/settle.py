"""Tables that are written once and read again, below the shared checkpoint folder: lineage ends there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder: below the one that spark.checkpoint.dir names, else (local masters only) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="rosterlake-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = _local[0]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "settled") -> DataFrame:
    """df, computed once into a table of its own."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
