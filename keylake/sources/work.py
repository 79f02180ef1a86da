"""Working tables: intermediate results written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset a fresh local folder on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """df written and read back: cuts lineage, and a lost executor loses none of it."""
    path = path or f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a working table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes working tables; they are deleted at the end of the block."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(f"{shared_folder(spark)}/work-{uuid.uuid4().hex}")
        return written(spark, df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            removed(spark, path)
