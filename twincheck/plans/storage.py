"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local master may leave that setting out."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            top = held.get()
        elif spark.sparkContext.master.startswith("local"):
            top = "/tmp/checkpoints/twincheck"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/twincheck-{uuid.uuid4().hex}"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the write that needed them has ended."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def materialised(df: DataFrame, **options: object) -> DataFrame:
    """Write df to the shared folder, with the writer's options, and read it back: lineage ends there and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    with _tidy(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
