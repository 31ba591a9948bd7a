"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of less than this many bytes in files are spread over all cores: as files they are one task's work.
SPREAD_BYTES = 64 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of ``written`` tables that weren't deleted yet.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a temporary folder for a local master and an error for a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isEmpty() and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if current.isEmpty():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessellum-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """df, over all cores if it is small: a file of one row group is read by one task, whatever hangs on it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a compressed Parquet table in the shared folder: for the larger intermediates.

    The shuffles that led to it are deleted with the write, since nothing else can
    read them, rather than whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _MADE.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end the tables ``written`` inside; what is to last has to be written elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            delete(spark, path)
        del _MADE[before:]
