"""Cutting lineage in loops, through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of numbers, at most, that are sent to every executor instead of shuffling what they meet: about 50 MB for each such join.
SENT = 1 << 21
#: Whether Spark removes the shuffle files of a job when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a folder is made only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def keep(df: DataFrame) -> str:
    """The path of a new table in the shared folder that holds ``df``. The shuffle files that made it go at once: readers have the table."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: readers take the columns they need and know its size."""
    return df.sparkSession.read.schema(df.schema).parquet(keep(df))


def sent(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it holds numbers only, in SENT rows at most; otherwise what meets it is shuffled."""
    numbers = all(kind in ("bigint", "int", "boolean") for _, kind in df.dtypes)
    return F.broadcast(df) if numbers and df.limit(SENT + 1).count() <= SENT else df
