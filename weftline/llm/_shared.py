"""Where intermediate tables go, and small helpers for Arrow batches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.shipping import ship

#: Rows of one long column that may be broadcast: 8 MB of payload. Callers count first and shuffle beyond it.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one if all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def prepare(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and Arrow batches of at most BATCH_BYTES: two tasks hold several at a time."""
    ship(spark)
    if int(re.sub(r"\D", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) or 0) != BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}-{name}"


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and a lost executor costs no more than its tasks."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, size: int = 8 << 20):
    """Parts of Arrow batches with about ``size`` bytes of ``text`` each, so that Python objects are made for few texts at a time."""
    import pyarrow.compute as pc

    for batch in batches:
        _give_back()
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes, dtype=np.int64) // size
        starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
        for a, b in zip(starts, [*starts[1:], len(parts)], strict=True):
            yield batch.slice(a, b - a)
        del batch
    _give_back()


def _give_back() -> None:
    """Returns what this process has freed to the system: idle workers share their executor's memory with busy ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def decoded(column) -> list[str]:
    """The texts of an Arrow string column; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return ["" if x is None else x.decode("utf-8", "replace") for x in texts_of(column)]
