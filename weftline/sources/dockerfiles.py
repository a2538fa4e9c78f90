"""Dockerfiles as (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.definitions import scan


def read(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "Dockerfile*").select("path", F.decode("content", "UTF-8").alias("text"))
